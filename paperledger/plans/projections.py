"""The store's tables as projections of a star schema (orders, lineitem, customer, ...), in SQL that
Spark and DuckDB read alike. Queries start from them, and so does their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..cluster import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

SQL: dict[str, str] = {
    "companies": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               CASE n_nationkey % 3 WHEN 0 THEN concat('ООО «', n_name, '»') WHEN 1 THEN concat('Частное унитарное предприятие "', n_name, '"') ELSE concat(n_name, ' ОАО') END AS name,
               CAST(900000000 + n_nationkey AS STRING) AS unp, lower(n_name) AS folder, n_nationkey % 3 = 0 AS approval_required, n_nationkey % 7 <> 6 AS is_active
        FROM nation""",
    "users": """
        SELECT c_custkey AS id, c_name AS login, CASE WHEN c_custkey % 40 = 0 THEN 'admin' WHEN c_custkey % 4 = 1 THEN 'operator' WHEN c_custkey % 4 = 2 THEN 'accountant' ELSE 'client' END AS role,
               c_custkey % 11 <> 5 AS is_active, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 20 = 1 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS company_id,
               TIMESTAMP '1998-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 997) AS created_at
        FROM customer""",
    "company_accountants": """
        SELECT DISTINCT user_id, company_id FROM (
            SELECT c_custkey AS user_id, c_custkey % 25 AS company_id FROM customer WHERE c_custkey % 4 = 2
            UNION ALL SELECT c_custkey, c_custkey * 7 % 25 FROM customer WHERE c_custkey % 4 = 2) l""",
    "store_documents": """
        SELECT o_orderkey AS id, o_custkey AS owner_id, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_custkey % 25 END AS company_id,
               CASE o_orderkey % 9 WHEN 0 THEN 'received' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'needs_input' WHEN 4 THEN 'needs_review' WHEN 5 THEN 'needs_approval' WHEN 6 THEN 'rejected' WHEN 7 THEN 'confirmed' ELSE 'exported' END AS status,
               CASE WHEN o_orderkey % 9 <> 8 THEN NULL WHEN o_orderkey % 5 < 2 THEN 'posted' WHEN o_orderkey % 5 = 2 THEN 'rejected' WHEN o_orderkey % 5 = 3 THEN 'accepted' ELSE NULL END AS onec_status,
               CASE o_orderkey % 8 WHEN 0 THEN 'invoice' WHEN 1 THEN 'act' WHEN 2 THEN 'waybill' WHEN 3 THEN 'contract' WHEN 4 THEN 'upd' WHEN 5 THEN 'payment_order' WHEN 6 THEN 'letter' ELSE 'unknown' END AS doc_type,
               concat('scan-', CAST(o_orderkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' ELSE '' END) AS original_name,
               concat('k', CAST(o_custkey % 500 AS STRING), '-', CAST(o_orderkey % 7 AS STRING)) AS sha256,
               o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS created_at, o_orderdate + INTERVAL '1' HOUR * (24 + o_orderkey % 100) AS updated_at,
               CASE WHEN o_orderkey % 9 = 8 AND o_orderkey % 5 < 3 THEN o_orderdate + INTERVAL '1' HOUR * (48 + o_orderkey % 50) ELSE NULL END AS onec_updated_at,
               CASE WHEN o_orderkey % 9 = 8 AND o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '1' HOUR * (72 + o_orderkey % 60) ELSE NULL END AS archived_at
        FROM orders""",
    "export_jobs": """
        SELECT o_orderkey * 10 AS id, CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'partial' ELSE 'update' END AS kind,
               CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CAST(o_orderkey % 6 AS BIGINT) AS attempts, o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 200) AS next_attempt_at
        FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""",
    "counterparty_names": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_custkey % 25 END AS company_id, CASE WHEN o_orderkey % 3 = 0 THEN 'exported' ELSE 'confirmed' END AS status,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST(900000000 + o_custkey % 25 AS STRING) WHEN o_orderkey % 13 = 0 THEN '12345' ELSE CAST(100000000 + s_suppkey AS STRING) END AS unp,
               CASE o_orderkey % 4 WHEN 0 THEN concat('ООО «', s_name, '»') WHEN 1 THEN concat('Общество с ограниченной ответственностью "', s_name, '"') WHEN 2 THEN upper(s_name) ELSE concat(s_name, ' ') END AS name
        FROM orders JOIN supplier ON s_suppkey = o_orderkey % 40""",
    "audit": """
        SELECT event_id AS id, user_id AS actor_id, CASE event_type WHEN 'purchase' THEN 'posted' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'login' WHEN 'view' THEN 'viewed' ELSE 'changed' END AS action,
               user_id % 37 AS entity_id, ts AS created_at
        FROM events""",
    "feedback": """
        SELECT event_id, user_id * 3 + event_id % 3 AS doc_id, CASE event_type WHEN 'purchase' THEN 'posted' WHEN 'error' THEN 'error' WHEN 'view' THEN 'accepted' WHEN 'signup' THEN 'rejected' ELSE 'other' END AS status, ts
        FROM events""",
    "expected": """
        SELECT o_orderkey AS doc_id, k AS key, CASE WHEN o_orderkey % 6 = 5 AND k = 'currency' THEN NULL ELSE
               CASE k WHEN 'number' THEN CAST(o_orderkey AS STRING) WHEN 'total' THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) WHEN 'currency' THEN 'BYN' WHEN 'unp' THEN CAST(100000000 + o_custkey AS STRING)
               ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'act' WHEN o_orderkey % 3 = 1 THEN 'invoice' ELSE 'contract' END END END AS value
        FROM orders CROSS JOIN (SELECT 'number' AS k UNION ALL SELECT 'total' UNION ALL SELECT 'currency' UNION ALL SELECT 'unp' UNION ALL SELECT 'doc_type') f""",
    "actual": """
        SELECT o_orderkey AS doc_id, k AS key,
               CASE k WHEN 'number' THEN CASE WHEN o_orderkey % 7 = 1 THEN ' ' ELSE concat(' ', CAST(o_orderkey AS STRING)) END WHEN 'total' THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END AS STRING) WHEN 'currency' THEN 'BYN'
               WHEN 'unp' THEN CAST(100000000 + o_custkey + CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS STRING) WHEN 'kpp' THEN CAST(o_custkey AS STRING)
               ELSE CASE WHEN o_orderkey % 21 = 3 THEN 'contract' WHEN o_orderkey % 3 = 0 THEN 'ACT' WHEN o_orderkey % 3 = 1 THEN 'invoice' ELSE 'contract' END END AS value
        FROM orders CROSS JOIN (SELECT 'number' AS k UNION ALL SELECT 'total' UNION ALL SELECT 'currency' UNION ALL SELECT 'unp' UNION ALL SELECT 'doc_type' UNION ALL SELECT 'kpp') f
        WHERE NOT (k = 'number' AND o_orderkey % 7 = 4) AND NOT (k = 'kpp' AND o_orderkey % 5 > 0) AND o_orderkey % 31 > 0""",
    "lines": """
        SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS line_no, p_partkey AS part_id, p_name AS name, CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(p_retailprice * 100) AS BIGINT) AS price, CASE WHEN l_orderkey % 5 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) END AS amount
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "invoice_heads": """
        SELECT o_orderkey AS doc_id, CAST(o_orderkey AS STRING) AS number, concat(CASE WHEN o_orderkey % 28 < 9 THEN '0' ELSE '' END, CAST(1 + o_orderkey % 28 AS STRING), '.0', CAST(1 + o_orderkey % 9 AS STRING), '.', CAST(1995 + o_orderkey % 7 AS STRING)) AS date,
               CAST(100000000 + s_suppkey AS STRING) AS unp, CAST(200000000 + o_custkey AS STRING) AS organization_unp, s_name AS counterparty, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CASE WHEN o_orderkey % 2 = 0 THEN 'BYN' ELSE 'USD' END AS currency
        FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10""",
    "words": """
        SELECT doc_id, 1 AS page_no, line_no * 10 + k AS seq, t AS text, CAST(100 + 200 * k AS DOUBLE) AS x0, CAST(40 * line_no + k % 3 AS DOUBLE) AS y0, CAST(100 + 200 * k + 10 * length(t) AS DOUBLE) AS x1, CAST(40 * line_no + 20 + k % 3 AS DOUBLE) AS y1
        FROM (SELECT doc_id, line_no, k, CASE k WHEN 0 THEN name WHEN 1 THEN CAST(qty AS STRING) WHEN 2 THEN 'pc' WHEN 3 THEN CAST(price AS STRING) ELSE CAST(amount AS STRING) END AS t
              FROM lines CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c) w""",
    "totals": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE CAST(coalesce(s, 0) AS BIGINT) END AS total
        FROM orders LEFT JOIN (SELECT doc_id AS k, sum(amount) AS s FROM lines GROUP BY doc_id) t ON k = o_orderkey""",
}


#: SQL of projections as Spark runs it, where that of SQL gives the same rows with more work.
SPARK_SQL: dict[str, str] = {
    # numbered by doc_id itself: by l_orderkey, a column beside it, Spark dealt all lines out a second time by doc_id
    "lines": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS line_no, part_id, name, qty, price, amount
        FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, p_partkey AS part_id, p_name AS name, CAST(l_quantity AS BIGINT) AS qty, CAST(round(p_retailprice * 100) AS BIGINT) AS price,
                     CASE WHEN l_orderkey % 5 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) END AS amount
              FROM lineitem JOIN part ON p_partkey = l_partkey) l""",
}


def needed(sql: str, known: dict[str, str] = SQL) -> list[str]:
    """Projections that the SQL names, each after those that it needs itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in out:
                add(known[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def oracle(sql: str, known: dict[str, str] = SQL) -> str:
    """DuckDB SQL of a query over projections and base tables."""
    names = needed(sql, known)
    return ("WITH " + ", ".join(f"{n} AS ({known[n]})" for n in names) + " " if names else "") + sql


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame. Only the base tables that it names are read."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Any SQL over projections and base tables, in Spark."""
    text = oracle(sql, SQL | SPARK_SQL)
    used = [b for b in BASE if re.search(rf"\b(FROM|JOIN)\s+{b}\b", text)]
    for b in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in used})
