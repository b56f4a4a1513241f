"""Every registered query of the library's own operators, with its DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize
from ..functions import money, parties, text
from ..operators import accuracy, catalog, extract, geometry, lines, rules, store
from ..streaming import batch as flows
from . import evidence_queries, table_queries  # noqa: F401
from .projections import oracle, projection
from .registry import ORACLE_SQL, QUERIES, query

AS_OF = "1999-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


TS = f"TIMESTAMP '{AS_OF}'"
N = "CAST(count(*) AS BIGINT)"


@query("f1_list_documents", "SELECT d.id, d.status, coalesce(c.name, '') AS company_name FROM store_documents d LEFT JOIN companies c ON c.id = d.company_id WHERE d.archived_at IS NULL AND d.status = 'needs_review' ORDER BY d.created_at DESC, d.id DESC LIMIT 50 OFFSET 20", "store_documents", "companies")
def f1(documents, companies):
    return store.list_documents(documents, companies, status="needs_review", limit=9999, offset=20).select("id", "status", "company_name")


@query("f2_count_documents", f"SELECT {N} AS n FROM store_documents WHERE company_id IN (1, 2, 3) AND archived_at IS NOT NULL", "store_documents")
def f2(documents):
    return store.count_documents(documents, company_ids=[1, 2, 3], archive="only")


_SEES = "(role = 'admin' OR (role = 'operator' AND company_id IS NULL))"
_VISIBLE = f"SELECT id AS user_id, CAST(NULL AS BIGINT) AS company_id, true AS sees_all FROM users WHERE {_SEES} UNION ALL SELECT DISTINCT user_id, company_id, false FROM (SELECT id AS user_id, company_id FROM users WHERE NOT {_SEES} AND company_id IS NOT NULL UNION ALL SELECT l.user_id, l.company_id FROM company_accountants l JOIN users u ON u.id = l.user_id WHERE u.role = 'accountant') v"


@query("f3_visible_companies", _VISIBLE, "users", "company_accountants")
def f3(users, links):
    return store.visible_companies(users, links)


@query(
    "f4_visible_documents",
    f"SELECT user_id, {N} AS n, CAST(coalesce(sum(document_id), 0) AS BIGINT) AS ids FROM (SELECT u.id AS user_id, d.id AS document_id FROM users u JOIN store_documents d ON d.owner_id = u.id WHERE u.role = 'client' UNION ALL SELECT v.user_id, d.id FROM ({_VISIBLE.replace('FROM users WHERE', 'FROM users WHERE role <> ' + chr(39) + 'client' + chr(39) + ' AND')}) v JOIN store_documents d ON d.company_id = v.company_id WHERE NOT v.sees_all UNION ALL SELECT id, NULL FROM users WHERE {_SEES}) x GROUP BY user_id",
    "users", "store_documents", "company_accountants",
)
def f4(users, documents, links):
    return store.visible_totals(users, documents, links)


@query("f5_expired_archived", f"SELECT id FROM store_documents WHERE archived_at < {TS} - INTERVAL '504' HOUR ORDER BY archived_at, id LIMIT 500", "store_documents", "companies")
def f5(documents, companies):
    return store.expired_archived(documents, companies, 21, as_of(), 5000).select("id")


@query("f6_retention_days_left", f"SELECT id, days_left, CASE WHEN days_left IS NULL THEN 'unlimited' WHEN days_left <= 0 THEN 'deleting' WHEN days_left <= 3 THEN 'urgent' ELSE 'normal' END AS label FROM (SELECT id, CAST(ceil((CAST(epoch(archived_at) AS BIGINT) + 86400 * 21 - CAST(epoch({TS}) AS BIGINT)) / 86400.0) AS BIGINT) AS days_left FROM store_documents) x", "store_documents")
def f6(documents):
    return store.retention_days_left(documents, 21, as_of())


@query("f7_unacknowledged_exports", f"SELECT {N} AS n FROM store_documents WHERE status = 'exported' AND coalesce(onec_status, '') = '' AND updated_at < {TS} - INTERVAL '48' HOUR", "store_documents")
def f7(documents):
    return store.unacknowledged_exports(documents, as_of())


@query("f8_awaiting_approval", f"SELECT {N} AS n FROM store_documents WHERE status = 'needs_approval' AND company_id IN (4, 5)", "store_documents")
def f8(documents):
    return store.awaiting_approval(documents, [4, 5])


@query("f9_claimable_exports", f"SELECT id, document_id FROM export_jobs WHERE status = 'pending' AND next_attempt_at <= {TS}", "export_jobs")
def f9(jobs):
    return store.claimable_exports(jobs, as_of()).select("id", "document_id")


_TYPE = "CASE WHEN doc_type IN ('act','schet_faktura','act_priemki','invoice','receipt','payment_order','act_sverki') THEN 'act' ELSE doc_type END"


@query("f10_effective_types", f"SELECT {_TYPE} AS effective, CASE WHEN {_TYPE} IN ('act','waybill','contract','power_of_attorney','upd') THEN {_TYPE} END AS inbox, {N} AS n FROM store_documents GROUP BY 1, 2", "store_documents")
def f10(documents):
    t = F.col("doc_type")
    return documents.select(catalog.effective_doc_type(t).alias("effective"), catalog.type_inbox_doc_type(t).alias("inbox")).groupBy("effective", "inbox").agg(F.count(F.lit(1)).alias("n"))


SPECS = [
    {"slug": "invoice", "anchors": ["th", "счёт на оплату"], "weight": 0.5, "required": ["number", "date", "total", "@taxid"], "has_lines": True, "object": "Invoice"},
    {"slug": "act", "anchors": ["ing the", "акт №"], "weight": 0.3, "required": ["number", "date", "total"], "object": "Act"},
    {"slug": "waybill", "anchors": ["de la", "le "], "weight": 0.4, "required": ["number", "date", "@taxid"], "has_lines": True, "object": "Waybill"},
    {"slug": "contract", "anchors": ["und ", "der"], "weight": 0.0, "required": ["number", "date", "counterparty"], "object": ""},
]


def _specs(df: DataFrame) -> DataFrame:
    return catalog.catalogue_frame(df.sparkSession, SPECS)


@query("f12_export_routable", f"SELECT doc_type, doc_type IN ('invoice', 'act', 'waybill') AS routable, {N} AS n FROM store_documents GROUP BY 1, 2", "store_documents")
def f12(documents):
    return catalog.export_routable(documents, _specs(documents)).groupBy("doc_type", "routable").agg(F.count(F.lit(1)).alias("n"))


_ROUTABLE = "doc_type IN ('invoice', 'act', 'waybill')"


@query("f15_route_status", f"SELECT id, CASE WHEN doc_type = 'unknown' THEN 'needs_review' WHEN NOT {_ROUTABLE} THEN 'needs_review' WHEN id % 3 > 0 THEN 'confirmed' ELSE 'needs_input' END AS route, CASE WHEN {_TYPE} IN ('act','waybill','contract','power_of_attorney','upd') THEN 'confirmed' ELSE 'needs_review' END AS inbox_route FROM store_documents", "store_documents")
def f15(documents):
    rows = catalog.export_routable(documents, _specs(documents))
    missing = F.when(F.col("id") % 3 == 0, "total").otherwise("")
    route = catalog.route_status(F.col("doc_type"), F.col("routable"), missing)
    return rows.select("id", route.alias("route"), catalog.route_status(F.col("doc_type"), F.col("routable"), missing, profile="type_inbox").alias("inbox_route"))


@query(
    "f16_final_status",
    f"SELECT id, CASE WHEN login = 'Customer#000000007' THEN 'needs_review' WHEN r = 'confirmed' AND approval_required AND id % 4 > 0 THEN 'needs_approval' ELSE r END AS status, CASE WHEN login = 'Customer#000000007' THEN NULL WHEN r = 'confirmed' AND NOT (approval_required AND id % 4 > 0) THEN 'create' WHEN r = 'needs_input' THEN 'partial' END AS job_kind, m AS missing FROM (SELECT d.id, u.login, coalesce(c.approval_required, false) AS approval_required, concat_ws(',', CASE WHEN d.id % 3 = 0 THEN 'total' END, CASE WHEN d.id % 10 = 0 THEN 'lines' END) AS m, CASE WHEN doc_type = 'unknown' OR NOT {_ROUTABLE} THEN 'needs_review' WHEN d.id % 3 > 0 AND d.id % 10 > 0 THEN 'confirmed' ELSE 'needs_input' END AS r FROM store_documents d LEFT JOIN companies c ON c.id = d.company_id LEFT JOIN users u ON u.id = d.owner_id) x",
    "store_documents", "companies", "users",
)
def f16(documents, companies, users):
    rows = catalog.export_routable(documents, _specs(documents)).select("id", "owner_id", "company_id", "doc_type", "routable", F.when(F.col("id") % 3 == 0, "total").otherwise("").alias("missing"), (F.col("id") % 10 == 0).alias("lines_mismatch"), F.lit(False).alias("faulty"), (F.col("id") % 4 == 0).alias("auto_pass"))
    return catalog.final_status(rows, companies, users, test_logins=("Customer#000000007",))


@query("f18_block_reason", f"SELECT id, CASE WHEN status = 'exported' THEN 'exported' WHEN status = 'needs_approval' THEN 'waits for approval' WHEN status = 'rejected' THEN 'returned' WHEN status IN ('received','processing','failed') THEN 'not recognised' WHEN NOT {_ROUTABLE} THEN 'no target' ELSE '' END AS reason FROM store_documents", "store_documents")
def f18(documents):
    return store.block_reason(documents, _specs(documents))


@query("f19_ocr_looks_solid", "SELECT doc_id, letters >= 24 AND letters * 2 >= solid AS ok FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '\\s', '', 'g')) AS solid FROM documents) x", "documents")
def f19(documents):
    return documents.select("doc_id", text.ocr_looks_solid(F.col("text")).alias("ok"))


@query("f22_content_types", f"SELECT content_type, {N} AS n FROM (SELECT CASE id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS content_type FROM store_documents) x GROUP BY 1", "store_documents")
def f22(documents):
    return documents.select(text.detect_content_type(text.sanitize_name(F.concat(F.lit("a\\b/"), "original_name")), F.lit(None).cast("string")).alias("content_type")).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


_DECIDED = "SELECT entity_id * 3 AS id, arg_max(decision, created_at) AS decision, arg_max(note, created_at) AS note, arg_max(actor_id, created_at) AS actor_id FROM (SELECT *, CASE action WHEN 'posted' THEN 'approve' WHEN 'failed' THEN 'reject' WHEN 'login' THEN 'confirm' ELSE 'reprocess' END AS decision, CASE WHEN id % 2 = 0 THEN 'x' ELSE ' ' END AS note FROM audit) a GROUP BY 1"


@query(
    "f25_apply_decisions",
    f"SELECT id, decision, actor_id, status AS old_status, CASE WHEN refused IS NOT NULL THEN status WHEN decision IN ('confirm','approve') THEN 'confirmed' WHEN decision = 'reject' THEN 'rejected' ELSE 'received' END AS new_status, CASE WHEN refused IS NULL AND decision IN ('confirm','approve') THEN 'create' END AS job_kind, CASE WHEN refused IS NULL THEN decision END AS audit_action, refused FROM (SELECT e.*, d.status, CASE decision WHEN 'confirm' THEN CASE WHEN status = 'exported' THEN 'already exported' WHEN status IN ('received','processing','failed') THEN 'not recognised' END WHEN 'approve' THEN CASE WHEN status NOT IN ('needs_approval','rejected') THEN 'nothing to approve' END WHEN 'reject' THEN CASE WHEN trim(note) = '' THEN 'a note is needed' WHEN status <> 'needs_approval' THEN 'nothing to reject' END ELSE CASE WHEN status = 'exported' THEN 'already exported' END END AS refused FROM ({_DECIDED}) e JOIN store_documents d ON d.id = e.id) x",
    "store_documents", "audit",
)
def f25(documents, audit):
    a = F.col("action")
    decision = F.when(a == "posted", "approve").when(a == "failed", "reject").when(a == "login", "confirm").otherwise("reprocess")
    decisions = audit.select((F.col("entity_id") * 3).alias("document_id"), decision.alias("decision"), F.when(F.col("id") % 2 == 0, "x").otherwise(" ").alias("note"), "actor_id", F.col("created_at").alias("decided_at"))
    return store.apply_decisions(documents, decisions)


@query("f26_upload_company", f"SELECT CASE WHEN reason IS NULL THEN w END AS company_id, reason AS refused, {N} AS n FROM (SELECT w, CASE WHEN w IS NULL THEN NULL WHEN a IS NULL THEN 'unknown company' WHEN NOT a THEN 'inactive company' WHEN (own IS NOT NULL AND w <> own AND role <> 'admin') OR (role = 'client' AND own IS NULL) THEN 'no right to this company' END AS reason FROM (SELECT u.role, u.company_id AS own, coalesce(d.want, u.company_id) AS w, c.is_active AS a FROM (SELECT id, owner_id, CASE WHEN id % 3 = 0 THEN id % 27 END AS want FROM store_documents) d LEFT JOIN users u ON u.id = d.owner_id LEFT JOIN companies c ON c.id = coalesce(d.want, u.company_id)) y) x GROUP BY 1, 2", "store_documents", "users", "companies")
def f26(documents, users, companies):
    uploads = documents.select("id", F.col("owner_id").alias("user_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 27).alias("company_id"))
    return store.resolve_upload_company(uploads, users, companies).groupBy("company_id", "refused").agg(F.count(F.lit(1)).alias("n"))


@query("f27_backfill_archive", "SELECT id, CAST(epoch(CASE WHEN onec_status = 'posted' AND archived_at IS NULL THEN coalesce(onec_updated_at, updated_at) ELSE archived_at END) AS BIGINT) AS archived FROM store_documents", "store_documents")
def f27(documents):
    return store.backfill_archive(documents).select("id", F.unix_timestamp("archived_at").alias("archived"))


@query("j1_with_company", f"SELECT coalesce(c.name, '') AS company_name, {N} AS n FROM store_documents d LEFT JOIN companies c ON c.id = d.company_id GROUP BY 1", "store_documents", "companies")
def j1(documents, companies):
    return store.with_company(documents, companies).groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))


@query("j5_export_batch", f"SELECT j.id AS job_id, j.kind, d.status AS document_status, coalesce(c.name, '') AS company_name, CASE WHEN d.id IS NULL THEN 'document not found' END AS error FROM export_jobs j LEFT JOIN store_documents d ON d.id = j.document_id LEFT JOIN companies c ON c.id = d.company_id WHERE j.status = 'pending' AND j.next_attempt_at <= {TS}", "export_jobs", "store_documents", "companies")
def j5(jobs, documents, companies):
    return store.export_batch(jobs, documents, companies, as_of()).select("job_id", "kind", "document_status", "company_name", "error")


@query("j6_company_accountants", "SELECT u.id AS user_id, u.login, u.is_active FROM company_accountants l JOIN users u ON u.id = l.user_id WHERE l.company_id = 3", "users", "company_accountants")
def j6(users, links):
    return store.company_accountants(users, links, 3)


@query("j7_classify_by_anchors", "SELECT doc_id, CASE WHEN b = 0 THEN 'unknown' WHEN s1 = b THEN 'invoice' WHEN s2 = b THEN 'act' WHEN s3 = b THEN 'waybill' ELSE 'contract' END AS doc_type, least(b, 1.0) AS confidence FROM (SELECT *, greatest(s1, s2, s3, s4) AS b FROM (SELECT doc_id, CAST(0.5 AS DOUBLE) * CAST(contains(t, 'th') AS INT) AS s1, CAST(0.3 AS DOUBLE) * CAST(contains(t, 'ing the') AS INT) AS s2, CAST(0.4 AS DOUBLE) * (CAST(contains(t, 'de la') AS INT) + CAST(contains(t, 'le ') AS INT)) AS s3, CAST(0.5 AS DOUBLE) * (CAST(contains(t, 'und ') AS INT) + CAST(contains(t, 'der') AS INT)) AS s4 FROM (SELECT doc_id, lower(text) AS t FROM documents) y) x) z", "documents")
def j7(documents):
    return catalog.classify_by_anchors(documents, SPECS)


RULES = [
    {"account": "10.1", "match": ["ring", "bolt"]},
    {"account": "26", "match": ["widget"], "doc_types": ["invoice"]},
    {"account": "44", "match": ["widget", "red"]},
]
_ACCOUNT = "CASE WHEN name LIKE '%ring%' OR name LIKE '%bolt%' THEN '10.1' WHEN name LIKE '%widget%' AND doc_id % 2 = 0 THEN '26' WHEN name LIKE '%widget%' OR name LIKE '%red%' THEN '44' END"


def _typed(items: DataFrame) -> DataFrame:
    return items.withColumn("doc_type", F.when(F.col("doc_id") % 2 == 0, "invoice").otherwise("act"))


@query("j8_account_for_lines", f"SELECT {_ACCOUNT} AS account, {N} AS n, CAST(sum(amount) AS BIGINT) AS amount FROM lines GROUP BY 1", "lines")
def j8(items):
    return catalog.account_for_lines(_typed(items), RULES).groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("a11_document_account", f"SELECT doc_id, account FROM (SELECT doc_id, account, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, account) AS r FROM (SELECT doc_id, {_ACCOUNT} AS account FROM lines) y WHERE account IS NOT NULL GROUP BY 1, 2) x WHERE r = 1", "lines")
def a11(items):
    return catalog.document_account(catalog.account_for_lines(_typed(items), RULES))


_COMPARED = """SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, coalesce(e.key, a.key) AS key, e.value AS expected, a.value AS actual,
    CASE WHEN e.key IS NULL THEN 'unexpected' WHEN e.value IS NULL THEN CASE WHEN trim(coalesce(a.value, '')) = '' THEN 'skipped' ELSE 'extra' END
    WHEN trim(coalesce(a.value, '')) = '' THEN CASE WHEN trim(e.value) = '' THEN 'matched' ELSE 'missing' END WHEN trim(a.value) = trim(e.value) THEN 'matched' ELSE 'mismatch' END AS outcome
    FROM expected e FULL OUTER JOIN actual a ON a.doc_id = e.doc_id AND a.key = e.key"""
_C = "CAST(count(*) FILTER (WHERE outcome = '{0}') AS BIGINT) AS \"{0}\""
_CS = "CAST(count(*) FILTER (WHERE outcome IN ('matched','missing','mismatch')) AS BIGINT) AS validated, " + ", ".join(_C.format(o) for o in ("matched", "missing", "mismatch", "extra", "unexpected"))
_PCT = "CASE WHEN validated > 0 THEN round(100.0 * matched / validated, 2) ELSE 0.0 END"


@query("j11_compare_golden", f"SELECT outcome, key, {N} AS n FROM ({_COMPARED}) c GROUP BY 1, 2", "expected", "actual")
def j11(expected, actual):
    return accuracy.compare_golden(expected, actual).groupBy("outcome", "key").agg(F.count(F.lit(1)).alias("n"))


_DOC = f"SELECT *, CAST({_PCT} AS DOUBLE) AS accuracy FROM (SELECT doc_id, {_CS}, coalesce(string_agg(CASE WHEN outcome IN ('missing','mismatch') THEN key END, ',' ORDER BY key), '') AS wrong_keys FROM ({_COMPARED}) c GROUP BY 1) d"


@query("a3_document_accuracy", _DOC, "expected", "actual")
def a3(expected, actual):
    return accuracy.document_accuracy(accuracy.compare_golden(expected, actual))


@query("a4_golden_totals", f"SELECT *, CAST({_PCT} AS DOUBLE) AS field_accuracy FROM (SELECT {N} AS documents, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("validated", "matched", "missing", "mismatch", "extra", "unexpected")) + f", round(avg(CASE WHEN validated > 0 THEN accuracy END), 2) AS mean_accuracy FROM ({_DOC}) x) y", "expected", "actual")
def a4(expected, actual):
    return accuracy.golden_totals(accuracy.compare_golden(expected, actual))


_FIELD = f"SELECT *, missing + mismatch AS errors, CAST({_PCT} AS DOUBLE) AS accuracy FROM (SELECT key, {_CS} FROM ({_COMPARED}) c GROUP BY 1) d"


@query("a5_golden_field_report", _FIELD, "expected", "actual")
def a5(expected, actual):
    return accuracy.golden_field_report(accuracy.compare_golden(expected, actual))


@query("k2_worst_documents", f"SELECT doc_id, accuracy, validated FROM ({_DOC}) x WHERE validated > 0 ORDER BY accuracy, validated DESC, doc_id LIMIT 15", "expected", "actual")
def k2(expected, actual):
    return accuracy.worst_documents(accuracy.document_accuracy(accuracy.compare_golden(expected, actual))).select("doc_id", "accuracy", "validated")


_NORM = "replace(regexp_replace(lower({}), '[ \\t\\n\\r \"«»''`]', '', 'g'), ',', '.')"
_SAME = f"CASE WHEN key = 'total' THEN TRY_CAST(trim(got) AS DECIMAL(18,4)) = TRY_CAST(trim(want) AS DECIMAL(18,4)) ELSE {_NORM.format('got')} = {_NORM.format('want')} END"


@query("a1_field_accuracy", f"SELECT *, CAST(round(100.0 * correct / total, 2) AS DOUBLE) AS pct FROM (SELECT key, {N} AS total, CAST(count(*) FILTER (WHERE g AND NOT b) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE NOT g AND NOT b) AS BIGINT) AS wrong, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS missed FROM (SELECT key, trim(coalesce(got, '')) = '' AS b, coalesce({_SAME}, false) AS g FROM (SELECT e.key, e.value AS want, a.value AS got FROM expected e LEFT JOIN actual a ON a.doc_id = e.doc_id AND a.key = e.key WHERE e.value IS NOT NULL) y) x GROUP BY ROLLUP (key)) z", "expected", "actual")
def a1(expected, actual):
    return accuracy.field_accuracy(expected, actual)


_EFF = _TYPE.replace("doc_type", "{0}")
_TYPES = "SELECT e.doc_id, lower(trim(e.value)) AS want, lower(trim(a.value)) AS got FROM expected e LEFT JOIN actual a ON a.doc_id = e.doc_id AND a.key = 'doc_type' WHERE e.key = 'doc_type' AND e.value IS NOT NULL"


@query("a2_doc_type_accuracy", f"SELECT *, CAST(round(100.0 * exact / total, 2) AS DOUBLE) AS exact_pct, CAST(round(100.0 * business / total, 2) AS DOUBLE) AS business_pct FROM (SELECT {N} AS total, CAST(count(*) FILTER (WHERE got = want) AS BIGINT) AS exact, CAST(count(*) FILTER (WHERE {_EFF.format('got')} = {_EFF.format('want')}) AS BIGINT) AS business FROM ({_TYPES}) t) x", "expected", "actual")
def a2(expected, actual):
    return accuracy.doc_type_accuracy(expected, actual)


@query("a8_category_accuracy", f"SELECT category, {N} AS total, CAST(count(*) FILTER (WHERE found = category) AS BIGINT) AS matched FROM (SELECT {_EFF.format('want')} AS category, {_EFF.format('got')} AS found FROM ({_TYPES}) t) x GROUP BY category UNION ALL SELECT NULL, {N}, CAST(count(*) FILTER (WHERE {_EFF.format('got')} = {_EFF.format('want')}) AS BIGINT) FROM ({_TYPES}) t", "expected", "actual")
def a8(expected, actual):
    return accuracy.category_accuracy(expected, actual)


@query("a6_status_and_source_counts", f"SELECT 'status' AS kind, status AS value, {N} AS n FROM store_documents GROUP BY 2 UNION ALL SELECT 'extension', CASE id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' ELSE '' END, {N} FROM store_documents GROUP BY 2", "store_documents")
def a6(documents):
    return accuracy.status_and_source_counts(documents)


@query("a7_unexpected_field_counts", f"SELECT key, {N} AS n FROM ({_COMPARED}) c WHERE outcome = 'unexpected' GROUP BY 1", "expected", "actual")
def a7(expected, actual):
    return accuracy.unexpected_field_counts(accuracy.compare_golden(expected, actual))


@query("j10_fields_diff", "SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, coalesce(e.key, a.key) AS key, e.value AS before, a.value AS after FROM expected e FULL OUTER JOIN actual a ON a.doc_id = e.doc_id AND a.key = e.key WHERE e.value IS DISTINCT FROM a.value", "expected", "actual")
def j10(expected, actual):
    return accuracy.fields_diff(expected, actual)


@query("u3_unexpected_keys", "SELECT DISTINCT key FROM actual WHERE key NOT IN (SELECT DISTINCT key FROM expected)", "expected", "actual")
def u3(expected, actual):
    return accuracy.unexpected_keys(actual, expected)


@query("u4_common_fields", f"SELECT key, {N} AS n FROM (SELECT doc_id, key, {_NORM.format('value')} AS value FROM expected WHERE trim(value) <> '' INTERSECT SELECT doc_id, key, {_NORM.format('value')} FROM actual) x GROUP BY 1", "expected", "actual")
def u4(expected, actual):
    return accuracy.common_fields(expected, actual).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_CORE = "lower(regexp_replace(regexp_replace(name, '(?i)(общество с ограниченной ответственностью|ооо|частное унитарное предприятие|оао)', ''), '[^\\p{L}\\p{Nd}]', '', 'g'))"
_SEEDS = f"SELECT coalesce(c.company_id, -1) AS company_key, c.unp, trim(c.name) AS name, {N} AS n FROM counterparty_names c LEFT JOIN companies o ON o.id = coalesce(c.company_id, -1) WHERE c.status = 'exported' AND length(c.unp) = 9 AND trim(c.name) <> '' AND c.unp IS DISTINCT FROM o.unp GROUP BY 1, 2, 3"


@query("a9_seed_counterparties", f"SELECT company_key, unp, name, coalesce((SELECT string_agg(s.name, '|' ORDER BY s.name) FROM ({_SEEDS}) s WHERE s.company_key = b.company_key AND s.unp = b.unp AND s.name <> b.name), '') AS synonyms FROM (SELECT *, row_number() OVER (PARTITION BY company_key, unp ORDER BY n DESC, name) AS r FROM ({_SEEDS}) x) b WHERE r = 1", "counterparty_names", "companies")
def a9(names, companies):
    return store.seed_counterparties(names, companies).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("j2_counterparty_by_tax_id", f"SELECT d.doc_id, b.name AS canonical FROM counterparty_names d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY company_key, unp ORDER BY n DESC, name) AS r FROM ({_SEEDS}) x) b ON b.r = 1 AND b.company_key = coalesce(d.company_id, -1) AND b.unp = d.unp", "counterparty_names", "companies")
def j2(names, companies):
    return store.counterparty_by_tax_id(names, store.seed_counterparties(names, companies)).select("doc_id", "canonical")


_KEYS = f"SELECT DISTINCT company_key, unp, name, {_CORE} AS k FROM ({_SEEDS}) s"


@query(
    "j3_counterparty_by_name",
    f"SELECT doc_id, min(unp) AS unp FROM (SELECT DISTINCT d.doc_id, e.unp FROM (SELECT doc_id, coalesce(company_id, -1) AS company_key, {_CORE} AS k FROM counterparty_names) d JOIN ({_KEYS}) e ON e.company_key = d.company_key AND d.k <> '' AND e.k <> '' AND (e.k = d.k OR (least(length(d.k), length(e.k)) >= 6 AND (contains(d.k, e.k) OR contains(e.k, d.k))))) m GROUP BY 1 HAVING count(*) = 1",
    "counterparty_names", "companies",
)
def j3(names, companies):
    return store.counterparty_by_name(names, store.seed_counterparties(names, companies)).select("doc_id", "unp")


@query("c16_party_keys", f"SELECT doc_id, {_CORE} AS k FROM counterparty_names", "counterparty_names")
def c16(names):
    return names.select("doc_id", parties.party_key(F.col("name")).alias("k"))


@query("a12_lines_total_mismatch", "SELECT t.doc_id, coalesce(n > 0 AND total > 0 AND abs(s - total) * 100 > total, false) AS mismatch FROM totals t LEFT JOIN (SELECT doc_id, count(*) AS n, sum(amount) AS s FROM lines GROUP BY 1) l ON l.doc_id = t.doc_id", "lines", "totals")
def a12(items, totals):
    return lines.lines_total_mismatch(items, totals)


@query("a13_lines_sum_agrees", "SELECT t.doc_id, CASE WHEN s IS NULL OR total = 0 THEN 0 WHEN abs(s - total) * 100 <= greatest(200, total) THEN 1 ELSE -1 END AS agrees FROM totals t LEFT JOIN (SELECT doc_id, sum(amount) AS s FROM lines GROUP BY 1) l ON l.doc_id = t.doc_id", "lines", "totals")
def a13(items, totals):
    return lines.lines_sum_agrees(items, totals)


@query("a14_lines_confirm_total", "SELECT t.doc_id, coalesce(abs(s - total) <= 2, false) AS confirmed FROM totals t LEFT JOIN (SELECT doc_id, sum(amount) AS s FROM lines GROUP BY 1) l ON l.doc_id = t.doc_id", "lines", "totals")
def a14(items, totals):
    return lines.lines_confirm_total(items, totals)


@query("t1_lines_from_text", "SELECT doc_id, name, CAST(qty AS STRING) AS qty, price, amount, 'шт' AS unit FROM lines", "lines", "totals")
def t1(items, totals):
    found = lines.lines_from_text(lines.render_invoices(items, totals))
    return found.select("doc_id", "name", "qty", money.cents(F.col("price")).alias("price"), money.cents(F.col("amount")).alias("amount"), "unit")


@query("r1_required_missing", f"SELECT missing, {N} AS n FROM (SELECT id, CASE WHEN doc_type = 'act' THEN concat_ws(',', CASE WHEN id % 5 = 0 THEN 'date' END, 'total') WHEN doc_type = 'invoice' THEN concat_ws(',', CASE WHEN id % 5 = 0 THEN 'date' END, 'total', 'unp') WHEN doc_type = 'waybill' THEN concat_ws(',', CASE WHEN id % 5 = 0 THEN 'date' END, 'unp') WHEN doc_type = 'contract' THEN concat_ws(',', 'counterparty', CASE WHEN id % 5 = 0 THEN 'date' END) ELSE concat_ws(',', CASE WHEN id % 5 = 0 THEN 'date' END, 'total') END AS missing FROM store_documents) x GROUP BY 1", "store_documents")
def r1(documents):
    docs = documents.select(F.col("id").alias("doc_id"), "doc_type")
    number = docs.select("doc_id", F.lit("number").alias("key"), F.lit("1").alias("value"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("source"))
    date = docs.select("doc_id", F.lit("date").alias("key"), F.lit("01.01.2020").alias("value"), F.when(F.col("doc_id") % 5 == 0, 0.4).otherwise(0.5).alias("confidence"), F.lit("rule").alias("source"))
    found = catalog.missing_required(docs, number.union(date), catalog.required_fields(_specs(docs)))
    return found.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@query("r6_fill_amounts", "SELECT doc_id, coalesce(n, total - v) AS net, coalesce(v, CASE WHEN total >= n THEN total - n END) AS vat, total FROM (SELECT doc_id, total, CASE WHEN doc_id % 3 = 0 THEN total - total // 6 END AS n, CASE WHEN doc_id % 3 = 1 THEN total // 6 END AS v FROM totals) x", "totals")
def r6(totals):
    sixth = F.floor(F.col("total") / 6).cast("bigint")
    return lines.fill_amounts(totals.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("total") - sixth).alias("net"), F.when(F.col("doc_id") % 3 == 1, sixth).alias("vat"), "total"))


@query("r11_arithmetic_agrees", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 5 <= 2 THEN 1 ELSE -1 END AS agrees FROM totals", "totals")
def r11(totals):
    sixth = F.floor(F.col("total") / 6).cast("bigint")
    vat = F.when(F.col("doc_id") % 4 > 0, sixth + F.col("doc_id") % 5)
    return lines.arithmetic_agrees(totals.select("doc_id", (F.col("total") - sixth).alias("net"), vat.alias("vat"), "total"))


@query("w18_split_pages", "SELECT conv_id AS doc_id, part, min(turn) AS first_page, max(turn) AS last_page, min(t) AS doc_type FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM t THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), first_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN (conv_id + turn // 3) % 2 = 0 THEN 'act' ELSE 'invoice' END AS k FROM conversations) a) b WHERE t IS NOT NULL AND n BETWEEN 2 AND 40) c) d GROUP BY 1, 2 QUALIFY max(part) OVER (PARTITION BY conv_id) >= 2", "conversations")
def w18(conversations):
    kind = F.when(F.col("turn") % 3 == 0, "unknown").when((F.col("conv_id") + F.floor(F.col("turn") / 3)) % 2 == 0, "act").otherwise("invoice")
    return lines.split_pages_by_type(conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), kind.alias("page_type")))


@query("w27_status_changes", "SELECT doc_id, seq, before, status FROM (SELECT doc_id, event_id AS seq, status, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS before FROM feedback) x WHERE before IS NOT NULL AND before <> status AND status IN ('posted','error')", "feedback")
def w27(feedback):
    return store.status_changes(feedback.withColumnRenamed("event_id", "seq"), ("posted", "error"))


@query("w1_text_lines", f"SELECT doc_id, {N} AS n, CAST(sum(length(l) * (CASE WHEN l = '' THEN 0 ELSE 1 END)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) x GROUP BY 1", "documents")
def w1(documents):
    return lines.text_lines(documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a24_tax_ids", "SELECT doc_id, array_to_string(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 9)), ',') AS ids FROM documents WHERE length(array_to_string(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 9), ',')) = 9", "documents")
def a24(documents):
    found = documents.select("doc_id", text.tax_ids_in(F.col("text")).alias("ids"), F.size(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) == 9)).alias("n"))
    return found.where("n = 1").select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("c1_norm_for_search", f"SELECT doc_id, md5({_NORM.format('text')}) AS h FROM documents", "documents")
def c1(documents):
    return documents.select("doc_id", F.md5(text.norm_for_search(F.col("text"))).alias("h"))


@query("c2_normalize_key", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')) AS h FROM documents", "documents")
def c2(documents):
    return documents.select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("h"))


@query("c7_money_round_trip", "SELECT doc_id, total FROM totals", "totals")
def c7(totals):
    return totals.select("doc_id", money.cents(money.format_cents(F.col("total"))).alias("total"))


@query("c27_export_backoff", "SELECT id, CAST(least(30 * power(2, attempts), 1800) AS BIGINT) AS wait FROM export_jobs", "export_jobs")
def c27(jobs):
    return jobs.select("id", money.export_backoff(F.col("attempts")).alias("wait"))


@query("a23_store_integrity", f"SELECT 'documents' AS table_name, {N} AS n FROM store_documents UNION ALL SELECT 'users', {N} FROM users UNION ALL SELECT 'jobs', {N} FROM export_jobs", "store_documents", "users", "export_jobs")
def a23(documents, users, jobs):
    return store.store_integrity({"documents": documents, "users": users, "jobs": jobs})


@query("a25_duplicate_uploads", f"SELECT company_id, sha256, {N} AS n, min(id) AS first_id FROM store_documents GROUP BY 1, 2 HAVING count(*) > 1", "store_documents")
def a25(documents):
    return store.duplicate_uploads(documents)


@query("a27_active_admins", f"SELECT {N} AS n FROM users WHERE role = 'admin' AND is_active AND id <> 40", "users")
def a27(users):
    return store.count_active_admins(users, 40)


@query("a28_device_tokens", "SELECT token, user_id, platform FROM (SELECT token, user_id, platform, row_number() OVER (PARTITION BY token ORDER BY ts DESC, user_id DESC) AS r FROM (SELECT concat('t', CAST(user_id % 50 AS STRING)) AS token, user_id, status AS platform, ts FROM feedback JOIN (SELECT event_id AS e, doc_id AS user_id FROM feedback) u ON e = event_id) x) y WHERE r = 1 AND token <> 't7'", "feedback")
def a28(feedback):
    tokens = feedback.select(F.concat(F.lit("t"), (F.col("doc_id") % 50).cast("string")).alias("token"), F.col("doc_id").alias("user_id"), F.col("status").alias("platform"), "ts", "event_id")
    removed = tokens.select("token").where("token = 't7'").distinct()
    return store.upsert_device_tokens(tokens.where("event_id % 2 = 0").drop("event_id"), tokens.where("event_id % 2 = 1").drop("event_id"), removed)


@query("k1_latest_audit", "SELECT id, action FROM audit ORDER BY created_at DESC, id DESC LIMIT 100", "audit")
def k1(audit):
    return store.latest_audit(audit, 0).select("id", "action")


@query("k4_list_companies", "SELECT id, name FROM companies WHERE id IN (3, 5, 8)", "companies")
def k4(companies):
    return store.list_companies(companies, [3, 5, 8]).select("id", "name")


@query("j21_orphan_jobs", "SELECT id FROM export_jobs WHERE document_id NOT IN (SELECT id FROM store_documents)", "export_jobs", "store_documents")
def j21(jobs, documents):
    return store.orphans(jobs, "document_id", documents, "id").select("id")


@query("st3_feedback", "SELECT doc_id, status FROM (SELECT doc_id, status, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS r FROM feedback WHERE status IN ('accepted','posted','rejected','error')) x WHERE r = 1", "feedback")
def st3(feedback):
    return flows.latest_feedback(feedback).select("doc_id", "status")


@query("st4_archive", "SELECT doc_id, CAST(epoch_us(min(ts)) AS BIGINT) AS archived_us FROM feedback WHERE status = 'posted' GROUP BY 1", "feedback")
def st4(feedback):
    return flows.first_closing(feedback).select("doc_id", F.unix_micros(F.col("archived_at").cast("timestamp")).alias("archived_us"))


@query("st9_event_windows", f"SELECT actor_id, action, CAST(epoch(time_bucket(INTERVAL '1 hour', created_at)) AS BIGINT) AS start, {N} AS n FROM audit GROUP BY 1, 2, 3", "audit")
def st9(audit):
    return flows.event_windows(audit, "1 hour").select("actor_id", "action", F.unix_timestamp("window.start").alias("start"), "n")


@query("st9_event_sessions", f"SELECT actor_id, {N} AS n, CAST(epoch_us(min(created_at)) AS BIGINT) AS start_us FROM (SELECT *, sum(new) OVER (PARTITION BY actor_id ORDER BY created_at) AS s FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY actor_id ORDER BY created_at) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM audit) a) b GROUP BY actor_id, s", "audit")
def st9s(audit):
    return flows.event_sessions(audit, "6 hours").select("actor_id", "n", F.unix_micros(F.col("session.start").cast("timestamp")).alias("start_us"))


@query("st2_export_attempts", f"SELECT status, attempts, {N} AS n FROM (SELECT doc_id, CASE WHEN done > 0 THEN 'done' WHEN failed >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(least(failed, 5) AS BIGINT) AS attempts FROM (SELECT doc_id, count(*) FILTER (WHERE status = 'posted') AS done, count(*) FILTER (WHERE status = 'error' AND ts <= coalesce(first_done, ts)) AS failed FROM (SELECT *, min(CASE WHEN status = 'posted' THEN ts END) OVER (PARTITION BY doc_id) AS first_done FROM feedback) y GROUP BY 1) x) z GROUP BY 1, 2", "feedback")
def st2(feedback):
    return flows.export_attempts(feedback).groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query("st6_retention_purge", f"SELECT kept, purged FROM (SELECT CAST(count(*) FILTER (WHERE NOT p) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE p) AS BIGINT) AS purged FROM (SELECT coalesce(archived_at < {TS} - INTERVAL '504' HOUR, false) AS p FROM store_documents) x) y", "store_documents")
def st6(documents):
    kept, audit = flows.retention_purge(documents, 21, as_of())
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(audit.agg(F.count(F.lit(1)).alias("purged")))


@query("w3_rows_by_top", "SELECT doc_id, seq, CAST(line_no - 1 AS INT) AS row_no FROM (SELECT doc_id, seq, seq // 10 AS line_no FROM words) w", "words")
def w3(words):
    return geometry.rows_by_top(words).select("doc_id", "seq", "row_no")


@query("w2_group_words", "SELECT doc_id, seq, CAST(seq // 10 - 1 AS INT) AS row_no FROM words", "words")
def w2(words):
    return geometry.group_words_into_rows(words).select("doc_id", "seq", "row_no")


@query("w4_layout_text", "SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY line_no)) AS layout FROM (SELECT doc_id, seq // 10 AS line_no, string_agg(text, ' | ' ORDER BY seq) AS l FROM words GROUP BY 1, 2) x GROUP BY 1", "words")
def w4(words):
    rows = words.withColumn("row_no", F.floor(F.col("seq") / 10).cast("int"))
    return geometry.layout_text(rows).select("doc_id", F.md5("layout").alias("layout"))


_BANDS = "SELECT doc_id, CAST(band AS INT) AS band, coalesce((lag(b) OVER (PARTITION BY doc_id ORDER BY band) + a) / 2, a - 10) AS lo, coalesce((lead(a) OVER (PARTITION BY doc_id ORDER BY band) + b) / 2, b + 10) AS hi FROM (SELECT doc_id, seq % 10 AS band, min(x0) AS a, max(x1) AS b FROM words GROUP BY 1, 2) x"


@query("w6_column_bands", _BANDS, "words")
def w6(words):
    return geometry.column_bands(words).select("doc_id", "band", "lo", "hi")


@query("j13_words_to_bands", "SELECT doc_id, seq, CAST(seq % 10 AS INT) AS band FROM words", "words")
def j13(words):
    return geometry.words_to_bands(words, geometry.column_bands(words)).select("doc_id", "seq", "band")


@query("j12_words_in_boxes", "SELECT doc_id, CAST(seq // 10 AS INT) AS box, string_agg(text, ' ' ORDER BY y0, x0) AS text FROM words WHERE seq % 10 < 2 GROUP BY 1, 2", "words")
def j12(words):
    boxes = words.where("seq % 10 = 0").select("doc_id", "page_no", F.floor(F.col("seq") / 10).cast("int").alias("box"), F.lit(0.0).alias("x0"), F.col("y0"), F.lit(400.0).alias("x1"), (F.col("y0") + 25).alias("y1"))
    return geometry.words_in_boxes(words, boxes).select("doc_id", "box", "text")


@query("a18_page_metrics", "SELECT doc_id, CAST(20 AS DOUBLE) AS height, CAST(10 AS DOUBLE) AS char_width FROM words GROUP BY 1", "words")
def a18(words):
    return geometry.page_metrics(words).select("doc_id", "height", "char_width")


_SKEW = "SELECT doc_id, seq, x0, y0 + x0 * 0.03 AS y0, y1 - y0 AS h, y0 + x0 * 0.03 - min(y0 + x0 * 0.03) OVER (PARTITION BY doc_id) AS down FROM words"
_PAIRS = """
    SELECT a.doc_id, a.b AS band_no, (c.y0 - a.y0) / (c.x0 - a.x0) AS slope
    FROM (SELECT *, unnest(range(greatest(0, ceil(down / 160 - 1.5))::BIGINT, least(floor(down / 160 + 0.5), bottom)::BIGINT + 1)) AS b FROM (SELECT *, floor(max(down) OVER (PARTITION BY doc_id) / 160) AS bottom FROM w) t) a
    JOIN (SELECT *, unnest(range(greatest(0, ceil(down / 160 - 1.5))::BIGINT, least(floor(down / 160 + 0.5), bottom)::BIGINT + 1)) AS b FROM (SELECT *, floor(max(down) OVER (PARTITION BY doc_id) / 160) AS bottom FROM w) t) c
    ON c.doc_id = a.doc_id AND c.b = a.b AND c.seq > a.seq AND c.x0 - a.x0 BETWEEN 150 AND 2000 AND abs(c.y0 - a.y0) <= 1.2 * a.h"""


def _skewed(words: DataFrame) -> DataFrame:
    return words.withColumn("y0", F.col("y0") + F.col("x0") * 0.03).withColumn("y1", F.col("y1") + F.col("x0") * 0.03)


@query("w12_deskew", f"""
    SELECT * FROM (WITH w AS ({_SKEW}), k AS (SELECT doc_id, band_no, count(*) AS n, list_sort(list(slope))[count(*) // 2 + 1] AS k FROM ({_PAIRS}) p GROUP BY 1, 2)
    SELECT w.doc_id, seq, round(y0 - coalesce(k, 0) * x0, 4) AS y0 FROM w LEFT JOIN k ON k.doc_id = w.doc_id AND band_no = floor(down / 160) AND n >= 12 AND abs(k) BETWEEN 0.020 AND 0.05) x""", "words")  # fmt: skip
def w12(words):
    return geometry.deskew(_skewed(words)).select("doc_id", "seq", F.round("y0", 4).alias("y0"))


@query("j17_slope_pairs", f"SELECT * FROM (WITH w AS ({_SKEW}) SELECT doc_id, CAST(band_no AS INT) AS band_no, count(*) AS n, round(sum(slope), 6) AS slopes FROM ({_PAIRS}) p GROUP BY 1, 2) x", "words")
def j17(words):
    return geometry.word_slope_pairs(_skewed(words)).groupBy("doc_id", "band_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("slope"), 6).alias("slopes"))


_CELLS = "SELECT doc_id, seq // 10 AS row_no, max(CASE WHEN seq % 10 = 0 THEN text END) AS a, max(CASE WHEN seq % 10 = 1 THEN text END) AS b FROM words WHERE seq % 10 < 2 GROUP BY 1, 2"


@query("a16_duplicate_rows", f"SELECT doc_id, row_no FROM (SELECT doc_id, row_no, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY row_no) AS n FROM ({_CELLS}) c) x WHERE n > 1", "words")
def a16(words):
    cells = words.where("seq % 10 < 2").select("doc_id", F.lit("grid").alias("source"), F.floor(F.col("seq") / 10).alias("row_no"), (F.col("seq") % 10).alias("col_no"), F.col("text").alias("value"))
    return geometry.duplicate_rows(cells).select("doc_id", "row_no")


def _invoice_pages(heads: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Счёт на оплату № "), "number", F.lit(" от "), "date", F.lit("\nПоставщик: "), "counterparty", F.lit(", УНП "), "unp", F.lit("\nПокупатель: покупатель, УНП "), "organization_unp",
        F.lit("\nОснование: договор № Д-5 от 01.02.1994\nВ том числе НДС 20%: 1,00\nВсего к оплате: "), money.format_cents(F.col("total")), F.lit(" "), "currency",
    )
    return heads.select("doc_id", text.alias("text"))


_HEADS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, {v} AS value FROM invoice_heads" for k, v in (("number", "number"), ("date", "date"), ("unp", "unp"), ("organization_unp", "organization_unp"), ("counterparty", "counterparty"), ("currency", "currency"), ("organization", "'покупатель'"), ("contract_number", "'Д-5'"), ("contract_date", "'01.02.1994'"), ("vat_amount", "'1.00'"), ("total", "concat(CAST(total // 100 AS STRING), '.', CASE WHEN total % 100 < 10 THEN '0' ELSE '' END, CAST(total % 100 AS STRING))")))


@query("e9_extract_fields", _HEADS, "invoice_heads")
def e9(heads):
    return extract.extract_fields(_invoice_pages(heads)).select("doc_id", "key", "value")


@query("r9_confidence", "SELECT key, CASE WHEN key = 'total' THEN 0.98 WHEN key = 'number' THEN 0.98 WHEN key IN ('date', 'unp', 'organization_unp') THEN 0.95 WHEN key IN ('counterparty', 'organization') THEN 0.85 WHEN key IN ('currency', 'vat_amount', 'contract_date') THEN CASE WHEN key = 'vat_amount' THEN 0.95 WHEN key = 'contract_date' THEN 0.4 ELSE 0.8 END ELSE 0.7 END AS confidence, CAST(count(*) AS BIGINT) AS n FROM (" + _HEADS + ") h GROUP BY 1, 2", "invoice_heads")
def r9(heads):
    pages = _invoice_pages(heads)
    fields = materialize(extract.extract_fields(pages), "confidence-fields")  # they are the rules' fields too
    docs = pages.select("doc_id", "text", F.col("text").alias("head"), F.lit("").alias("body"), F.lit(True).alias("zones_ok"))
    facts = heads.select("doc_id", F.lit(1).alias("arithmetic"), F.lit(1).alias("lines"), F.col("number").alias("header_number"))
    chart = heads.limit(0).select(F.col("number").alias("code"))
    rows = rules.confidence(fields, docs, fields, facts, chart)
    return rows.groupBy("key", F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices are rendered as text, read back as lines, checked against their totals and routed."""
    items, totals = projection(spark, sf_dir, "lines"), projection(spark, sf_dir, "totals")
    found = lines.lines_from_text(lines.render_invoices(items, totals)).select("doc_id", money.cents(F.col("amount")).alias("amount"))
    checked = lines.lines_total_mismatch(found, totals).join(totals, "doc_id")
    rows = catalog.export_routable(checked.withColumn("doc_type", F.lit("invoice")), _specs(checked))
    status = catalog.route_status(F.col("doc_type"), F.col("routable"), F.when(F.col("mismatch"), "lines").otherwise(""))
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


QUERIES["minimum_slice"] = minimum_slice
ORACLE_SQL["minimum_slice"] = oracle(f"SELECT CASE WHEN n > 0 AND t.total > 0 AND abs(s - t.total) * 100 > t.total THEN 'needs_input' ELSE 'confirmed' END AS status, {N} AS n, CAST(sum(t.total) AS BIGINT) AS total FROM totals t LEFT JOIN (SELECT doc_id, count(*) AS n, sum(amount) AS s FROM lines GROUP BY 1) l ON l.doc_id = t.doc_id GROUP BY 1")
