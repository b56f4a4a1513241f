"""What several operators need of the corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts_for(docs: DataFrame, text: str, part_bytes: int) -> int:
    """How many parts of about ``part_bytes`` the texts make, from a sum over all of them."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // part_bytes))


def ddl(schema: pa.Schema) -> str:
    """Spark's DDL of an Arrow schema of plain types."""
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def homes_for(docs: DataFrame, text: str, home_bytes: int) -> int:
    """A prime number of groups of about ``home_bytes`` of text each, 61 at least."""
    n = max(61, parts_for(docs, text, home_bytes)) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def home_of(doc_id: Column, homes: int) -> Column:
    """The group that a row's text waits in for what is found about it: its id modulo a prime, so
    that tasks can compute it from the id. Rows without an id are spread evenly."""
    return F.pmod(F.coalesce(doc_id, F.monotonically_increasing_id()), F.lit(homes)).cast("int")


#: A key is hot if more than one in HOT_SHARE rows have it; so fewer than HOT_SHARE keys are.
HOT_SHARE = 1000


def look_up(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has each key of them once, with the number of
    its rows in the column ``size``; ``total`` is the number of all rows.

    Values of hot keys, fewer than HOT_SHARE, are broadcast, so no task gets all rows of a key; the
    rest are joined by a shuffle in which no key has more than a thousandth of the rows. ``rows``
    and ``values`` are each read twice and should be materialized.
    """
    columns = [*rows.columns, *(c for c in values.columns if c != key)]
    marked = rows.join(F.broadcast(values.where(F.col(size) * HOT_SHARE > total)), key, "left")
    hot = marked.where(F.col(size).isNotNull()).select(columns)
    cold = marked.where(F.col(size).isNull()).select(rows.columns).join(values.where(F.col(size) * HOT_SHARE <= total).hint("merge"), key)
    return hot.unionByName(cold.select(columns))
