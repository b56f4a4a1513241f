"""Connected components of a large graph: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize
from .common import look_up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Each round is two aggregations and two joins over the edges; no list of neighbours is ever
    gathered. A node of very many edges is pre-aggregated by ``min`` before its rows are shuffled,
    and what hangs on it is looked up, not sent to one task.
    Rounds are written to the shared folder, so a lost executor repeats one round at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "cc-edges")
    before = _state(pairs)
    while True:
        # large star: the larger neighbours of a node hang on its smallest neighbour, or on the node
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        least = materialize(least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "degree"), "cc-least")
        large = look_up(pairs, least, "v", "degree", before[0]).select("u", F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = materialize(small.where("u <> v").distinct(), "cc-edges")
        now = _state(pairs)
        if now == before:
            break
        before = now
    members = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return members.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """A fingerprint of the set of edges."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first())
