"""Near duplicates by SimHash: every pair of fingerprints within the radius, by tiled exact comparison.

Distinct fingerprints are cut into parts of equal width, and those with the same population counts of
all parts form a cell, a cell's fingerprints form tiles of bounded size. Two fingerprints that differ in r
bits have population counts that differ by r at most, summed over the parts; so a tile meets only tiles of
cells whose counts are that near, and every other pair of tiles is skipped unseen. Tiles that meet are
compared exactly, by exclusive-or and bit counts; what leaves a comparison is a spanning forest of its
links, and connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from . import bytesops as B
from .bpe import spread
from .common import look_up
from .components import connected_components

#: Fingerprints in a tile, about; 16 KB.
TILE = 2048
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16
#: Pairs of fingerprints that are compared at once.
PAIRS = 1 << 18
#: A finer cut into cells pays once there are this many fingerprints for each cell.
CELL = 16

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_shingles", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """XXH64 of every shingle, repeats included, and the number of its text, some tens of thousands at a time."""
    w = B.Words(data, offsets, lower=True)
    lens = w.end - w.start
    at = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)  # all words, one blank after each
    joined[spread(at, lens)] = w.data[spread(w.start, lens)]
    body = joined.tobytes()
    last = w.first + w.counts  # word numbers
    n = np.where(w.counts > 0, np.maximum(w.counts - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    begin = spread(w.first, n)
    stop = np.minimum(begin + size, last[text])
    a, b = at[begin], at[stop - 1] + lens[stop - 1]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(a), SHINGLES):
        some = zip(a[k : k + SHINGLES].tolist(), b[k : k + SHINGLES].tolist(), strict=True)
        yield np.array([digest(body[i:j], seed) for i, j in some], np.uint64), text[k : k + SHINGLES]


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of every text, and its number of shingles: a bit is 1 if over half of the hashes have it."""
    n = len(offsets) - 1
    ones, count = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for h, text in shingle_hashes(data, offsets, size, seed):
        starts = B.runs(text)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[text[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        count[text[starts]] += B.ends(starts, len(text)) - starts
    over = 2 * ones > count[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel(), count


def _print(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            fp, n = fingerprints(*B.utf8(batch.column("text")), size, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(n)], schema=PRINTS)

    return run


def parts_of(n: int) -> int:
    """How many parts to cut n fingerprints into: the most for which the usual cell holds CELL of them.

    It sets how finely the comparison is cut up, like a number of partitions; the links are the same.
    """
    parts = 1
    while parts < 16:
        # the counts of a part of w bits have a standard deviation of sqrt(w) / 2
        usual = (np.sqrt(2 * np.pi * np.e * 64 / (2 * parts)) / 2) ** (2 * parts)
        if n < CELL * usual:
            break
        parts *= 2
    return parts


def cell_of(fp: Column, parts: int) -> Column:
    """The population counts of all parts, side by side in one long."""
    width = 64 // parts
    mask = F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")
    fields = [F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(mask)).cast("long"), width * k if parts > 1 else 0) for k in range(parts)]
    out = fields[0]
    for f in fields[1:]:
        out = out.bitwiseOR(f)
    return out


def steps_between(parts: int, radius: int) -> list[int]:
    """What to add to a cell for every cell within the radius, each two cells once, the same cell (0) first.

    A step out of a part's range gives fields that no cell has.
    """
    width = 64 // parts if parts > 1 else 0
    out = [0]
    reach = [()]
    for _ in range(parts):
        reach = [(*r, d) for r, d in product(reach, range(-radius, radius + 1)) if sum(map(abs, r)) + abs(d) <= radius]
    for r in reach:
        first = next((d for d in r if d), 0)
        if first > 0:
            v = sum(d << (width * k) for k, d in enumerate(r))
            out.append((v + (1 << 63)) % (1 << 64) - (1 << 63))
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of all pairs that differ in ``radius`` bits or fewer."""
    x, y = x.view(np.uint64), y.view(np.uint64)  # signed numbers would be counted without their sign
    rows = max(1, PAIRS // max(1, len(y)))
    found = []
    for k in range(0, len(x), rows):
        i, j = np.nonzero(np.bitwise_count(x[k : k + rows, None] ^ y[None, :]) <= radius)
        found.append((i + k, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node and the smallest of its component, if that is another."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    on = root != np.arange(len(nodes))
    return nodes[root[on]], nodes[on]


def _compare(radius: int):
    """Two tiles in each row: the links between them, reduced to forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            x, y = left.flatten().to_numpy(), right.flatten().to_numpy()
            at_x, at_y = (np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy()))).tolist() for c in (left, right))
            a, b = [], []
            for k in range(batch.num_rows):
                p, q = x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]]
                i, j = near_pairs(p, q, radius)
                if len(i):
                    a.append(p[i])
                    b.append(q[j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                on = a != b
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(a[on], b[on])], schema=EDGES)

    return run


def near_edges(prints: DataFrame, n: int, radius: int, parts: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius, of ``n`` distinct ``fp``."""
    parts = parts or parts_of(n)
    cells = prints.select("fp", cell_of(F.col("fp"), parts).alias("cell"))
    sizes = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")), "simhash-cells")
    dealt = look_up(cells, sizes, "cell", "n", n).select("cell", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "fp")
    tiles = materialize(dealt.groupBy("cell", "block").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")  # about TILE each
    steps = F.array(*(F.lit(s) for s in steps_between(parts, radius)))
    left = tiles.select("block", F.col("fps").alias("x"), "cell", F.explode(steps).alias("step")).select(F.expr("try_add(cell, step)").alias("cell"), "step", F.col("block").alias("i"), "x")
    right = tiles.select("cell", F.col("block").alias("j"), F.col("fps").alias("y"))
    met = left.join(right.hint("merge"), "cell").where("step <> 0 or i <= j").select("x", "y")
    return met.mapInArrow(_compare(radius), "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a long), component_id (smallest id reachable by links, itself
    included), n_shingles.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text's shingles are all runs of ``size``
    words, repeats included, joined by a blank, or the whole sequence if it has fewer. Bit k of the
    fingerprint is 1 if over half of their XXH64 hashes have it. Texts without words, null ones too,
    have fingerprint 0. Two fingerprints link if they differ in ``radius`` bits or fewer.

    Rows without an id take part in links and get the component of their fingerprint, null if no row of
    it has an id; repeated ids are rows like others. A very long text is one unit of work in one task.
    An empty table gives an empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_print(size, seed), "doc_id bigint, fp bigint, n_shingles bigint"), "simhash-prints")
    known = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "simhash-distinct")
    n, total = known.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    edges = materialize(near_edges(known.select("fp"), n, radius).distinct(), "simhash-edges")
    components = materialize(connected_components(edges), "simhash-components")
    placed = known.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = materialize(placed, "simhash-placed")
    least = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    named = materialize(look_up(placed.select("component", "fp", "n_rows"), least, "component", "n", n).select("fp", "component_id", "n_rows"), "simhash-named")
    return look_up(prints, named, "fp", "n_rows", total or 0).select("doc_id", "fp", "component_id", "n_shingles")
