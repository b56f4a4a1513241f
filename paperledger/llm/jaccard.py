"""Word n-gram Jaccard join by blocked sparse products of the document by n-gram incidence matrix.

1. Each text becomes a sorted set of shingle hashes. Texts with equal sets are one row of the
   matrix, represented by their smallest id.
2. Which rows are multiplied: two sets of similarity t or more differ in few shingles, at most D,
   a bound that follows from their sizes. Sets of neighbouring size classes are cut into more than
   D parts by hash, so at least one part agrees in full. The hashes of the parts meet, and each set
   is tied to the smallest document (the hub) of every meeting.
3. A hub and what is tied to it make blocks of bounded size. For each block the incidence matrix is
   multiplied with its transpose: shingles of many documents a slice of columns at a time, others
   entry by entry; overlaps accumulate, and pairs below the bound that their sizes give are
   discarded. A hub of several blocks stands in each, and the documents that their block doesn't
   connect with the hub are multiplied with all other blocks of that hub.
4. The links of a block are reduced to a spanning forest; connected components join the forests.
5. A link lies inside one component, so links are counted there: a component is packed into blocks,
   every two of which are multiplied, and the products' row sums are all that leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from . import bytesops as B
from .bpe import spread
from .common import ddl, look_up, parts_for
from .components import connected_components

#: Documents in a block besides its hub.
BLOCK_ROWS = 1024
#: Shingles in a slice of the product.
BLOCK_COLUMNS = 4096
#: Documents and shingles (of all of them) in a block in which links are counted.
COUNT_ROWS, COUNT_SHINGLES = 2048, 2_000_000
#: Pairs of entries that are added up together.
PAIRS = 1 << 21
#: Bytes of text whose part hashes one receiving group holds.
PART_BYTES = 48 << 20

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("parts", pa.binary())])
SENT = pa.schema([("part", pa.int32()), ("packed", pa.binary())])
TIES = pa.schema([("hub", pa.int64()), ("doc_id", pa.int64())])
LINKS = pa.schema([("hub", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("loose", pa.bool_())])
BLOCKS = pa.schema([("component", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("docs", pa.binary()), ("entries", pa.binary()), ("links", pa.binary())])
DEGREES = pa.schema([("rep", pa.int64()), ("n_links", pa.int64())])


class Similarity:
    """Jaccard similarity of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den or 2 * num <= den:
            raise ValueError("the similarity must be over one half and at most one")
        self.num, self.den = num, den

    def classes(self, most: int) -> np.ndarray:
        """Smallest sizes of the size classes: sets of one class or of neighbouring ones can link, others cannot."""
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num + 1))
        return np.array(out, np.int64)

    def differing(self, last: np.ndarray) -> np.ndarray:
        """How many shingles two linked sets can differ in, if the smaller has at most ``last``."""
        # sizes a <= b <= a*den/num; |difference| <= (a + b) * (den - num) / (den + num)
        b = last * self.den // self.num
        return (last + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * overlap >= self.num * (a + b - overlap)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and n + 1 offsets into them."""
    w = B.Words(data, offsets, lower=True)
    h, at = w.windows(size)
    text = w.text[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = B.rolling_words(w.hash).stretch(w.first[short], w.first[short] + w.counts[short])
        h, text = np.concatenate((h, whole)), np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    edges = np.searchsorted(text, np.arange(len(offsets)))
    sets = [np.unique(h[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else h), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def part_hashes(h: np.ndarray, offsets: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, and the number of the set that each belongs to.

    In the group of size classes (c, c + 1) a set is cut into K = D + 1 + spare parts. Two linked
    sets agree in K - D of them or more. Empty parts agree as well but say nothing, so they count
    only for sets with so many of them that all agreeing parts could be empty; both of two such
    sets then have that many.
    """
    n = np.diff(offsets)
    if not len(h):
        return np.zeros(0, B.U), np.zeros(0, np.int64)
    lows = similarity.classes(int(n.max()))
    own = np.searchsorted(lows, n, side="right") - 1
    out_h, out_s = [], []
    which = np.repeat(np.arange(len(n)), n)
    high = h >> B.U(32)
    salted = B.mix(h ^ B.U(0x5851F42D4C957F2D))
    for group in (own - 1, own):
        on = (n > 0) & (group >= 0)
        g = np.where(on, group, 0)
        d = similarity.differing(lows[g + 1] - 1)
        k = d + 1 + np.maximum(2, d // 8)
        take = (on & (d > 0))[which]  # sets that must be equal to link have been united already
        if not take.any():
            continue
        w = which[take]
        part = ((high[take] * k[w].astype(B.U)) >> B.U(32)).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (part[1:] != part[:-1]))))
        sums = np.add.reduceat(salted[take], change)
        sizes = np.diff(np.append(change, len(w)))
        s, p = w[change], part[change]
        tag = B.mix((g[s].astype(B.U) << B.U(32)) | p.astype(B.U))
        out_h.append(B.mix(sums ^ tag) + sizes.astype(B.U))
        out_s.append(s)
        filled = np.bincount(s, minlength=len(n))
        for x in np.flatnonzero(on & (d > 0) & (k - filled >= k - d)):
            empty = np.setdiff1d(np.arange(k[x]), p[s == x])
            out_h.append(B.mix(B.mix((g[x].astype(B.U) << B.U(32)) | empty.astype(B.U)) ^ B.U(0xE7037ED1A0B428DB)))
            out_s.append(np.full(len(empty), x))
    if not out_h:
        return np.zeros(0, B.U), np.zeros(0, np.int64)
    out_h, out_s = np.concatenate(out_h), np.concatenate(out_s)
    order = np.argsort(out_s, kind="stable")
    return out_h[order], out_s[order]


def _short(hashes: np.ndarray) -> bytes:
    """The upper six bytes of each hash: that many are enough to propose pairs."""
    return np.ascontiguousarray((B.mix(hashes) >> B.U(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(blob: bytes) -> np.ndarray:
    """Inverse of _short, with two bytes 0 below."""
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(size: int, similarity: Similarity):
    """Set size and digest of every text; the part hashes only where a digest first occurs in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            h, offsets = shingle_sets(*B.utf8(batch.column("text")), size)
            n = np.diff(offsets)
            both = []
            for salt in (0x2545F4914F6CDD1D, 0xA0761D6478BD642F):
                sums = np.concatenate((np.zeros(1, B.U), np.cumsum(B.mix(h ^ B.U(salt)))))
                both.append(B.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ n.astype(B.U)))
            digest = np.stack(both, axis=1)
            least: dict[bytes, int] = {}
            keys = [x.tobytes() for x in digest]
            for k, i in enumerate(ids.tolist()):
                if n[k] and (keys[k] not in least or i < ids[least[keys[k]]]):
                    least[keys[k]] = k
            chosen = np.sort(np.fromiter(least.values(), np.int64, len(least)))
            lens = n[chosen]
            sub = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
            picked = h[np.repeat(offsets[chosen] - sub[:-1], lens) + np.arange(sub[-1])] if len(chosen) else h[:0]
            parts, owner = part_hashes(picked, sub, similarity)
            edges = np.searchsorted(owner, np.arange(len(chosen) + 1))
            blobs: list[bytes | None] = [None] * len(ids)
            for k, a, b in zip(chosen.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                blobs[k] = _short(parts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], schema=SETS)

    return run


def _deal(parts: int):
    """Part hashes to the groups that they meet in. A chance meeting of their 48 bits only adds a tie
    that the product refutes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "parts"):
            blobs = batch.column("parts")
            sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False) // 6
            h = _long(b"".join(x for x in blobs.to_pylist() if x))
            if not len(h):
                continue
            doc = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            part = B.bucket_of(h, parts)
            edges = B.runs(part)
            rows = [(int(part[a]), B.pack(h[a:b] >> B.U(16), doc[a:b])) for a, b in zip(edges, B.ends(edges, len(h)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=SENT)

    return run


def _tie(group: pa.Table) -> pa.Table:
    h, doc = B.unpack_all(group.column("packed").to_pylist(), "ui")
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    starts = B.runs(h)
    lens = np.diff(np.append(starts, len(h)))
    hub = np.repeat(np.minimum.reduceat(doc, starts), lens) if len(h) else doc
    on = hub != doc
    pairs = np.unique(np.stack((hub[on], doc[on]), axis=1), axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=TIES)


def sorted_entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The incidence matrix of the sets as entries (shingle, row), by shingle."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, B.U)
    order = np.argsort(h, kind="stable")
    return h[order], owner[order]


def product(h1: np.ndarray, rows1: np.ndarray, n1: int, h2: np.ndarray, rows2: np.ndarray, n2: int) -> np.ndarray:
    """Overlap counts, n1 by n2: one incidence matrix times the other's transpose. Columns that fill
    a good part of both are multiplied as dense slices, the rest add up pairs of entries."""
    out = np.zeros((n1, n2), np.float32)
    s1, s2 = B.runs(h1), B.runs(h2)
    common, i, j = np.intersect1d(h1[s1], h2[s2], assume_unique=True, return_indices=True)
    if not len(common):
        return out
    l1, l2 = np.diff(np.append(s1, len(h1)))[i], np.diff(np.append(s2, len(h2)))[j]
    s1, s2 = s1[i], s2[j]
    dense = l1 * l2 * 64 > n1 * n2
    for a in range(0, int(dense.sum()), BLOCK_COLUMNS):
        k = np.flatnonzero(dense)[a : a + BLOCK_COLUMNS]
        left, right = np.zeros((n1, len(k)), np.float32), np.zeros((n2, len(k)), np.float32)
        left[rows1[spread(s1[k], l1[k])], np.repeat(np.arange(len(k)), l1[k])] = 1
        right[rows2[spread(s2[k], l2[k])], np.repeat(np.arange(len(k)), l2[k])] = 1
        out += left @ right.T
    s1, s2, l1, l2 = s1[~dense], s2[~dense], l1[~dense], l2[~dense]
    piece = np.cumsum(l1 * l2) // PAIRS
    edges = B.runs(piece)
    for a, b in zip(edges, B.ends(edges, len(piece)), strict=True):
        x = np.repeat(rows1[spread(s1[a:b], l1[a:b])], np.repeat(l2[a:b], l1[a:b]))
        y = rows2[spread(np.repeat(s2[a:b], l1[a:b]), np.repeat(l2[a:b], l1[a:b]))]
        out += np.bincount(x * n2 + y, minlength=n1 * n2).reshape(n1, n2)
    return out


def overlaps(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """Overlap counts of the sets (of the first ``left`` with all)."""
    h, rows = sorted_entries(sets)
    if left is None:
        return product(h, rows, len(sets), h, rows, len(sets)).astype(np.int64)
    on = rows < left
    return product(h[on], rows[on], left, h, rows, len(sets)).astype(np.int64)


def _forest(ok: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Spanning forest of the pairs that ``ok`` (some of all nodes by all nodes) holds, and each node's root."""
    left, n = ok.shape
    both = np.zeros((n, n), bool)
    both[:left] = ok
    both |= both.T
    root = np.full(n, -1)
    kept = []
    for top in range(n):
        if root[top] >= 0:
            continue
        root[top], ahead = top, [top]
        while ahead:
            a = ahead.pop()
            new = np.flatnonzero(both[a] & (root < 0))
            root[new] = top
            kept += [(a, b) for b in new.tolist()]
            ahead += new.tolist()
    return kept, root.tolist()


def _multiply(size: int, similarity: Similarity, cross: bool):
    """Blocks come as consecutive rows (hub, block, doc_id, side, text). Without ``cross`` all rows of
    a block are multiplied, the hub's first; with it those of side 0 with those of side 1."""

    def multiply(rows: list[tuple]) -> list[tuple]:
        hub = rows[0][0]
        rows = sorted(rows, key=lambda r: (r[3], cross or r[2] != hub, r[2]))
        h, offsets = shingle_sets(*B.utf8(pa.array([r[4] for r in rows], pa.string())), size)
        sets = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        # rows that share their id and set are one
        once = list({(r[3], r[2], x.tobytes()): k for k, (r, x) in reversed(list(enumerate(zip(rows, sets, strict=True))))}.values())[::-1]
        rows, sets = [rows[k] for k in once], [sets[k] for k in once]
        n = np.fromiter((len(x) for x in sets), np.int64, len(sets))
        left = sum(r[3] == 0 for r in rows) if cross else len(rows)
        over = overlaps(sets, left)
        ok = similarity.linked(over, n[:left, None], n[None, :]) & (over > 0)
        ok[np.arange(left), np.arange(left)] = False
        if cross:
            ok[:, :left] = False
        kept, root = _forest(ok)
        out = [(hub, rows[a][2], rows[b][2], False) for a, b in kept if rows[a][2] != rows[b][2]]
        if not cross:
            out += [(hub, r[2], r[2], True) for r, x in zip(rows, root, strict=True) if x != root[0]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][:2] != row[:2]:
                    out += multiply(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINKS.types, strict=True)], schema=LINKS)
                out = []
        if held and (out := multiply(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINKS.types, strict=True)], schema=LINKS)

    return run


def _links_of(over: np.ndarray, n1: np.ndarray, n2: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Which rows of a product link."""
    return similarity.linked(over.astype(np.int64), n1[:, None], n2[None, :]) & (over > 0)


def _count_blocks(size: int, similarity: Similarity):
    """Blocks come as consecutive rows (component, block, blocks, doc_id, n_rows, text); each becomes
    one row with its documents, the links inside it, and its entries if the component has more blocks."""

    def packed(rows: list[tuple]) -> tuple:
        h, offsets = shingle_sets(*B.utf8(pa.array([r[5] for r in rows], pa.string())), size)
        n = np.diff(offsets)
        doc, weight = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
        entries = sorted_entries([h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        ok = _links_of(product(*entries, len(rows), *entries, len(rows)), n, n, similarity)
        ok &= doc[:, None] != doc[None, :]
        several = rows[0][2] > 1
        return (*rows[0][:3], B.pack(doc, n, weight), B.pack(*entries) if several else None, B.pack(ok @ weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)

        out: list[tuple] = []
        for _, some in groupby(rows(), key=lambda r: r[:2]):
            out.append(packed(list(some)))
            if len(out) >= 256 or out[-1][4] is not None:
                yield _records(out, BLOCKS)
                out = []
        if out:
            yield _records(out, BLOCKS)

    return run


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _count_pairs(similarity: Similarity):
    """Two blocks of a component in each row: the links of each with the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                doc1, n1, w1 = B.unpack(row["docs1"], "iii")
                doc2, n2, w2 = B.unpack(row["docs2"], "iii")
                ok = _links_of(product(*B.unpack(row["entries1"], "ui"), len(n1), *B.unpack(row["entries2"], "ui"), len(n2)), n1, n2, similarity)
                ok &= doc1[:, None] != doc2[None, :]
                both = [(row["component"], row["i"], None, None, None, B.pack(ok @ w2)), (row["component"], row["j"], None, None, None, B.pack(w1 @ ok))]
                yield _records(both, BLOCKS)

    return run


def _degrees(group: pa.Table) -> pa.Table:
    """Sums of the links of a block's documents, which stand in one of the rows."""
    docs = next(x for x in group.column("docs").to_pylist() if x is not None)
    links = sum(B.unpack(x, "i")[0] for x in group.column("links").to_pylist())
    return pa.Table.from_arrays([pa.array(B.unpack(docs, "iii")[0]), pa.array(links)], schema=DEGREES)


def _own_degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = [B.unpack(x, "iii")[0] for x in batch.column("docs").to_pylist()]
        links = [B.unpack(x, "i")[0] for x in batch.column("links").to_pylist()]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(links))], schema=DEGREES)


def links_within(texts: DataFrame, size: int, similarity: Similarity) -> DataFrame:
    """rep, n_links of the texts (doc_id, component, n_rows, n_shingles, text): how many rows of its
    component each links with, where every text stands for n_rows rows."""
    sizes = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.greatest(F.count(F.lit(1)) / COUNT_ROWS, F.sum("n_shingles") / COUNT_SHINGLES)).cast("int").alias("blocks"))
    sizes = materialize(sizes, "jaccard-sizes")
    dealt = look_up(texts, sizes, "component", "n", texts.count())
    dealt = dealt.select("component", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "blocks", "doc_id", "n_rows", "text")
    counted = dealt.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(_count_blocks(size, similarity), ddl(BLOCKS))
    counted = materialize(counted, "jaccard-blocks")
    alone = counted.where("blocks = 1").select("docs", "links").mapInArrow(_own_degrees, ddl(DEGREES))
    several = counted.where("blocks > 1")
    if several.isEmpty():
        return alone
    # a block may have got no documents; pairs with it join nothing
    pairs = sizes.where("blocks > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 2)))
    pairs = pairs.select("component", "i", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("j"))
    side = lambda k, name: several.select("component", F.col("block").alias(name), F.col("docs").alias(f"docs{k}"), F.col("entries").alias(f"entries{k}")).hint("merge")
    met = pairs.join(side(1, "i"), ["component", "i"]).join(side(2, "j"), ["component", "j"]).repartition("component", "i", "j")
    crossed = materialize(met.mapInArrow(_count_pairs(similarity), ddl(BLOCKS)), "jaccard-crossed")
    summed = several.union(crossed).select("component", "block", "docs", "links").groupBy("component", "block").applyInArrow(_degrees, ddl(DEGREES))
    return alone.union(summed)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, part_bytes: int = PART_BYTES, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included), n_links.

    A text's set holds its distinct shingles of ``size`` words (``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased); with fewer words the whole sequence is its one shingle. Two documents link when
    intersection / union >= num / den. n_links counts the other rows that the document links with,
    those of an equal set included; the products for it take work by the square of a component's
    different sets. Without ``count_links`` it is null where the set is not empty.

    Null or wordless texts have an empty set and link with nothing. Rows without an id come back
    with their n_shingles, a null component and no links, and count for no other. Ids should be unique; rows that share one are
    returned each, joined to the component of that id. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    similarity = Similarity(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anonymous = docs.where("doc_id is null")
    docs = docs.where("doc_id is not null")
    groups = parts_for(docs, "text", part_bytes)
    sets = materialize(docs.mapInArrow(_sets(size, similarity), ddl(SETS)), "jaccard-sets")

    full = sets.where("n_shingles > 0")
    reps = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "jaccard-reps")
    first = sets.where("parts is not null").select("doc_id", "parts").join(reps.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sent = first.mapInArrow(_deal(groups), ddl(SENT))
    ties = materialize(sent.groupBy("part").applyInArrow(_tie, ddl(TIES)).distinct(), "jaccard-ties")

    counts = ties.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    counts = materialize(counts, "jaccard-hubs")
    n_ties = ties.count()
    members = look_up(ties, counts, "hub", "n", n_ties).select("hub", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "blocks")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("doc_id"), "blocks")
    members = materialize(members.union(hubs), "jaccard-members")
    order = ("hub", "block", "doc_id", "side", "text")
    texts = materialize(docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "jaccard-texts")

    def multiply(rows: DataFrame, cross: bool) -> DataFrame:
        return texts.join(rows.hint("merge"), "doc_id").select(*order).repartition("hub", "block").sortWithinPartitions("hub", "block").mapInArrow(_multiply(size, similarity, cross), ddl(LINKS))

    links = materialize(multiply(members.select("doc_id", "hub", "block", F.lit(0).alias("side")), False), "jaccard-links")
    # members of hubs with several blocks that their block leaves apart from the hub
    apart = links.where("loose").select("hub", F.col("a").alias("doc_id"))
    many = counts.where("blocks > 1")
    loose = materialize(look_up(apart, many, "hub", "n", n_ties), "jaccard-apart")
    if not loose.isEmpty():
        per = materialize(loose.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("rows"), F.max("n").alias("n")), "jaccard-loose")
        left = look_up(loose.select("hub", "doc_id", "blocks"), per, "hub", "n", n_ties)
        left = left.withColumn("row", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("rows")).cast("int"))
        left = left.select("doc_id", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "row", F.lit(0).alias("side"))
        right = look_up(members.where("doc_id <> hub"), per, "hub", "n", n_ties)
        right = right.select("doc_id", "hub", F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.lit(1).alias("side"))
        crossed = left.unionByName(right).select("doc_id", "hub", F.concat_ws(":", "row", "other").alias("block"), "side")
        links = links.union(materialize(multiply(crossed, True), "jaccard-cross"))
    edges = materialize(links.where("not loose").select("a", "b").distinct(), "jaccard-edges")
    components = materialize(connected_components(edges), "jaccard-components")
    known = reps.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    if count_links:
        about = reps.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_rows").alias("n_rows")).join(components.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
        shape = sets.select("doc_id", "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
        grouped = materialize(texts.join(about.join(shape.hint("merge"), "doc_id").hint("merge"), "doc_id").select("component", "doc_id", "n_rows", "n_shingles", "text"), "jaccard-grouped")
        degree = links_within(grouped, size, similarity).groupBy("rep").agg(F.sum("n_links").alias("n_links"))
        known = known.join(degree, "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("n_rows") - 1)
    else:
        known = known.withColumn("n_links", F.lit(None).cast("long"))
    known = materialize(known.select("digest", F.coalesce("component", "rep").alias("component_id"), "n_links", "n_rows"), "jaccard-known")
    columns = ("doc_id", "n_shingles", "component_id", "n_links")
    linked = look_up(full.select("doc_id", "n_shingles", "digest"), known, "digest", "n_rows", full.count()).select(*columns)
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    nameless = anonymous.mapInArrow(_sets(size, similarity), ddl(SETS)).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(empty).unionByName(nameless)
