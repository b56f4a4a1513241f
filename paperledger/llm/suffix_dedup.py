"""Substring deduplication by longest-previous-factor arrays.

A suffix array of all texts would not fit one task, so it is built only where matches can be.
Every 100-byte window is assigned to its minimizer: the smallest hash among the windows' 32-byte
grams, the leftmost of equal ones. Equal windows have equal minimizers, and consecutive windows
share one, so a text falls into runs of some 35 windows. Three steps follow:

1. Runs are dealt out by minimizer as hashes. A run whose whole content (128 bits of hash) occurs
   earlier is a copy. A minimizer with one content only is done; elsewhere one run for each content
   is asked for.
2. The bytes of those runs meet by minimizer. There a suffix array with its common prefixes is
   built; the previous and the next smaller text position in suffix order give each position's
   longest previous factor, and positions whose factor has 100 bytes or more are copies.
   A minimizer with more bytes than one suffix array may hold (the edge of a passage that many
   documents share) is split: its windows are dealt out by their own hashes (128 bits), each home's
   smallest place of a window only, and all places of a window but the smallest are copies.
3. Copies go back to their texts, and the bytes that they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from . import bytesops as B
from .common import ddl, home_of, homes_for, parts_for

GRAM = 32
#: Bytes of text whose runs one receiving group holds.
PART_BYTES = 8 << 20
#: Bytes of text that wait together for what is found about them.
HOME_BYTES = 8 << 20
#: Bytes of runs whose suffix array is built at once; a minimizer with more is split by windows.
ARRAY_BYTES = 1 << 20
#: Groups that split windows are dealt to, for each group of runs.
SPLIT = 4
#: Bytes of text whose runs are dealt out together, and bytes that are hashed at once.
SLICE_BYTES, HASH_BYTES = 8 << 20, 1 << 19

SENT = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("packed", pa.binary())])
JUDGED = pa.schema([("home", pa.int32()), ("asked", pa.bool_()), ("packed", pa.binary())])
BYTES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary()), ("content", pa.binary())])
#: Kinds of BYTES: runs for a suffix array, smallest places of split windows, copies found already.
RUNS, WINDOWS, COPIES = range(3)
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values (which hold their own positions in the low bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    rows = -(-len(values) // width) + 1
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def text_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text number, start in the slice, number of windows,
    minimizer, and both halves of the content's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(B.U), none.astype(B.U), none.astype(B.U)
    rolling = B.rolling_bytes(data)
    grams = rolling.every(GRAM)
    bits = 31  # of a position; the same for every slice, so that equal windows choose alike
    keyed = (grams >> B.U(bits)) << B.U(bits) | np.arange(len(grams), dtype=B.U)
    least = sliding_argmin(keyed, width - GRAM + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = text[: len(least)] == text[width - 1 : width - 1 + len(least)]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    gram = grams[(least[start] & B.U((1 << bits) - 1)).astype(np.int64)]
    return text[start], start, end - start + 1, gram, rolling.stretch(start, end + width), B.check_bytes(data).stretch(start, end + width)


def _smallest(key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, check, doc, at), and in it: starts of equal (key, check), and which rows are not the first of theirs."""
    order = np.lexsort((at, doc, check, key))
    k, c = key[order], check[order]
    later = np.zeros(len(order), bool)
    later[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    return order, np.flatnonzero(~later), later


def _part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The group that a minimizer meets in. Minimizers are small hashes by choice, so they are mixed first."""
    return B.bucket_of(B.mix(gram ^ B.U(0x94D049BB133111EB)), parts)


def _send(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, most=SLICE_BYTES):
            found: list[tuple[np.ndarray, ...]] = []
            for piece in B.slices([batch], most=HASH_BYTES):
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                data, offsets = B.utf8(piece.column("text"))
                text, start, *rest = text_runs(data, offsets, width)
                found.append((ids[text], start - offsets[text], *rest))
            doc, at, count, gram, content, check = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(doc):
                continue
            order, _, later = _smallest(content, check, doc, at)
            out: list[tuple[int, bool, bytes]] = []
            if later.any():
                k = order[later]
                out.append((int(content[0]) % parts, True, B.pack(doc[k], at[k], count[k])))
            k = order[~later]
            part = _part_of(gram[k], parts)
            by_part = np.lexsort((gram[k], part))
            k, part = k[by_part], part[by_part]
            edges = B.runs(part)
            for a, b in zip(edges, B.ends(edges, len(k)), strict=True):
                x = k[a:b]
                out.append((int(part[a]), False, B.pack(gram[x], content[x], check[x], doc[x], at[x], count[x])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT.types, strict=True)], schema=SENT)

    return run


def _by_home(homes: int, asked: bool, doc: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows of JUDGED with what was found about the documents of each home."""
    home = doc % homes
    order = np.argsort(home, kind="stable")
    home, columns = home[order], [c[order] for c in (doc, *columns)]
    edges = B.runs(home)
    packed = [B.pack(*(c[a:b] for c in columns)) for a, b in zip(edges, B.ends(edges, len(home)), strict=True)]
    return pa.Table.from_arrays([pa.array(home[edges], pa.int32()), pa.array([asked] * len(edges), pa.bool_()), pa.array(packed, pa.binary())], schema=JUDGED)


def _judge(homes: int, width: int, array_bytes: int):
    def run(group: pa.Table) -> pa.Table:
        known = group.column("known").to_numpy()
        packed = group.column("packed").to_pylist()
        d0, a0, c0 = B.unpack_all((b for b, k in zip(packed, known, strict=True) if k), "iii")
        gram, content, check, doc, at, count = B.unpack_all((b for b, k in zip(packed, known, strict=True) if not k), "uuuiii")
        out = [JUDGED.empty_table()]
        if len(gram):
            order, starts, later = _smallest(content, check, doc, at)
            k = order[later]
            d0, a0, c0 = np.concatenate((d0, doc[k])), np.concatenate((a0, at[k])), np.concatenate((c0, count[k]))
            k = order[starts]  # the first run of each content
            k = k[np.argsort(gram[k])]
            starts = B.runs(gram[k])
            lens = np.diff(np.append(starts, len(k)))
            split = np.add.reduceat(count[k] + width - 1, starts) > array_bytes
            split, k = np.repeat(split, lens)[np.repeat(lens > 1, lens)], k[np.repeat(lens > 1, lens)]
            if len(k):
                out.append(_by_home(homes, True, doc[k], at[k], count[k], gram[k], split.astype(np.int64)))
        if len(d0):
            out.append(_by_home(homes, False, d0, a0, c0))
        return pa.concat_tables(out)

    return run


def _each(texts: pa.Table, doc: np.ndarray) -> Iterator[tuple[int, bytes, slice]]:
    """Number of the row, its bytes, and where its id stands in the sorted ``doc``, which it may not."""
    edges = B.runs(doc)
    at = dict(zip(doc[edges].tolist(), zip(edges.tolist(), B.ends(edges, len(doc)).tolist(), strict=True), strict=True))
    for i, text in zip(texts.column("doc_id").to_pylist(), (x for b in texts.to_batches() for x in b.column("text")), strict=True):
        yield i, (text.as_py() or "").encode(), slice(*at.get(i, (0, 0)))


def _windows(body: bytes, doc: np.ndarray, at: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Both halves of the hash, document and place of every window of the runs, whose bytes stand one
    after the other in ``body``."""
    sizes = count + width - 1
    which = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    data, k = np.frombuffer(body, np.uint8), (np.cumsum(sizes) - sizes)[which] + shift
    return B.rolling_bytes(data).every(width)[k], B.check_bytes(data).every(width)[k], doc[which], at[which] + shift


def _stretches(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as stretches of consecutive places: document, first place, number of windows."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))) if len(doc) else order
    return doc[starts], at[starts], np.diff(np.append(starts, len(doc)))


def _fetch(width: int, parts: int):
    """The bytes of the runs that were asked for, dealt out by minimizer; of split minimizers the
    windows, dealt out by their hashes."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        doc, at, count, gram, split = B.unpack_all(asked.column("packed").to_pylist(), "iiiui")
        order = np.argsort(doc, kind="stable")
        doc, at, count, gram, split = doc[order], at[order], count[order], gram[order], split[order]
        content: list[bytes] = [b""] * len(doc)
        for _, body, rows in _each(texts, doc):
            for k in range(rows.start, rows.stop):
                x = body[at[k] : at[k] + count[k] + width - 1]
                if len(x) == count[k] + width - 1:
                    content[k] = x
        there = np.fromiter((bool(x) for x in content), bool, len(content))
        out: list[tuple[int, int, bytes, bytes | None]] = []
        order = np.flatnonzero(there & (split == 0))
        part = _part_of(gram, parts)
        order = order[np.argsort(part[order], kind="stable")]
        edges = B.runs(part[order])
        for a, b in zip(edges, B.ends(edges, len(order)), strict=True):
            k = order[a:b]
            out.append((int(part[k[0]]), RUNS, B.pack(gram[k], doc[k], at[k], count[k]), B.zstandard.ZstdCompressor(level=1).compress(b"".join(content[x] for x in k.tolist()))))
        k = np.flatnonzero(there & (split == 1))
        if len(k):
            piece = np.cumsum(count[k] + width - 1) // HASH_BYTES
            edges = B.runs(piece)
            h, c, d, p = np.zeros(0, B.U), np.zeros(0, B.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, b in zip(edges, B.ends(edges, len(k)), strict=True):
                x = k[a:b]
                more = _windows(b"".join(content[y] for y in x.tolist()), doc[x], at[x], count[x], width)
                h, c, d, p = (np.concatenate(both) for both in zip((h, c, d, p), more, strict=True))
                order, starts, later = _smallest(h, c, d, p)
                if later.any():
                    y = order[later]
                    out.append((int(d[0]) % parts, COPIES, B.pack(*_stretches(d[y], p[y])), None))
                y = order[starts]
                h, c, d, p = h[y], c[y], d[y], p[y]
            part = parts + B.bucket_of(h, parts * SPLIT)  # h ascends
            edges = B.runs(part)
            out += [(int(part[a]), WINDOWS, B.pack(h[a:b], c[a:b], d[a:b], p[a:b]), None) for a, b in zip(edges, B.ends(edges, len(h)), strict=True)]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(BYTES.types)], schema=BYTES)

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the positions ``starts`` by their first ``width`` bytes, ties by ``tie``; and
    of each neighbouring pair the common prefix, as far as known: a doubling step's length, or ``width``.
    Every start has ``width`` bytes after it. Prefix doubling over ranks."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(B.U)
    key = np.zeros(n, B.U)
    for k in range(8):
        key = key << B.U(8) | padded[k : n + k]
    ranks, have = [], 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
    ranks.append((8, rank))
    while have * 2 <= width:
        pair = rank.astype(np.int64) * (n + 2)
        pair[: n - have] += rank[have:] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        have *= 2
        ranks.append((have, rank))
    final = rank[starts].astype(np.int64) * (n + 2) + (rank[starts + width - have] + 1)
    order = np.lexsort((tie, final))
    prefix = np.zeros(len(order), np.int64)
    for length, r in ranks:
        same = r[starts[order]]
        prefix[1:][same[1:] == same[:-1]] = length
    prefix[1:][final[order][1:] == final[order][:-1]] = width
    return order, prefix


def longest_previous_factor(order: np.ndarray, prefix: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """For each position its longest common prefix with a position that stands earlier (smaller
    ``place``), where that is ``least`` or more; else some smaller number. ``order`` is the suffix
    array and ``prefix[i]`` the common prefix of its entries i - 1 and i."""
    p = place[order]
    n = len(p)
    factor = np.zeros(n, np.int64)
    for flip in (False, True):
        q = p[::-1] if flip else p
        common = np.append(prefix[1:], 0)[::-1].copy() if flip else prefix.copy()
        link = np.arange(n) - 1  # towards the previous smaller place
        common[:1] = 0
        while True:
            on = np.flatnonzero((link >= 0) & (common >= least))
            on = on[q[link[on]] >= q[on]]
            if not len(on):
                break
            via = link[on]
            common[on] = np.minimum(common[on], common[via])
            link[on] = link[via]
        common[link < 0] = 0
        factor = np.maximum(factor, common[::-1] if flip else common)
    out = np.empty(n, np.int64)
    out[order] = factor
    return out


def _match(width: int, homes: int, array_bytes: int):
    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        if (kind != RUNS).any():
            packed = group.column("packed").to_pylist()
            h, c, d, p = B.unpack_all((b for b, k in zip(packed, kind, strict=True) if k == WINDOWS), "uuii")
            order, _, later = _smallest(h, c, d, p)
            known = B.unpack_all((b for b, k in zip(packed, kind, strict=True) if k == COPIES), "iii")
            copies = (np.concatenate(both) for both in zip(known, _stretches(d[order[later]], p[order[later]]), strict=True))
            return pa.concat_tables([_by_home(homes, False, *copies), suffixes(group.filter(pa.array(kind == RUNS)))])
        return suffixes(group)

    def suffixes(group: pa.Table) -> pa.Table:
        heads, bodies = group.column("packed").to_pylist(), group.column("content").to_pylist()
        gram, doc, at, count = B.unpack_all(heads, "uiii")
        if not len(gram):
            return JUDGED.empty_table()
        data = np.frombuffer(b"".join(B.zstandard.ZstdDecompressor().decompress(b) for b in bodies), np.uint8)
        sizes = count + width - 1
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        order = np.argsort(gram, kind="stable")
        edges = B.runs(gram[order])
        ends = B.ends(edges, len(order))
        upto = np.cumsum(sizes[order])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(edges):  # whole minimizers, about array_bytes at once
            before = upto[edges[a] - 1] if edges[a] else 0
            b = max(a + 1, int(np.searchsorted(upto[ends - 1], before + array_bytes, side="right")))
            k = order[edges[a] : ends[b - 1]]
            piece = np.concatenate([data[s : s + z] for s, z in zip(start[k].tolist(), sizes[k].tolist(), strict=True)])
            run_at = np.concatenate(([0], np.cumsum(sizes[k])[:-1]))
            which = np.repeat(np.arange(len(k)), count[k])
            shift = np.arange(len(which)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
            starts = run_at[which] + shift
            d, p = doc[k][which], at[k][which] + shift
            place = np.empty(len(which), np.int64)
            place[np.lexsort((p, d))] = np.arange(len(which))
            sa, prefix = suffix_order(piece, starts, width, place)
            copy = longest_previous_factor(sa, prefix, place, width) >= width
            found.append((d[copy], p[copy]))
            a = b
        d, p = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        return _by_home(homes, False, d, p, np.ones(len(d), np.int64))

    return run


def _remove(width: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, at, count = B.unpack_all(found.column("packed").to_pylist(), "iii")
        order = np.argsort(doc, kind="stable")
        doc, at, count = doc[order], at[order], count[order]
        rows = []
        for i, body, where in _each(texts, doc):
            n = len(body)
            removed = spans = 0
            a, c = at[where], count[where]
            ok = a + c + width - 1 <= n
            if ok.any():
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, a[ok], 1)
                np.add.at(step, a[ok] + c[ok] + width - 1, -1)
                gone = np.cumsum(step)[:n] > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                body = np.frombuffer(body, np.uint8)[~gone].tobytes()
            rows.append((i, n, removed, spans, body))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(RESULT.types)], schema=RESULT)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, part_bytes: int = PART_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Removes every byte covered by a ``width``-byte string that also starts earlier.

    Earlier: in a document with a smaller id, or in the same one further left; overlapping
    occurrences count, and the input is judged, not what is left. Texts are UTF-8 bytes; matches
    stay inside one document. ``width`` is at least 33. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept (the remaining bytes; a cut may split a character).

    Null texts count as empty. Rows without an id lose nothing and remove nothing. Ids should be
    unique: rows that share one are taken for one document, and places found in any apply to all.
    An empty table gives an empty result. Other columns are not read.
    """
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts_for(docs, "text", part_bytes)
    homes = homes_for(docs, "text", HOME_BYTES)
    texts = docs.withColumn("home", home_of(F.col("doc_id"), homes))
    sent = docs.where("doc_id is not null").mapInArrow(_send(width, parts), ddl(SENT))
    judged = materialize(sent.groupBy("part").applyInArrow(_judge(homes, width, array_bytes), ddl(JUDGED)), "suffix-runs")
    pieces = texts.groupBy("home").cogroup(judged.where("asked").groupBy("home")).applyInArrow(_fetch(width, parts), ddl(BYTES))
    matched = pieces.groupBy("part").applyInArrow(_match(width, homes, array_bytes), ddl(JUDGED))
    copies = judged.where("not asked").unionByName(matched)
    return texts.groupBy("home").cogroup(copies.groupBy("home")).applyInArrow(_remove(width), ddl(RESULT))
