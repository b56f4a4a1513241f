"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Each task hashes all windows of its rows, keeps per hash the windows of the smallest document that
it has seen and deals them out by hash; windows of its other documents are already known to repeat.
The tasks that receive a range of hashes count them and find each window's smallest document.
Windows that also start in a smaller document go back to their documents, where they are merged
into maximal intervals and removed. No row stands for a single window: a row holds the packed
windows that one slice of rows sends to one range of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package
from . import bytesops as B
from .common import ddl, home_of, homes_for, parts_for

#: Bytes of text whose windows one receiving group holds (about 2.6 million windows).
PART_BYTES = 16 << 20

SENT = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("packed", pa.binary())])
FOUND = pa.schema([("home", pa.int32()), ("packed", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_intervals", pa.int64()), ("kept_text", pa.string())])


def _send(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            w = B.Words(*B.utf8(batch.column("text")))
            h, at = w.windows(width)
            if not len(h):
                continue
            doc, place = ids[w.text[at]], at - w.first[w.text[at]]
            order = np.argsort(h)
            h, doc, place = h[order], doc[order], place[order]
            starts = B.runs(h)
            least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
            later = doc > least
            out: list[tuple[int, bool, bytes]] = []
            if later.any():
                out.append((int(h[0]) % parts, True, B.pack(doc[later], place[later])))
            h, doc, place = h[~later], doc[~later], place[~later]
            part = B.bucket_of(h, parts)
            edges = B.runs(part)
            for a, b in zip(edges, B.ends(edges, len(h)), strict=True):
                out.append((int(part[a]), False, B.pack(h[a:b], doc[a:b], place[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT.types, strict=True)], schema=SENT)

    return run


def _rows(doc: np.ndarray, place: np.ndarray, homes: int) -> pa.Table:
    home = doc % homes
    order = np.lexsort((place, doc, home))
    doc, place, home = doc[order], place[order], home[order]
    edges = B.runs(home)
    packed = [B.pack(doc[a:b], place[a:b]) for a, b in zip(edges, B.ends(edges, len(doc)), strict=True)]
    return pa.Table.from_arrays([pa.array(home[edges], pa.int32()), pa.array(packed, pa.binary())], schema=FOUND)


def _find(homes: int):
    def run(group: pa.Table) -> pa.Table:
        known = group.column("known").to_numpy()
        packed = group.column("packed").to_pylist()
        d0, p0 = B.unpack_all((b for b, k in zip(packed, known, strict=True) if k), "ii")
        h, doc, place = B.unpack_all((b for b, k in zip(packed, known, strict=True) if not k), "uii")
        if len(h):
            order = np.argsort(h)
            h, doc, place = h[order], doc[order], place[order]
            starts = B.runs(h)
            least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
            later = doc > least
            d0, p0 = np.concatenate((d0, doc[later])), np.concatenate((p0, place[later]))
        return _rows(d0, p0, homes)

    return run


def _remove(width: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, place = B.unpack_all(found.column("packed").to_pylist(), "ii")
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        edges = B.runs(doc)
        at = dict(zip(doc[edges].tolist(), zip(edges.tolist(), B.ends(edges, len(doc)).tolist(), strict=True), strict=True))
        rows = []
        for batch in texts.to_batches():
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                removed = intervals = 0
                if n and i in at:
                    step = np.zeros(n + width + 1, np.int32)
                    p = np.unique(place[slice(*at[i])])
                    p = p[p + width <= n]
                    step[p] += 1
                    step[p + width] -= 1
                    gone = np.cumsum(step)[:n] > 0
                    removed = int(gone.sum())
                    intervals = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((i, n, removed, intervals, b" ".join(words).decode()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(RESULT.types)], schema=RESULT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """Removes from each text the words of windows that also start in a document with a smaller id.

    A window is ``width`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. Windows are
    judged on the input. Returns doc_id, n_words, n_removed, n_intervals (maximal removal
    intervals) and kept_text (kept words joined by one blank), one row for each input row.

    Null texts count as empty. Rows without an id lose nothing and remove nothing. Ids should be
    unique: rows that share one are one document, so exact repeats of a row lose the same words,
    and of different texts under one id each loses the places found in either. An empty table
    gives an empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts_for(docs, "text", part_bytes)
    homes = homes_for(docs, "text", part_bytes // 2)
    sent = docs.where("doc_id is not null").mapInArrow(_send(width, parts), ddl(SENT))
    found = sent.groupBy("part").applyInArrow(_find(homes), ddl(FOUND))
    texts = docs.withColumn("home", home_of(F.col("doc_id"), homes))
    return texts.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_remove(width), ddl(RESULT))
