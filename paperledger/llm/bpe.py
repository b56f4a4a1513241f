"""Byte-level BPE encoding and decoding with numpy.

The distinct words of a batch are encoded once. They stand as rows of padded matrices, one for each
length bucket; in every round each row merges its leftmost pair of minimum rank, found by hashed
lookup of pairs, the row closes the gap, and rows without a pair leave the matrix. Closing gaps
takes work by the square of a row's length, so a word of many bytes is a row of its own, whose ids
are linked and whose pairs wait by rank: a round merges all pairs of one rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package
from . import bytesops as B
from .common import ddl

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
NONE = np.int64(1 << 40)
#: Bytes of the longest word that shares a matrix with others.
LONG = 1024
#: Cells of a matrix at once.
CELLS = 1 << 21
#: Distinct chunks that a worker remembers.
REMEMBER = 400_000

#: Unicode's white space, as the tokenizer's regular expressions know it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the tokenizer's pattern crosses these pieces: a word with the blank before it, or white space.
CHUNK = regex.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+", regex.V0)


class Vocabulary:
    """Token bytes with their ranks, and a hash table from pairs of ids to the id of their union."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: k for k, t in enumerate(tokens)}
        self.rank = rank
        left, right, union = [], [], []
        for t, k in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    union.append(k)
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        keys = (np.array(left, np.uint64) << B.U(32)) | np.array(right, np.uint64)
        self.mask = B.U((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, (1 << 64) - 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, np.int64)
        todo = np.arange(len(keys))
        slot = B.mix(keys) & self.mask
        values = np.array(union, np.int64)
        empty = B.U((1 << 64) - 1)
        while len(todo):  # linear probing, all keys at once: of several for one free slot the last gets it
            free = self.keys[slot[todo]] == empty
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + B.U(1)) & self.mask
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A rank file: base64 token, blank, rank on each line."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2 and so on")
        return cls(tokens)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the union of each pair, NONE where there is none."""
        key = (left.astype(np.uint64) << B.U(32)) | right.astype(np.uint64)
        slot = B.mix(key) & self.mask
        out = np.full(key.shape, NONE, np.int64)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.values[slot[hit]]
        open_ = ~hit & (found != B.U((1 << 64) - 1))
        at = np.nonzero(open_)
        while len(at[0]):
            slot[at] = (slot[at] + B.U(1)) & self.mask
            found = self.keys[slot[at]]
            hit = found == key[at]
            sel = tuple(x[hit] for x in at)
            out[sel] = self.values[slot[sel]]
            on = ~hit & (found != B.U((1 << 64) - 1))
            at = tuple(x[on] for x in at)
        return out


def merge_rows(vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges every row of the padded matrix ``ids`` to the end. Returns the rows and their lengths."""
    ids, lengths = ids.copy(), lengths.copy()
    live = np.flatnonzero(lengths > 1)
    if not len(live):
        return ids, lengths
    work, size = ids[live], lengths[live]
    columns = np.arange(work.shape[1])
    ranks = np.full(work.shape, NONE, np.int64)
    ranks[:, :-1] = vocab.pairs(work[:, :-1], work[:, 1:])
    ranks[columns[None, :] >= size[:, None] - 1] = NONE
    while True:
        at = np.argmin(ranks, axis=1)  # the first of equal ones
        best = ranks[np.arange(len(live)), at]
        done = best >= NONE
        if done.any():  # finished rows leave, and the matrix gets as narrow as the longest row
            ids[live[done], : work.shape[1]], lengths[live[done]] = work[done], size[done]
            keep = np.flatnonzero(~done)
            if not len(keep):
                return ids, lengths
            live, size, at, best = live[keep], size[keep], at[keep], best[keep]
            most = int(size.max())
            work, ranks = work[keep, :most], ranks[keep, :most]
        rows, n = np.arange(len(live)), work.shape[1]
        shift = columns[None, : n - 1] > at[:, None]
        work[:, :-1] = np.where(shift, work[:, 1:], work[:, :-1])
        ranks[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = NONE
        work[rows, at] = best
        size = size - 1
        left = np.flatnonzero(at > 0)
        ranks[left, at[left] - 1] = vocab.pairs(work[left, at[left] - 1], work[left, at[left]])
        inner = at < size - 1
        ranks[rows[~inner], at[~inner]] = NONE
        right = np.flatnonzero(inner)
        ranks[right, at[right]] = vocab.pairs(work[right, at[right]], work[right, at[right] + 1])


def merge_long(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Merges one long row; the same ids as merge_rows in near-linear time.

    Merging the leftmost pair of minimum rank again and again merges all pairs of that rank from
    left to right, as long as no merge makes a pair of a smaller rank. Where one does (ranks that
    weren't learned in order), merge_rows takes over.
    """
    n = len(ids)
    token = np.append(ids, 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ranks = np.full(n + 1, NONE, np.int64)
    ranks[: n - 1] = vocab.pairs(ids[:-1], ids[1:])
    alive = np.ones(n + 1, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(at: np.ndarray) -> None:
        """Lets the pairs that begin at these places wait by their ranks."""
        at = at[ranks[at] < NONE]
        at = at[np.argsort(ranks[at], kind="stable")]
        edges = B.runs(ranks[at])
        for a, b in zip(edges.tolist(), B.ends(edges, len(at)).tolist(), strict=True):
            rank = int(ranks[at[a]])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(queue, rank)
            waiting[rank].append(at[a:b])

    put(np.arange(n - 1))
    while queue:
        rank = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[ranks[at] == rank]
        if not len(at):
            continue
        # of pairs that share an id the left one goes first: every second one of a chain
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        right = after[at]
        token[at] = rank
        ranks[right], alive[right] = NONE, False
        after[at] = after[right]
        before[after[at]] = at  # n stands for the end and is never read as a place
        left = before[at]
        fresh = np.unique(np.concatenate((at, left[left >= 0])))
        follows = after[fresh]
        ranks[fresh] = NONE
        inner = fresh[follows < n]
        ranks[inner] = vocab.pairs(token[inner], token[after[inner]])
        if (ranks[inner] < rank).any():
            rest, sizes = merge_rows(vocab, ids[None, :], np.array([n]))
            return rest[0, : sizes[0]]
        put(inner)
    return token[:n][alive[:n]]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... sizes[k] times, for one k after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Encoder:
    _kept: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """The one of this Python worker, with what it remembers from earlier tasks."""
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(Vocabulary.load(path), pattern)
        return cls._kept[path, pattern]

    def __init__(self, vocab: Vocabulary, pattern: str) -> None:
        self.vocab = vocab
        self.pattern = regex.compile(pattern, regex.V0)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.table, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each one match of the pattern, one after the other; and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        bucket = np.where(sizes <= 64, -(-sizes // 4) * 4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        parts = []
        count = np.zeros(len(raw), np.int64)
        for k in np.flatnonzero(sizes > LONG).tolist():
            ids = merge_long(self.vocab, self.vocab.byte_id[np.frombuffer(raw[k], np.uint8)])
            count[k] = len(ids)
            parts.append((np.array([k]), ids))
        for width in np.unique(bucket[sizes <= LONG]).tolist():
            members = np.flatnonzero(bucket == width)
            step = max(1, CELLS // max(width, 1))
            for a in range(0, len(members), step):
                m = members[a : a + step]
                flat = np.frombuffer(b"".join(raw[k] for k in m.tolist()), np.uint8)
                padded = np.zeros((len(m), width), np.int64)
                padded[np.arange(width)[None, :] < sizes[m][:, None]] = self.vocab.byte_id[flat]
                ids, count[m] = merge_rows(self.vocab, padded, sizes[m])
                parts.append((m, ids[np.arange(width)[None, :] < count[m][:, None]]))
        out = np.zeros(int(count.sum()), "<u4")
        starts = _starts(count)
        for m, ids in parts:
            out[spread(starts[m], count[m])] = ids
        return out, count

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that aren't known yet: the pattern's matches in them, each distinct one once."""
        matches = [self.pattern.findall(c) for c in chunks]
        distinct: dict[str, int] = {}
        code = np.fromiter((distinct.setdefault(w, len(distinct)) for m in matches for w in m), np.int64)
        ids, count = self.words(list(distinct))
        per = np.array([len(m) for m in matches], np.int64)
        ends = np.concatenate(([0], np.cumsum(count[code])))
        self.codes.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks)), strict=True))
        self.table = np.concatenate((self.table, ids[spread(_starts(count)[code], count[code])]))
        self.sizes = np.concatenate((self.sizes, np.diff(ends[np.concatenate(([0], np.cumsum(per)))])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets into them."""
        if len(self.codes) > REMEMBER:
            self._forget()
        pieces = [CHUNK.findall(t) for t in texts]
        new = {c for p in pieces for c in p if c not in self.codes}
        if new:
            self.learn(sorted(new))
        get = self.codes.__getitem__
        code = np.fromiter((get(c) for p in pieces for c in p), np.int64)
        n = self.sizes[code]
        words = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(n)))[words]
        return self.table[spread(_starts(self.sizes)[code], n)], offsets


def decode_bytes(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all documents one after the other, and n + 1 offsets into them."""
    ids = ids.astype(np.int64)
    if len(ids) and int(ids.max()) >= len(vocab.tokens):
        raise ValueError("an id is not in the vocabulary")
    n = vocab.lengths[ids]
    return vocab.bytes[spread(vocab.starts[ids], n)], np.concatenate(([0], np.cumsum(n)))[offsets]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in B.slices(batches):
            encoder = encoder or Encoder.of(path, pattern)
            ids, offsets = encoder.encode(pc.fill_null(batch.column("text"), "").to_pylist())
            raw = ids.tobytes()
            rows = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(rows, pa.binary())], schema=RESULT)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every text, one row for each input row.

    ``path`` is a rank file that every executor can read, ``pattern`` cuts texts before merging.
    No special tokens. Null texts count as empty, which have no ids; doc_id is passed through,
    null or repeated; an empty table gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_encode(path, pattern), ddl(RESULT))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None
        for batch in B.slices(batches, "ids"):
            vocab = vocab or Vocabulary.load(path)
            blobs = [x or b"" for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int64)
            data, at = decode_bytes(vocab, np.frombuffer(b"".join(blobs), "<u4"), offsets)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "content"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and content, the bytes of each row's ids (null ids: no bytes). An unknown id is an error."""
    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, content binary")


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids: encodes, decodes the ids and
    hashes both inside one task, so that the bytes don't leave it. Rows and nulls as in encode."""
    shape = ROUND_TRIP.append(pa.field("ids", pa.binary())) if with_ids else ROUND_TRIP
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in B.slices(batches):
            encoder = encoder or Encoder.of(path, pattern)
            ids, offsets = encoder.encode(pc.fill_null(batch.column("text"), "").to_pylist())
            data, at = decode_bytes(encoder.vocab, ids, offsets)
            sha = lambda x, o: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sha(ids, offsets), pa.string()), pa.array(sha(data, at), pa.string())]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return docs.mapInArrow(run, ddl(shape))
