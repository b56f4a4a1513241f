"""Token ids in files of compressed bit or byte planes.

A shard file holds the documents of a range of ids in ascending order:

    b"TKP1", kind (1: bit planes, 2: byte planes), 3 unused bytes, block length (uint32),
    documents (uint64), ids (uint64), chunks (uint64), documents without an id (uint64; they stand first)
    document index: doc_id (int64) and length (uint32) of each document, compressed by zstandard,
    preceded by its compressed size (uint64)
    chunk index: for each chunk its offset from the first chunk (uint64), size (uint32), ids (uint32)
    chunks: a block of at most ``block`` ids, transposed into planes, each plane compressed by
    zstandard and preceded by its size (uint32); a plane of zeros only has size 0 and no body

All numbers are little-endian. Shards are written under a name of the task's attempt and moved into
place, so a repeated task writes the same file again. Spark's range partitioning orders documents
over shards and sorting orders them inside; the manifest (one row for each shard) gives the global
position of each shard's first id.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship_package
from . import bytesops as B
from .common import ddl, parts_for

MAGIC = b"TKP1"
BLOCK = 1 << 16
#: Bytes of text in a shard.
SHARD_BYTES = 64 << 20
#: Distinct words that a worker remembers.
REMEMBER = 500_000
#: Shards whose lengths are summed up together for the manifest.
RANGE = 1024
#: Words that are encoded in one call.
TOGETHER = 1_000
#: Bytes of text whose words are looked up together.
SLICE_BYTES = 8 << 20

MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """The 32 bit planes or 4 byte planes of a block of ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    return [p for k in range(4) for p in np.packbits(np.unpackbits(raw[:, k : k + 1], axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[np.ndarray | None], n: int, bits: bool) -> np.ndarray:
    """Inverse of to_planes; None is a plane of zeros."""
    raw = np.zeros((n, 4), np.uint8)
    for k in range(4):
        if not bits:
            if planes[k] is not None:
                raw[:, k] = planes[k]
            continue
        for b in range(8):
            if (p := planes[8 * k + b]) is not None:
                raw[:, k] |= np.unpackbits(p, count=n) << b
    return raw.view("<u4").ravel()


def encode_chunk(ids: np.ndarray, bits: bool, level: int = 3) -> bytes:
    c = zstandard.ZstdCompressor(level=level)
    out = []
    for p in to_planes(ids, bits):
        body = c.compress(p.tobytes()) if p.any() else b""
        out += [len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def decode_chunk(blob: bytes, n: int, bits: bool) -> np.ndarray:
    d, at, planes = zstandard.ZstdDecompressor(), 0, []
    for _ in range(32 if bits else 4):
        size = int.from_bytes(blob[at : at + 4], "little")
        at += 4
        planes.append(np.frombuffer(d.decompress(blob[at : at + size]), np.uint8) if size else None)
        at += size
    return from_planes(planes, n, bits)


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: bool, block: int = BLOCK, nameless: int = 0) -> bytes:
    chunks = [encode_chunk(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    docs = zstandard.ZstdCompressor(level=3).compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes())
    index = np.zeros(len(chunks), np.dtype([("at", "<u8"), ("size", "<u4"), ("n", "<u4")]))
    if chunks:
        index["size"] = [len(c) for c in chunks]
        index["at"] = np.cumsum(index["size"]) - index["size"]
        index["n"] = np.minimum(block, len(ids) - np.arange(len(chunks)) * block)
    head = MAGIC + bytes([1 if bits else 2, 0, 0, 0]) + block.to_bytes(4, "little") + np.array([len(doc_ids), len(ids), len(chunks), nameless], "<u8").tobytes()
    return b"".join([head, len(docs).to_bytes(8, "little"), docs, index.tobytes(), *chunks])


class Shard:
    """Random access to an open shard file: only the chunks that are asked for are read."""

    def __init__(self, file) -> None:
        self.file = file
        head = file.read(44)
        if head[:4] != MAGIC:
            raise ValueError("not a token plane file")
        self.bits, self.block = head[4] == 1, int.from_bytes(head[8:12], "little")
        n_docs, self.n_ids, n_chunks, self.nameless = (int(x) for x in np.frombuffer(head[12:44], "<u8"))
        size = int.from_bytes(file.read(8), "little")
        docs = zstandard.ZstdDecompressor().decompress(file.read(size)) if n_docs else b""
        self.doc_ids = np.frombuffer(docs[: 8 * n_docs], "<i8")
        self.lengths = np.frombuffer(docs[8 * n_docs :], "<u4").astype(np.int64)
        self.index = np.frombuffer(file.read(16 * n_chunks), np.dtype([("at", "<u8"), ("size", "<u4"), ("n", "<u4")]))
        self.body = 52 + size + 16 * n_chunks

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-end // self.block)
        self.file.seek(self.body + int(self.index["at"][a]))
        blob = self.file.read(int(self.index["at"][b - 1] + self.index["size"][b - 1] - self.index["at"][a]))
        out = []
        for c in self.index[a:b]:
            at = int(c["at"] - self.index["at"][a])
            out.append(decode_chunk(blob[at : at + int(c["size"])], int(c["n"]), self.bits))
        return np.concatenate(out)[start - a * self.block : end - a * self.block]


#: What a text's bytes may become without a change of ids: A-Z lower-cased, as the tokenizer does,
#: and line ends to blanks.
_PLAIN = np.where(np.arange(256) == 10, 32, B.LOWER).astype(np.uint8)
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[[ord(c) for c in ".,;:!?*#$%&"]] = True
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Words that normalisation leaves as they are and that are one match of the pattern.
_LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: Characters that stand for bytes in a byte-level model: printable ones for themselves, the rest from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512)))
#: The settings under which words can be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(settings: dict) -> bool:
    """Whether a tokenizer with these settings (its JSON) gives the ids of a text's words, one word
    after the other: it lower-cases, cuts at white space and drops it, cuts marks from letters, and
    its special tokens begin with ``<|`` and hold no white space."""
    steps = (settings.get("normalizer") or {}).get("normalizers")
    first = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0]
    added = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in settings.get("added_tokens", []))
    model = settings.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
    bytewise = first == _SPLIT and settings["pre_tokenizer"]["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    free = not (settings.get("truncation") or settings.get("padding") or settings.get("post_processor"))
    return steps == _NORMALIZERS and bytewise and plain and added and free


def simpler(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts that have the same ids and fewer distinct words, and n + 1 offsets into them:
    A-Z lower-cased, line ends as blanks, and a blank between a letter and the marks that end its
    word, where the tokenizer cuts anyway. Null counts as empty; texts that could hold a special
    token's string change in their line ends only."""
    data, offsets = B.utf8(texts)
    plain = _PLAIN[data]
    mark = _MARK[plain]
    for k in np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)):
        row = slice(offsets[k], offsets[k + 1])
        plain[row], mark[row] = np.where(data[row] == 10, 32, data[row]), False
    n = len(plain)
    if not n:
        return plain, offsets
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = mark.copy(), mark.copy()  # runs of marks inside one text
    begins[1:] &= ~mark[:-1] | first[1:n]
    ends[:-1] &= ~mark[1:] | first[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    last = first[end] | (plain[np.minimum(end, n - 1)] == 32)
    before = plain[begin - 1]
    cut = begin[last & ~first[begin] & (_LETTER[before] | _LATIN[before] & (plain[begin - 2] == 0xC3))]
    out = np.full(n + len(cut), 32, np.uint8)
    kept = np.ones(n + len(cut), bool)
    kept[cut + np.arange(len(cut))] = False
    out[kept] = plain
    return out, offsets + np.searchsorted(cut, offsets)


class WordTokenizer:
    """A tokenizer of the tokenizers library. Where its settings allow (``by_words``), each distinct
    stretch between blanks and line ends is encoded once and remembered; else whole texts are encoded."""

    _kept: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The one of this Python worker, with what it remembers from earlier tasks."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.table, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes new words: those of letters by the model, the others many in one text with blanks
        between them, where a token's offset tells its word."""
        one = _LETTERS.fullmatch
        plain = [w for w in words if one(w)]
        others = [w for w in words if not one(w)]
        split = self.tokenizer.model.tokenize
        ids = [[t.id for t in split(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))] for w in plain]
        table, sizes = [self.table, np.fromiter(chain.from_iterable(ids), "<u4")], [self.sizes, np.fromiter(map(len, ids), np.int64)]
        for a in range(0, len(others), TOGETHER):
            some = others[a : a + TOGETHER]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            offsets = np.fromiter(chain.from_iterable(done.offsets), np.int64, 2 * len(done.ids))[::2]
            table.append(np.array(done.ids, "<u4"))
            sizes.append(np.bincount(np.searchsorted(starts, offsets, side="right") - 1, minlength=len(some)).astype(np.int64))
        self.codes.update(zip(chain(plain, others), range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.table, self.sizes = np.concatenate(table), np.concatenate(sizes)

    def _codes(self, words: list[str]) -> np.ndarray:
        """Codes of distinct words; new ones are learned."""
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh = [words[k] for k in new.tolist()]
            self._learn(fresh)
            codes[new] = np.fromiter(map(self.codes.__getitem__, fresh), np.int64, len(fresh))
        return codes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by ``end_id``; and the length of each."""
        from .bpe import spread

        if not self.by_words:
            done = [[*e.ids, end_id] for e in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for d in done for i in d], "<u4"), np.array([len(d) for d in done], np.int64)
        if len(self.codes) > REMEMBER:
            self._forget()
        if not len(self.sizes):
            self.table, self.sizes = np.array([end_id], "<u4"), np.ones(1, np.int64)
        plain, offsets = simpler(texts)
        buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(plain)]
        lists = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers), " ")
        words = lists.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False) + 1) - 1
        code = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
        word = np.ones(len(code), bool)
        word[ends] = False
        if len(words):
            code[word] = self._codes(pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))[words.indices.to_numpy()]
        sizes = self.sizes[code]
        before = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends + 1))]
        return self.table[spread((np.cumsum(self.sizes) - self.sizes)[code], sizes)], np.diff(before)


def open_output(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if root.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(root)


def put(root: str, name: str, body: bytes) -> str:
    """Writes a file under a passing name and moves it into place. Returns its path below ``root``."""
    fs, base = open_output(root)
    fs.create_dir(base, recursive=True)
    passing = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(passing) as f:
        f.write(body)
    fs.move(passing, f"{base}/{name}")
    return name


def _write(tokenizer: str, root: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, nameless = None, 0
        docs, lengths, ids = [], [], []
        for batch in B.slices(batches, most=SLICE_BYTES):
            words = words or WordTokenizer.of(tokenizer)
            x, n = words.encode(batch.column("text"), end_id)
            docs.append(pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False))
            nameless += batch.column("doc_id").null_count
            lengths.append(n)
            ids.append(x.astype(np.uint32))
        if docs:
            shard = TaskContext.get().partitionId()
            docs, lengths, ids = map(np.concatenate, (docs, lengths, ids))
            body = encode_shard(docs, lengths, ids, bits, nameless=nameless)
            path = put(root, f"shard-{shard:06d}.tkp", body)
            row = (shard, path, len(docs), len(ids), len(body))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, MANIFEST.types, strict=True)], schema=MANIFEST)

    return run


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1, bits: bool = False, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id``, writes the shards to the folder ``root`` that all
    executors share, in ascending order of id, and a Parquet manifest beside them. Returns the
    manifest: shard, path (below root), n_docs, n_ids, n_bytes and start (ids of earlier shards).

    Null texts count as empty: they have the end id only. Rows without an id come first; rows that
    share an id (or lack one) stand next to each other in any order. An empty table gives an empty
    manifest. Other columns are not read. Any tokenizer of the tokenizers library gives its own ids;
    one with the settings of ``by_words`` is faster.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = parts_for(docs, "text", shard_bytes)
    # the text's hash spreads rows that share an id over several shards
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    written = ordered.mapInArrow(_write(tokenizer, root, end_id, bits), ddl(MANIFEST))
    path, manifest = f"{root.rstrip('/')}/manifest-parts", f"{root.rstrip('/')}/manifest"
    written.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).withColumn("range", F.floor(F.col("shard") / RANGE))
    # ids before a range of shards, then those before a shard inside its range
    sums = rows.groupBy("range").agg(F.sum("n_ids").alias("sum"))
    sums = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("range").orderBy("shard")) - F.col("n_ids")
    started = rows.withColumn("inside", inside).join(sums, "range").withColumn("start", F.col("before") + F.col("inside"))
    started.select(*MANIFEST.names, "start").write.mode("overwrite").parquet(manifest)
    return spark.read.schema(ddl(MANIFEST) + ", start bigint").parquet(manifest)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(root: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_output(root)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{path}") as f:
                    shard = Shard(f)
                    ends = np.cumsum(shard.lengths)
                    at = 0
                    while at < len(ends):  # documents of about 4 million ids at once
                        begin = int(ends[at - 1]) if at else 0
                        to = max(at + 1, int(np.searchsorted(ends, begin + (1 << 22), side="right")))
                        ids = shard.ids(begin, int(ends[to - 1]))
                        raw = ids.tobytes()
                        stop = (ends[at:to] - begin).tolist()
                        cut = [raw[4 * a : 4 * b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
                        head = [pa.array(shard.doc_ids[at:to], mask=np.arange(at, to) < shard.nameless), pa.array(start + ends[at:to] - shard.lengths[at:to]), pa.array(shard.lengths[at:to])]
                        if digest:
                            yield pa.RecordBatch.from_arrays([*head, pa.array([zlib.crc32(c) for c in cut], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        else:
                            yield pa.RecordBatch.from_arrays([*head, pa.array(cut, pa.binary())], schema=READ)
                        at = to

    return run


def read_tokens(spark: SparkSession, root: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit)
    from the files under ``root``; with ``digest`` their crc32 in place of the ids. One task for
    each shard or several."""
    ship_package(spark)
    manifest = spark.read.parquet(f"{root.rstrip('/')}/manifest")
    shards = max(1, manifest.count())
    return manifest.select("path", "start").repartition(shards).mapInArrow(_read(root, digest), "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary"))
