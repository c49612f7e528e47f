"""Token ids in compressed files that allow one short document to be read alone.

Documents are written in ascending ``doc_id`` order. The ids of each document, as little-endian
integers, are one zstandard frame made with a dictionary that all files share. Frames are gathered into
segments of about ``segment_bytes``; a segment is a byte string of its own

    "LTK1", id width, hash of the dictionary, number of documents,
    doc ids, null marks, ids per document, frame offsets (one more than documents), frames

and lies in a row of a Parquet table next to its place (part, segment), its first and last doc id, its
number of ids and the dictionary's hash, so any store that Spark reaches can hold it and a reader finds
a document's segment by pushed-down filters and its frame by the offsets. The dictionary lies beside.

Nulls: a null text is an empty one (only the end id); rows with a null ``doc_id`` come first. Rows of
equal ``doc_id`` follow by a hash of their text, then the text; they are all kept. An empty table gives
files without rows. Other columns are not read. A document larger than a segment has one of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import slices
from lectern.llm.subwords import encoder
from lectern.session import cut_lineage

SEGMENT_BYTES = 4 << 20
#: The dictionary is made from about so many documents, of each at most so many ids. It changes only
#: how small the files get, never what is read back.
DICTIONARY_DOCS = 1000
DICTIONARY_IDS = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Above so many parts (16 bytes each), their places are joined by a shuffle.
MAX_BROADCAST_PARTS = 1 << 20

_MAGIC = b"LTK1"
_HEAD = struct.Struct("<4sB32sq")
_ROWS = (
    "part long, segment long, before long, first_doc long, last_doc long, n_docs long, n_tokens long, "
    "dictionary_hash string, content binary"
)


def _width(path: str) -> str:
    return "<u2" if encoder(path).size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the serialised ids of a bounded sample of documents."""
    total = docs.count()
    share = min(1.0, DICTIONARY_DOCS / max(total, 1))
    scale = 1 << 30
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale) + 1).select("text")

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(tokenizer)
        for batch in batches:
            for part in slices(batch):
                firsts, ids = encoder(tokenizer).encode(part["text"])
                cells = [
                    np.append(ids[a:b], end_id)[:DICTIONARY_IDS].astype(width).tobytes()
                    for a, b in zip(firsts[:-1], firsts[1:], strict=True)
                ]
                yield pa.record_batch([pa.array(cells, pa.binary())], names=["sample"])

    found = chosen.mapInArrow(serialised, "sample binary").limit(2 * DICTIONARY_DOCS).toArrow()
    samples = sorted(x for x in found["sample"].to_pylist())
    joined = b"".join(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        # Too little text to learn from: the text itself is the dictionary.
        return joined[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _segment(digest: bytes, width: str, docs: list, counts: list, frames: list) -> bytes:
    offsets = np.zeros(len(frames) + 1, "<i8")
    np.cumsum([len(x) for x in frames], out=offsets[1:])
    return b"".join(
        [
            _HEAD.pack(_MAGIC, int(width[-1]), digest, len(docs)),
            np.array([0 if x is None else x for x in docs], "<i8").tobytes(),
            np.array([x is None for x in docs], "u1").tobytes(),
            np.array(counts, "<i8").tobytes(),
            offsets.tobytes(),
            *frames,
        ]
    )


def open_segment(content: bytes) -> tuple[bytes, str, list, np.ndarray, np.ndarray, memoryview]:
    """(dictionary's hash, id type, doc ids, ids per document, frame offsets, frames)."""
    magic, width, digest, n = _HEAD.unpack_from(content)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    docs = np.frombuffer(content, "<i8", n, at)
    null = np.frombuffer(content, "u1", n, at + 8 * n)
    counts = np.frombuffer(content, "<i8", n, at + 9 * n)
    offsets = np.frombuffer(content, "<i8", n + 1, at + 17 * n)
    ids = [None if gone else int(x) for x, gone in zip(docs, null, strict=True)]
    return digest, f"<u{width}", ids, counts, offsets, memoryview(content)[at + 25 * n + 8 :]


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_bytes: int = SEGMENT_BYTES
) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``, each document's followed by ``end_id``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    raw = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(raw).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(tokenizer)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
        task = TaskContext.get()
        place, ids_held, frames, size, counts = task.partitionId() if task else 0, [], [], 0, []
        segment = before = 0

        def closed() -> pa.RecordBatch:
            known = [x for x in ids_held if x is not None]
            row = {
                "part": place, "segment": segment, "before": before, "first_doc": min(known, default=None),
                "last_doc": max(known, default=None), "n_docs": len(ids_held), "n_tokens": sum(counts),
                "dictionary_hash": digest.hex(), "content": _segment(digest, width, ids_held, counts, frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for part in slices(batch):
                firsts, ids = encoder(tokenizer).encode(part["text"])
                lengths = np.diff(firsts) + 1
                stream = np.insert(ids.astype(width), firsts[1:], end_id).tobytes()
                ends = np.cumsum(lengths) * int(width[-1])
                begins = ends - lengths * int(width[-1])
                view = memoryview(stream)
                for doc, a, b, n in zip(part["doc_id"].to_pylist(), begins, ends, lengths.tolist(), strict=True):
                    frame = compress(view[a:b])
                    if frames and size + len(frame) > segment_bytes:
                        yield closed()
                        segment, before = segment + 1, before + sum(counts)
                        ids_held, frames, size, counts = [], [], 0, []
                    ids_held.append(doc)
                    counts.append(n)
                    frames.append(frame)
                    size += len(frame)
        if frames:
            yield closed()

    order = ("doc_id", F.xxhash64("text"), "text")
    (
        docs.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions(*order)
        .mapInArrow(run, _ROWS)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/segments")
    )
    spark.createDataFrame([(digest.hex(), bytearray(raw))], "hash string, dictionary binary").write.parquet(
        f"{path}/dictionary"
    )


_SCHEMA = pa.schema(
    [(x, pa.int64()) for x in ("part", "segment", "before", "first_doc", "last_doc", "n_docs", "n_tokens")]
    + [("dictionary_hash", pa.string()), ("content", pa.binary())]
)


_READ = pa.schema(
    [("part", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


def _stored_dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["dictionary"])
    digest = hashlib.sha256(raw).digest()
    if digest.hex() != row["hash"]:
        raise ValueError("the dictionary is not the one that was written")
    return raw, digest


def _frames(content: bytes, raw: bytes, digest: bytes, wanted: set | None = None):
    """(doc id, ids in the segment before it, its ids) for all or the wanted documents."""
    used, width, docs, counts, offsets, frames = open_segment(content)
    if used != digest:
        raise ValueError("the segment was written with another dictionary")
    decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
    before = np.cumsum(counts) - counts
    for i, doc in enumerate(docs):
        if wanted is None or doc in wanted:
            yield doc, int(before[i]), np.frombuffer(decompress(frames[offsets[i] : offsets[i + 1]]), width)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little endian)."""
    raw, digest = _stored_dictionary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                cells = [
                    (row["part"], doc, row["before"] + before, len(x), x.astype("<u4").tobytes())
                    for doc, before, x in _frames(row["content"], raw, digest)
                ]
                columns = zip(zip(*cells, strict=True), _READ, strict=True)
                yield pa.record_batch([pa.array(x, f.type) for x, f in columns], schema=_READ)

    segments = spark.read.parquet(f"{path}/segments")
    rows = segments.select("part", "before", "content").mapInArrow(
        run, "part long, doc_id long, before long, n_tokens long, ids binary"
    )
    # One row a part: what earlier parts hold. The window goes over parts, not over documents.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    bases = F.broadcast(bases) if bases.count() <= MAX_BROADCAST_PARTS else bases
    return rows.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The ids of a few documents: only segments that can hold them are read, only their frames opened."""
    raw, digest = _stored_dictionary(spark, path)
    if not doc_ids:
        return {}
    may_hold = F.lit(False)
    for x in doc_ids:
        may_hold = may_hold | ((F.col("first_doc") <= x) & (F.col("last_doc") >= x))
    found: dict[int, list[list[int]]] = {}
    for row in spark.read.parquet(f"{path}/segments").where(may_hold).select("content").toLocalIterator():
        for doc, _, ids in _frames(bytes(row["content"]), raw, digest, set(doc_ids)):
            found.setdefault(doc, []).append(ids.tolist())
    return found

