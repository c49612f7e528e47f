"""Document fingerprints: quartile bucket digests of byte triplets.

Every three neighbouring bytes of a text are hashed into one of ``BUCKETS`` buckets. A bucket is then written
as the quarter it belongs to among all buckets of the text (0 to 3, by the count at a quarter, a half and
three quarters of the sorted counts), and the fingerprint is a hexadecimal string of

    a byte for the length, four steps for every doubling of the bytes; two bits per bucket, the first one highest

so equal texts have equal fingerprints and small edits change few buckets. The difference of two
fingerprints adds 1, 2 or 6 for buckets one, two or three quarters apart and ``LENGTH_COST`` for every step of
length, ``MAX_STEPS`` at most. Likeness is 1 at no difference and falls to 0 at ``UNRELATED``, what buckets
drawn by chance would differ by; larger differences count as that. With no triplet all buckets are 0.

:func:`edited` puts the documents in descending order of id and shows each the one after it, to measure how a
fingerprint bears an edit. The rows are shuffled once, by ranges of the order; a task meets the next text
as it goes. Only the first and the last text of every range are carried to the ranges beside it.

A null text is an empty one. Rows with a null id come last; rows of equal id follow by a hash of their
text, then the text, and all of them are kept. The document after the last is the first, also where there
is only one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import slices, text_buffers
from lectern.session import cut_lineage

BUCKETS = 512
#: For buckets 0 to 3 quarters apart.
APART = np.array([0, 1, 2, 6], np.uint8)
LENGTH_COST = 16
MAX_STEPS = 16
#: Two independent buckets differ by 1.625 on average.
UNRELATED = BUCKETS * 13 // 8
#: Bytes and rows of text whose buckets are counted at once.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 2048
_MULTIPLIER = 2654435761

_HALF = "fingerprint string, n_chars long, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
_STEP = f"part int, doc_id long, {_HALF}, head string, open string"


def bucket_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(text, bucket): triplets of each text; the bytes are taken in blocks."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for a in range(0, max(len(data) - 2, 0), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data) - 2)
        d = data[a : b + 2].astype(np.uint32)
        key = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
        # The text of every place; a triplet has to end in the text it starts in.
        cut = np.clip(offsets, a, b)
        text = np.repeat(np.arange(n), np.diff(cut))
        whole = np.arange(a, b) + 2 < offsets[text + 1]
        bucket = (key * np.uint32(_MULTIPLIER)) >> shift
        out += np.bincount((text * BUCKETS + bucket)[whole], minlength=len(out))
    return out.reshape(n, BUCKETS)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length steps and quarters (text, bucket) of a few texts."""
    offsets, data = text_buffers(texts)
    counts = bucket_counts(offsets, data)
    order = np.sort(counts, axis=1)
    quarters = np.zeros(counts.shape, np.uint8)
    for k in (1, 2, 3):
        quarters += counts > order[:, k * BUCKETS // 4 - 1, None]
    return np.floor(4 * np.log2(1 + np.diff(offsets))).astype(np.uint8), quarters


def written(length: np.ndarray, quarters: np.ndarray) -> list[str]:
    bits = quarters.reshape(len(quarters), BUCKETS // 4, 4)
    packed = (bits << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [x.tobytes().hex() for x in np.hstack([length[:, None], packed])]


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length steps and quarters from fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    bits = (raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return raw[:, 0], bits.reshape(len(raw), -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From 0 to 1, row by row."""
    body = APART[np.abs(a[1].astype(np.int8) - b[1].astype(np.int8))].sum(axis=1, dtype=np.int64)
    steps = np.abs(a[0].astype(np.int64) - b[0].astype(np.int64))
    return np.maximum(UNRELATED - body - LENGTH_COST * np.minimum(steps, MAX_STEPS), 0) / UNRELATED


def _compared(texts: list[str], nexts: list[str], own: tuple, following: tuple) -> dict[str, list | np.ndarray]:
    """What is known of documents once the texts after them, and their digests, are there."""
    cut = [len(x) // 3 for x in texts]
    changed = [x[: len(x) - k] + y[:k] for x, y, k in zip(texts, nexts, cut, strict=True)]
    other = digests(pa.array(changed, pa.large_string()))
    return {
        "fingerprint": written(*own),
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
        "edited_fingerprint": written(*other),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, following),
    }


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, column, BLOCK_BYTES):
        for at in range(0, part.num_rows, BLOCK_ROWS):
            yield part.slice(at, BLOCK_ROWS)


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of every text, where the rows lie; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    shown = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, "text"):
                found = pa.array(written(*digests(part["text"])), pa.string())
                yield pa.RecordBatch.from_arrays([part["row"], found], names=["row", "fingerprint"])

    row = shown.schema["row"].dataType.simpleString()
    return shown.mapInArrow(run, f"row {row}, fingerprint string").select(*[F.col("row")[c].alias(c) for c in kept], "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``docs``.

    The edited text has its last third, ``floor(n_chars / 3)`` code points, replaced by the first as many (or
    all) of the next document in descending order of ``doc_id``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.asc("_hash")]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The document whose next one has not come yet: id, text and digest.
        ids: list = []
        texts: list[str] = []
        length, quarters = np.empty(0, np.uint8), np.empty((0, BUCKETS), np.uint8)
        head = None

        def rows(done: dict | None, n: int, last: str | None) -> pa.RecordBatch:
            nonlocal head
            none = [None] * n
            done = done or {"fingerprint": written(length[:n], quarters[:n]), "n_chars": [len(texts[0])]}
            cells = {
                "part": [place] * n, "doc_id": ids[:n],
                **{c.split(" ")[0]: done.get(c.split(" ")[0], none) for c in _HALF.split(", ")},
                "head": [head, *none[1:]], "open": [*none[1:], last],
            }
            head = None
            types = {"part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
            return pa.record_batch([pa.array(v, types.get(c, pa.string())) for c, v in cells.items()], names=list(cells))

        place = 0
        for batch in batches:
            for part in _blocks(batch, "text"):
                if not part.num_rows:
                    continue
                place = part["part"][0].as_py()
                new = part["text"].to_pylist()
                if not ids:
                    head = new[0]
                more = digests(part["text"])
                ids, texts = ids + part["doc_id"].to_pylist(), texts + new
                length, quarters = np.r_[length, more[0]], np.r_[quarters, more[1]]
                if (n := len(ids) - 1) > 0:
                    yield rows(
                        _compared(texts[:-1], texts[1:], (length[:-1], quarters[:-1]), (length[1:], quarters[1:])), n, None
                    )
                    ids, texts, length, quarters = ids[-1:], texts[-1:], length[-1:], quarters[-1:]
        if ids:
            yield rows(None, 1, texts[0])

    step = cut_lineage(ordered.mapInArrow(along, _STEP))
    # Which range comes next: one number per range.
    numbers = Window.orderBy("part")
    ranges = step.where("head is not null").select("part").withColumn("following", F.lead("part").over(numbers))
    first = ranges.agg(F.min("part")).first()[0]
    ranges = ranges.withColumn("following", F.coalesce("following", F.lit(first)))
    heads = step.where("head is not null").select(F.col("part").alias("following"), "head", F.col("fingerprint").alias("next_print"))
    pairs = (
        step.where("open is not null").select("part", "doc_id", "open", "fingerprint").join(ranges, "part").join(heads, "following")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, "open"):
                own, following = read(part["fingerprint"].to_pylist()), read(part["next_print"].to_pylist())
                done = _compared(part["open"].to_pylist(), part["head"].to_pylist(), own, following)
                arrays = [pa.array(v, pa.int64() if c == "n_chars" else None) for c, v in done.items()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *arrays], names=["doc_id", *done])

    closed = pairs.select("doc_id", "open", "head", "fingerprint", "next_print").mapInArrow(close, f"doc_id long, {_HALF}")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return step.where("open is null").select(*names).unionByName(closed.select(*names))
