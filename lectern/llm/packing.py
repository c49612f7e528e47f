"""Packing of token ids into windows of fixed length, in one pass with bounded memory.

Every task keeps ``open_windows`` windows open. A document's full windows are emitted as they are; its
rest goes to the open window that it fills best. If it fits nowhere, a new window is opened, and if
there are ``open_windows`` already, the fullest one is closed first. The windows left open at the end
of the tasks are merged, some tasks' leftovers at a time, by the same rule on whole windows.

Nulls: a null text is an empty one (only the end id), a null ``doc_id`` stays null. Repeated rows are
packed like any other. An empty table gives no pieces. Texts of any length are cut into windows as they
come. Other columns are not read. Ties between windows go to the older one. Given the same splits of
the input the result is the same, so a task can be run again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import slices
from lectern.llm.subwords import encoder
from lectern.session import cut_lineage

OPEN_WINDOWS = 64
#: Texts are encoded so many bytes at a time.
SLICE_BYTES = 4 << 20
#: Leftover windows of so many tasks are merged together.
MERGED_TASKS = 64
_TASK_BITS = 33

_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, window long, offset long, ids binary, "
    "left_used long"
)


class Windows:
    """The open windows of a task, by free space."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.open: list[tuple[int, int]] = []  # (free space, window), ascending

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset in it) of ``length`` ids that stay together."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)
            free, window = self.size, self.next
            self.next += 1
        if free > length:
            insort(self.open, (free - length, window))
        return window, self.size - free


def _pack(path: str, end_id: int, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task = TaskContext.get()
        windows = Windows(size, limit, (task.partitionId() if task else 0) << _TASK_BITS)
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE_BYTES):
                firsts, ids = encode(part["text"])
                lengths = np.diff(firsts) + 1
                cells: list[tuple] = []
                for row, length in enumerate(lengths.tolist()):
                    full = length // size
                    for k in range(full):
                        cells.append((row, k * size, size, windows.next, 0))
                        windows.next += 1
                    if rest := length - full * size:
                        cells.append((row, full * size, rest, *windows.place(rest)))
                if not cells:
                    continue
                row, start, length, window, offset = np.array(cells, np.int64).T
                # The end id stands after the ids of each document.
                stream = np.insert(ids.astype("<u4"), firsts[1:], end_id)
                begin = (firsts[:-1] + np.arange(len(lengths)))[row] + start
                # Pieces follow one another in the stream, so their bytes are those of the stream.
                bounds = np.append(begin, len(stream)) * 4
                blob = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(stream)]
                ).cast(pa.binary())
                yield pa.record_batch(
                    [
                        part["doc_id"].take(pa.array(row)),
                        start, length, lengths[row], window, offset, blob,
                        pa.nulls(len(row), pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "window", "offset", "ids", "left_used"],
                )
        if windows.open:
            free, window = np.array(windows.open, np.int64).T
            none = pa.nulls(len(window), pa.int64())
            yield pa.record_batch(
                [none, none, none, none, window, none, pa.nulls(len(window), pa.binary()), size - free],
                names=["doc_id", "start", "length", "doc_tokens", "window", "offset", "ids", "left_used"],
            )

    return run


def _merge(size: int, limit: int):
    def run(left: pa.Table) -> pa.Table:
        # Largest first, so that small rests fill up what the large ones leave.
        left = left.sort_by([("left_used", "descending"), ("window", "ascending")])
        windows, names, rows = Windows(size, limit, 0), {}, []
        for window, used in zip(left["window"].to_pylist(), left["left_used"].to_pylist(), strict=True):
            place, offset = windows.place(used)
            # A merged window keeps the name of the first one in it, which no other has.
            rows.append((window, names.setdefault(place, window), offset))
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["window", "into", "shift"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of the documents in windows of ``size`` ids.

    ``docs`` has doc_id and text. Returns doc_id, start (ids of the document before the piece), length,
    doc_tokens (with the end id), sequence_id, offset in the sequence, ids (unsigned 32-bit, little
    endian). The ids of a sequence are those of its pieces by offset; a sequence is padded to ``size``.
    Texts are read where they lie, without a shuffle; only the leftover windows, at most
    ``open_windows`` numbers a task, are moved.
    """
    if not 0 < size < 1 << 31 or open_windows < 1:
        raise ValueError("size and open_windows must be positive")
    placed = cut_lineage(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _pack(tokenizer, end_id, size, open_windows), _PIECES
        ),
        compression="zstd",
    )
    left = placed.where("window is not null and left_used is not null").select("window", "left_used")
    # All leftovers of a group of tasks go to one task: open_windows * MERGED_TASKS numbers.
    team = F.floor(F.shiftright("window", _TASK_BITS) / MERGED_TASKS)
    moved = left.groupBy(team.alias("team")).applyInArrow(
        _merge(size, open_windows), "window long, into long, shift long"
    )
    return (
        placed.where("left_used is null")
        .join(cut_lineage(moved), "window", "left")
        .select(
            "doc_id", "start", "length", "doc_tokens",
            F.coalesce("into", "window").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
            "ids",
        )
    )
