"""Words of Arrow text arrays by byte tables, without a Python loop over texts or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 16 << 20


def _table(separators: list[int], lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[separators] = 0
    return table


_CONTROL = list(range(0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))

#: Byte tables: 0 separates words. UTF-8 bytes from 128 on belong to words in all of them.
#: A NUL byte would read as a separator, so white-space tables map it to 1, which no word list holds.
SPACED = _table([0x20, 9, 10, 11, 12, 13], lower=False)
SPACED[0] = 1
SPACED_LOWER = _table([0x20, 9, 10, 11, 12, 13], lower=True)
SPACED_LOWER[0] = 1
ALNUM_LOWER = _table(_CONTROL, lower=True)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; a null is as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data
    return (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64), data


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def word_places(offsets: np.ndarray, mapped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of every word: runs of other bytes than 0 in one text."""
    inside = mapped != 0
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    after = np.zeros_like(inside)
    if len(inside):
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text, with the total at the end; all words in order)."""
    offsets, data = text_buffers(texts)
    mapped = table[data]
    starts, ends = word_places(offsets, mapped)
    word_offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=word_offsets[1:])
    return np.searchsorted(starts, offsets), strings(word_offsets, mapped[mapped != 0])


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``max_bytes`` of text each; a longer text is a part of its own."""
    offsets, _ = text_buffers(batch[column])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of every pair, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
