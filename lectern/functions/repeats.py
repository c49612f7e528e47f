"""Removal of immediately repeated phrases.

A back-referencing regular expression overflows the JVM stack on long texts, so this one step
runs in Arrow batches in the Python workers, on words instead of characters. Whether a text can change at
all is found for whole batches at once; only texts that hold two equal phrases side by side, or
characters beyond the tables here, are gone through one by one.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"(\w+)")


def _one_pass(words: list[str], gaps: list[str], kept: list[int]) -> tuple[list[str], list[str], list[int]]:
    """Drop the second of two adjacent equal phrases, longest phrase first, left to right.

    ``gaps`` are what follows each word and ``kept`` the place each word had at first. A phrase never
    spans anything but space, so words hold together up to the next other gap.
    """
    n = len(words)
    pairs = defaultdict(list)
    joint, stretch, here = [], [], 0
    for i in range(n):
        stretch.append(here)
        joint.append(gaps[i].isspace())
        if not joint[i]:
            here += 1
        elif i < n - 1:
            pairs[words[i], gaps[i], words[i + 1]].append(i)

    drops = []
    i = 0
    while i < n - 1:
        if not joint[i]:
            i += 1
            continue
        size = 0
        found = pairs[words[i], gaps[i], words[i + 1]]
        if found[-1] > i + 1:
            for j in reversed(found):
                if j <= i + 1:
                    break
                end = 2 * j - i
                if (
                    end <= n
                    and stretch[end - 1] == stretch[i]
                    and words[i:j] == words[j:end]
                    and gaps[i : j - 1] == gaps[j : end - 1]
                ):
                    size = j - i
                    break
        if not size and words[i] == words[i + 1]:
            size = 1
        if size:
            drops.append((i + size, size))
        i += 2 * size or 1
    # What followed the second copy follows the first one now.
    for at, size in reversed(drops):
        gaps[at - 1] = gaps[at + size - 1]
        del words[at : at + size], gaps[at : at + size], kept[at : at + size]
    return words, gaps, kept


def collapse_text(text: str | None) -> str | None:
    """Repeat the pass until the text no longer changes."""
    if text is None:
        return None
    cells = _WORD.split(text)
    shown, gaps = cells[1::2], cells[2::2]
    words, kept = [w.lower() for w in shown], list(range(len(shown)))
    before = -1
    while before != len(words):
        before = len(words)
        words, gaps, kept = _one_pass(words, gaps, kept)
    if before == len(shown):
        return text
    return cells[0] + "".join([x for i, gap in zip(kept, gaps, strict=True) for x in (shown[i], gap)])


# What a byte of lower-cased UTF-8 belongs to. Bytes from 128 on are sorted out by _kinds.
_SPACE, _LETTER, _OTHER, _UNKNOWN = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(48, 58), 95, *range(97, 123)]] = _LETTER
_KIND[[*range(9, 14), *range(28, 33)]] = _SPACE
_KIND[128:] = _UNKNOWN
#: Signs among the characters of lead byte C2; the others are digits, letters or spaces.
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(0xA1, 0xAA), *range(0xAB, 0xB2), 0xB4, 0xB6, 0xB7, 0xB8, 0xBB, 0xBF]] = True
#: Equal word pairs of a stretch compared with so many later ones; more send the text to be gone through.
_LATER = 8


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte: Latin letters, the common signs, or unknown beyond these."""
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC2)
    first, second = data[lead], data[lead + 1]
    letter = (first >= 0xC3) & (first <= 0xC9)
    sign = (first == 0xC2) & _SIGNS[second] | (first == 0xC3) & ((second == 0x97) | (second == 0xB7))
    for chosen, to in ((letter, _LETTER), (sign, _OTHER)):
        kind[lead[chosen]] = kind[lead[chosen] + 1] = to
    # Dashes, quotation marks and dots.
    at = lead[(first == 0xE2) & (second == 0x80)]
    at = at[(data[at + 2] >= 0x90) & (data[at + 2] <= 0xA7)]
    for i in range(3):
        kind[at + i] = _OTHER
    return kind


def may_change(texts: pa.Array) -> np.ndarray:
    """For every text, whether a pass could drop something: never false for one that changes."""
    lowered = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    n = len(lowered)
    if not n:
        return np.zeros(0, bool)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + n + 1]
    raw = lowered.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _kinds(data)
    found = np.zeros(n, bool)
    text_of = lambda places: np.searchsorted(offsets, places, side="right") - 1
    found[text_of(np.flatnonzero(kind == _UNKNOWN))] = True

    # Words, and stretches of them with nothing but space between.
    inside = np.r_[False, kind == _LETTER, False]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    if len(starts) < 2:
        return found
    text = text_of(starts)
    signs = np.r_[0, np.cumsum(kind == _OTHER)][starts]
    stretch = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (signs[1:] != signs[:-1])])
    sizes = np.r_[0, np.cumsum(ends - starts)]
    cells = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[kind == _LETTER])]
    )
    word = cells.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    together = stretch[1:] == stretch[:-1]
    found[text[:-1][together & (word[1:] == word[:-1])]] = True
    # A longer phrase begins with two words that stand again where its copy begins, and ends with the same word.
    at = np.flatnonzero(together)
    bits = [int(x[-1] if x is stretch else x.max()).bit_length() for x in (stretch, word, word)]
    if sum(bits) < 64:
        order = at[np.argsort((stretch[at] << (2 * bits[1])) | (word[at] << bits[1]) | word[at + 1], kind="stable")]
    else:
        order = at[np.lexsort((word[at + 1], word[at], stretch[at]))]
    same = lambda i, j: (stretch[i] == stretch[j]) & (word[i] == word[j]) & (word[i + 1] == word[j + 1])
    for k in range(1, _LATER + 1):
        a, b = order[:-k], order[k:]
        again = same(a, b)
        if not again.any():
            break
        a, b = a[again], b[again]
        if k == _LATER:
            found[text[a]] = True
            break
        last = np.minimum(2 * b - a - 1, len(word) - 1)
        copy = (2 * b - a <= len(word)) & (stretch[a] == stretch[last]) & (word[b - 1] == word[last]) & (b - a > 1)
        found[text[a[copy]]] = True
    return found


def collapse_texts(texts: pa.Array) -> pa.Array:
    """:func:`collapse_text` of every text; nulls stay."""
    texts = texts.cast(pa.string())
    chosen = may_change(texts)
    if not chosen.any():
        return texts
    mask = pa.array(chosen)
    done = pa.array([collapse_text(x) for x in texts.filter(mask).to_pylist()], pa.string())
    return pc.replace_with_mask(texts, mask, done)


def collapse_repeats(text: Column) -> Column:
    """The text without immediately repeated phrases, ignoring case; the first copy stays as it is."""

    @F.arrow_udf("string")
    def collapse(batch: pa.Array) -> pa.Array:
        return collapse_texts(batch)

    return collapse(text)
