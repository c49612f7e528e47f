"""Ids of a public tokenizer for whole batches of texts.

Most words of a batch occur again and again, and both tokenizers used here cut texts before spaces
and between a letter and a mark, so each distinct piece (a space and what follows up to the next
such place) is encoded once per worker and the ids of the texts are put together from those of their
pieces. Texts with runs of white space that the pieces would cut differently, or with an added token such
as ``<|endoftext|>``, are encoded whole. The result equals plain encoding.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.arrow import ranges, strings, text_buffers

#: Pieces that a worker remembers; above it, it starts afresh with those of the current batch.
MAX_REMEMBERED = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_JOINABLE = f"^ [!-~{_LETTERS}]+$"
_ONE_WORD = f"^ ?[{_LETTERS}]+$"
_JOINED = 1000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_set(values: list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[values] = True
    return table


_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
_MAY_END_SPACE = _byte_set(_SPACES + list(range(128, 256)))
_MAY_START_SPACE = _byte_set(_SPACES + [0xC2, 0xE1, 0xE2, 0xE3])
_ASCII_LETTERS = _byte_set([*range(65, 91), *range(97, 123)])
#: Not the apostrophe, with which the tokenizers' own words such as 's begin.
_MARKS = _byte_set([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Encodes Arrow arrays of texts; make one per worker by :func:`encoder`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of added tokens, which take their own id wherever a text holds them, and if case is ignored.
        self.added = [(x.content, x.normalized) for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.spaces_matter = model.get("normalizer") is None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        #: Ids that only stand at a piece's start (spaces matter), or at a word's end.
        self.marks = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.marks[i] = token.startswith("Ġ") if self.spaces_matter else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.pieces = strings(np.zeros(1, np.int64), np.empty(0, np.uint8))
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _joined(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces that hold one marking id each, encoded many at once."""
        out: list[np.ndarray] = []
        for at in range(0, len(pieces), _JOINED):
            part = pieces[at : at + _JOINED]
            ids = self._plain(["".join(x if x.startswith(" ") else " " + x for x in part)])[0]
            places = np.flatnonzero(self.marks[ids])
            if len(places) != len(part):
                out += self._plain(part)
            elif self.spaces_matter:
                out += np.split(ids, places[1:])
            else:
                out += np.split(ids, places[:-1] + 1)
        return out

    def _learn(self, pieces: pa.Array) -> None:
        pattern = _JOINABLE if self.spaces_matter else _ONE_WORD
        joinable = pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)
        order, ids = [], []
        for rows, encode in ((np.flatnonzero(joinable), self._joined), (np.flatnonzero(~joinable), self._plain)):
            if len(rows):
                order.append(rows)
                ids += encode(pieces.take(pa.array(rows)).to_pylist())
        placed = np.concatenate(order)
        lengths = np.empty(len(pieces), np.int64)
        lengths[placed] = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.empty(len(pieces), np.int64)
        starts[placed] = len(self.ids) + np.cumsum(lengths[placed]) - lengths[placed]
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *ids])

    def _rows(self, distinct: pa.Array) -> np.ndarray:
        """Where the ids of each piece are remembered."""
        if len(self.pieces) > MAX_REMEMBERED:
            self._forget()
        rows = pc.index_in(distinct, value_set=self.pieces)
        new = rows.is_null()
        if pc.any(new).as_py():
            known = len(self.pieces)
            missing = distinct.filter(new)
            self._learn(missing)
            rows = rows.to_numpy(zero_copy_only=False).astype(np.float64)
            rows[np.isnan(rows)] = known + np.arange(len(missing))
            return rows.astype(np.int64)
        return rows.to_numpy(zero_copy_only=False).astype(np.int64)

    def _irregular(self, offsets: np.ndarray, data: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Texts with a run of white space that goes on over the start of a piece."""
        if not len(spaces):
            return spaces
        text = np.searchsorted(offsets, spaces, side="right") - 1
        inner = spaces > offsets[text]
        before = inner & _MAY_END_SPACE[data[np.maximum(spaces - 1, 0)]]
        at_end = spaces + 1 >= offsets[text + 1]
        after = at_end | _MAY_START_SPACE[data[np.minimum(spaces + 1, len(data) - 1)]]
        return np.unique(text[before & after])

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """Texts that hold an added token; pieces would cut it."""
        found = np.zeros(len(texts), bool)
        for content, folded in self.added:
            found |= pc.match_substring(texts, content, ignore_case=folded).fill_null(False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each text, with the total at the end; all ids in order). Null is as empty."""
        offsets, data = text_buffers(texts)
        is_space = data == 32
        # Pieces start at every text, space, and mark after a letter; empty texts have none.
        is_start = is_space.copy()
        is_start[1:] |= _MARKS[data[1:]] & _ASCII_LETTERS[data[:-1]]
        is_start[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts = np.flatnonzero(is_start)
        spaces = np.flatnonzero(is_space) if self.spaces_matter else cuts[:0]
        pieces = strings(np.append(cuts, len(data)), data if self.spaces_matter else _LOWER[data])
        coded = pieces.dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.lengths[rows]
        ids = self.ids[ranges(self.starts[rows], lengths)]
        firsts = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(cuts, offsets)]
        odd = np.union1d(self._irregular(offsets, data, spaces), self._with_added(texts))
        if len(odd):
            parts = np.split(ids, firsts[1:-1])
            for row, whole in zip(odd, self._plain(texts.take(pa.array(odd)).to_pylist()), strict=True):
                parts[row] = whole
            ids = np.concatenate(parts)
            firsts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return firsts, ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker; it keeps what it has learnt from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
