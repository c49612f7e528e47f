"""Personal data in texts: fixed rules, and a conditional random field for what they miss.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers that are written in full.
A linear-chain CRF over the shapes of words adds others: phone numbers without a plus sign, addresses
spelled with "(at)", numbers cut by marks. It is trained by gradient ascent from a small labelled table
(:func:`labelled_lines` by default), and labels words as the beginning or the inside of a kind, or
neither. Prose cannot hold any kind, so a sequence is a run of words within ``NEAR`` words of one with a
digit, an at sign, "at", "dot", "(at)" or "(dot)"; all other words have no label. Sequences are decoded by Viterbi in numpy batches. A
decoded span is kept if it passes the same tests of digits as the rules and touches no span of theirs.

Nulls: a null text is an empty one. Repeated rows are treated each for itself. Texts of any length are
read whole; all rules take time in proportion to the text. Ties between labels go to the first in
``LABELS``. An empty table gives an empty table. :func:`spans` adds ``base`` and ``spans``, and replaces
columns of these names; other columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import SPACED, slices, strings, text_buffers, word_places

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NEAR = 3
_FEATURES = 1 << 12
#: Bytes of text that are searched at once: the search holds 20 bytes for each, 80 where every word is near a number.
SLICE_BYTES = 1 << 20

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)

# ------------------------------------------------------------------ rules

# The look-behinds only keep the search from starting again inside a run that has failed.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            # No address can go on over this sign.
            done = at + 1
        at = text.find("@", done)


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text.split("."))
    digits = _NO_DIGIT.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' matches, by kind and start, in code points."""
    found = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return found


# ------------------------------------------------------------------ the labelled table

#: Ways to write each kind that the rules miss or find; the CRF sees both.
_EXAMPLES = {
    "phone": ("(555) 123-4567", "555-123-4567", "(030) 1234 5678", "+1 (168) 555-5254", "030 1234 56789", "555.123.4567", "+49 30 1234567", "(01) 23 45 67 89"),
    "email": ("anna (at) mail.example.com", "j.doe [at] example.org", "max34 (at) host.example.net", "ann.34@mail7.example.com", "info [at] site.example.de",
              "anna at mail.example.com", "j.doe at example.org", "anna (at) mail (dot) example (dot) com", "info [at] site [dot] example [dot] de",
              "max34 at host dot example dot net", "ann(at)mail(dot)example(dot)com"),
    "ip": ("97.51.17.173", "10.0.0.1", "192.168.12.254"),
    "card": ("4539 1488 0343 6467", "4539148803436467", "4539.1488.0343.6467", "5500-0055-5555-5559"),
}
#: Where they stand, and where similar words stand that are none of them.
_AROUND = ("{}", "call {} today", "the {} of anna", "Tel. {} .", "write to {} or not", "| {} | and", "we met, {} was there")
_OTHERS = (
    "on 2024-05-17 at 12:30", "version 2.0.1 of the work", "pages 100-200 and 300", "the 1234 houses", "CC BY-NC 4.0.",
    'token = "be24be64439e3e49cf46" here', "in 1999 and 2001 they", "costs 12.50 or 1,000 now", "no 4785380592391138 there",
    "item 17 of 20", "at the (at) the", "isbn 978-3-16-148410-0 is", "12% of 3/4", "id 123456789 or 987654321", "b2b a4 h1n1 x86",
    "the 10 to 20 of 3000", "§ 12 (3) and (4)", "they sat at home and looked at the dot on it", "he was at work at last", "the theater.example.com is here", "9 8 7 6 5 4 3 2 1", "1) one 2) two 3) three",
)


def labelled_lines() -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the small labelled table."""
    lines = [(words.split(), ["O"] * len(words.split())) for words in _OTHERS]
    for kind, examples in _EXAMPLES.items():
        for example in examples:
            for around in _AROUND:
                words, labels = [], []
                for word in around.split():
                    own = example.split() if word == "{}" else [word]
                    words += own
                    labels += [f"{'BI'[i > 0]}-{kind}" for i in range(len(own))] if word == "{}" else ["O"]
                lines.append((words, labels))
    return lines


# ------------------------------------------------------------------ the field


def shapes(words: pa.Array) -> pa.Array:
    """Runs of capitals as X, of other letters as x, each digit as d up to six, marks as they are."""
    x = pc.replace_substring_regex(words, r"[A-Z]+", "X")
    x = pc.replace_substring_regex(x, r"(?:[a-z]|[^\x00-\x7F])+", "x")
    x = pc.replace_substring_regex(x, r"[0-9]{7,}", "D")
    return pc.replace_substring_regex(x, r"[0-9]", "d")


def _hashed(text: str) -> int:
    h = 2166136261
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % _FEATURES


def _features(shape: str, lowered: str, known: frozenset[str]) -> list[str]:
    word = lowered.strip(".,;:!?|\"'")
    return [f"s{shape}", f"m{re.sub('d+', 'd', shape)}", f"w{word}" if word in known else "w", f"l{min(len(lowered), 9)}"]


class Field:
    """Weights of a linear-chain CRF: features of the word and of its neighbours, and of label pairs."""

    def __init__(self, lines: list[tuple[list[str], list[str]]]):
        # Words of the table that are prose are features themselves, as are "tel" or "at".
        self.known = frozenset(w.lower().strip(".,;:!?|\"'") for words, _ in lines for w in words if not re.search("[0-9@]", w))
        n = len(LABELS)
        self.weights = np.zeros((3, _FEATURES, n))
        self.pairs = np.zeros((n + 1, n))  # the last row is the start
        for i, label in enumerate(LABELS):
            if label.startswith("I-"):
                # An inside follows only its own kind.
                for j, before in enumerate((*LABELS, "start")):
                    if before[2:] != label[2:]:
                        self.pairs[j, i] = -1e3
        self._train(lines)

    def rows(self, words: list[str]) -> np.ndarray:
        """Feature numbers of every word."""
        shape = shapes(pa.array(words, pa.large_string())).to_pylist()
        cells = [[_hashed(f) for f in _features(s, w.lower(), self.known)] for s, w in zip(shape, words, strict=True)]
        return np.array(cells, np.int64).reshape(len(words), 4)

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """(before, own, after) scores of words with these features, for each label."""
        return self.weights[:, rows].sum(2)

    def _train(self, lines, steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> None:
        n = len(LABELS)
        longest = max(len(w) for w, _ in lines)
        rows = np.zeros((len(lines), longest, 4), np.int64)
        gold = np.full((len(lines), longest), -1)
        for i, (words, labels) in enumerate(lines):
            rows[i, : len(words)] = self.rows(words)
            gold[i, : len(words)] = [LABELS.index(x) for x in labels]
        real = gold >= 0
        target = np.eye(n)[np.maximum(gold, 0)] * real[..., None]
        fixed = self.pairs < -1
        sums = [np.full_like(x, 1e-8) for x in (self.weights, self.pairs)]
        for _ in range(steps):
            scores = np.zeros((len(lines), longest, n))
            for shift in (-1, 0, 1):
                part = self.weights[shift + 1][rows].sum(2) * real[..., None]
                scores += _shifted(part, -shift)
            marginal, pair = _forward_backward(scores, self.pairs, real)
            slope = (target - marginal) * real[..., None]
            g = np.zeros_like(self.weights)
            for shift in (-1, 0, 1):
                np.add.at(g[shift + 1], rows, (_shifted(slope, shift) * real[..., None])[:, :, None, :])
            seen = np.zeros_like(self.pairs)
            np.add.at(seen, (np.full(len(lines), n), gold[:, 0]), 1)
            for t in range(1, longest):
                on = real[:, t]
                np.add.at(seen, (gold[on, t - 1], gold[on, t]), 1)
            for w, grad, total in zip((self.weights, self.pairs), (g, np.where(fixed, 0, seen - pair)), sums, strict=True):
                grad = np.where(w < -1e2, 0, grad - decay * w)
                total += grad * grad
                w += rate * grad / np.sqrt(total)

    def decode(self, scores: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Best labels of sequences that lie one after another, all moved on one word at a time."""
        n = len(LABELS)
        lengths = np.diff(firsts)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = firsts[:-1][order], lengths[order]
        best = scores[starts] + self.pairs[n]
        back = np.zeros((len(scores), n), np.int8)
        labels = np.zeros(len(scores), np.int8)
        final = np.zeros((len(starts), n))
        for t in range(1, int(lengths.max(initial=0))):
            on = int(np.searchsorted(-lengths, -t, side="left"))  # sequences with more than t words
            final[on : len(best)] = best[on:]
            options = best[:on, :, None] + self.pairs[None, :n]
            back[starts[:on] + t] = options.argmax(1)
            best = options.max(1) + scores[starts[:on] + t]
        final[: len(best)] = best
        state = final.argmax(1)
        for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
            on = int(np.searchsorted(-lengths, -t, side="left"))
            labels[starts[:on] + t] = state[:on]
            state[:on] = back[starts[:on] + t, state[:on]]
        return labels


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by == 0:
        return x
    if by > 0:
        out[:, by:] = x[:, :-by]
    else:
        out[:, :by] = x[:, -by:]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _forward_backward(scores: np.ndarray, pairs: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities at each word, and expected label pairs summed over all sequences."""
    m, longest, n = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + pairs[n]
    for t in range(1, longest):
        moved = _logsum(ahead[:, t - 1, :, None] + pairs[None, :n], 1) + scores[:, t]
        ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        moved = _logsum(pairs[None, :n] + (scores[:, t + 1] + behind[:, t + 1])[:, None], 2)
        behind[:, t] = np.where(real[:, t + 1, None], moved, 0)
    whole = _logsum(ahead[:, -1], 1)
    marginal = np.exp(ahead + behind - whole[:, None, None]) * real[..., None]
    expected = np.zeros_like(pairs)
    expected[n] = marginal[:, 0].sum(0)
    for t in range(1, longest):
        joint = ahead[:, t - 1, :, None] + pairs[None, :n] + (scores[:, t] + behind[:, t])[:, None] - whole[:, None, None]
        expected[:n] += (np.exp(joint) * real[:, t, None, None]).sum(0)
    return marginal, expected


@functools.cache
def default_field() -> Field:
    return Field(labelled_lines())


# ------------------------------------------------------------------ over tables

_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), 64]] = True
_BRACKET = np.zeros(256, bool)
_BRACKET[[40, 91, 123]] = True
#: An address as rules or words spell it; "at" without a bracket is a word of its own.
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+(?:\s*[\[({](?:at|@)[\])}]?\s*|\s*(?:@[\])}]?|at[\])}])\s*|\s+at\s+)"
    r"[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]dot[\])}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
_CLOSING = np.zeros(256, bool)
_CLOSING[[41, 93, 125]] = True
_EDGE = " .,;:!?|\"'<>"


def _trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    edge = _EDGE + ("()[]" if kind != "phone" else "")
    while start < end and text[start] in edge:
        start += 1
    while start < end and text[end - 1] in edge:
        end -= 1
    return start, end


def _plausible(kind: str, text: str) -> bool:
    if kind == "email":
        return bool(_SPELLED.fullmatch(text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text)) and _valid(kind, text)
    return _valid(kind, text) and not re.search(r"[^\W\d_]", text)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where an address may be spelled without signs: at "(at", "[dot", and at "at", "at)" and "dot" as words."""
    out = np.zeros(len(data), bool)
    lower, size = data | 32, ends - starts
    for name in (b"at", b"dot"):
        n = len(name)
        at = np.flatnonzero(_BRACKET[data])
        at = at[at + n < len(data)]
        for k, byte in enumerate(name, 1):
            at = at[lower[at + k] == byte]
        # Not over the end of a word, which may be that of the text.
        out[at[at + n < ends[np.searchsorted(starts, at, side="right") - 1]]] = True
        own = starts[size == n]
        if n == 2:
            closed = starts[size == n + 1]
            own = np.append(own, closed[_CLOSING[data[closed + n]]])
        for k, byte in enumerate(name):
            own = own[lower[own + k] == byte]
        out[own] = True
    return out


def find(field: Field, texts: pa.Array) -> list[tuple[list, list]]:
    """(spans of the rules, all spans) of every text, by kind and start."""
    offsets, data = text_buffers(texts)
    n = len(offsets) - 1
    starts, ends = word_places(offsets, SPACED[data])
    hot = _HOT[data] | _spelled(data, starts, ends)
    with_hot = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hot)])[offsets]) > 0)
    out: list[tuple[list, list]] = [([], [])] * n
    if not len(with_hot):
        return out
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    # Words near a hot one, in the same text.
    place = np.searchsorted(starts, np.flatnonzero(hot), side="right") - 1
    mark = np.zeros(len(starts) + 2 * NEAR + 1, np.int32)
    np.add.at(mark, place, 1)
    near = np.zeros(len(starts), bool)
    any_hot = mark[: len(starts)] > 0
    for shift in range(-NEAR, NEAR + 1):
        rows = np.flatnonzero(any_hot) + shift
        rows = rows[(rows >= 0) & (rows < len(starts))]
        near[rows[text_of[rows] == text_of[rows - shift]]] = True
    words = np.flatnonzero(near)
    begin = np.ones(len(words), bool)
    begin[1:] = (np.diff(words) > 1) | (text_of[words[1:]] != text_of[words[:-1]])
    firsts = np.append(np.flatnonzero(begin), len(words))
    lengths = ends[words] - starts[words]
    edge = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.repeat(starts[words] - edge[:-1], lengths) + np.arange(edge[-1])
    coded = strings(edge, data[flat]).dictionary_encode()
    rows = field.rows(coded.dictionary.to_pylist())
    before, own, after = field.parts(rows)[:, coded.indices.to_numpy()]
    scores = own.copy()
    scores[1:] += np.where(begin[1:, None], 0, before[:-1])
    scores[:-1] += np.where(begin[1:, None], 0, after[1:])
    labels = field.decode(scores, firsts)
    return _assembled(out, texts, offsets, data, with_hot, (words, begin, labels), (starts, ends, text_of))


def _assembled(out, texts, offsets, data, with_hot, decoded, places):
    words, begin, labels = decoded
    starts, ends, text_of = places
    # Spans of labels: from a beginning on, as long as insides of its kind follow.
    opens = np.flatnonzero(labels % 2 == 1)
    goes_on = (labels % 2 == 0) & (labels > 0) & ~begin
    stops = np.append(np.flatnonzero(~goes_on), len(words))
    closes = stops[np.searchsorted(stops, opens, side="right")]
    by_text: dict[int, list] = {}
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        kind = KINDS[(labels[a] - 1) // 2]
        by_text.setdefault(int(text_of[words[a]]), []).append((kind, starts[words[a]], ends[words[b - 1]]))
    for row in with_hot.tolist():
        text = texts[row].as_py()
        base = base_spans(text)
        added = []
        if row in by_text:
            raw = data[offsets[row] : offsets[row + 1]]
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            taken = np.zeros(len(text) + 1, bool)
            for _, a, b in base:
                taken[a:b] = True
            for kind, a, b in by_text[row]:
                a, b = _trimmed(kind, text, int(point[a - offsets[row]]), int(point[b - offsets[row]]))
                if a < b and not taken[a:b].any() and _plausible(kind, text[a:b]):
                    added.append((kind, a, b))
        out[row] = (base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def _run(field: Field, names: list[str], make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE_BYTES):
                yield make(part, find(field, part["text"]))

    return run


def spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: (kind, start, end) in code points, by kind and start."""
    field = field or default_field()
    kept = docs.select(*(x for x in docs.columns if x not in ("base", "spans"))).withColumn("text", F.col("text").cast("string"))
    names = kept.columns
    cell = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        columns = [
            pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in found], cell) for i in (0, 1)
        ]
        return pa.record_batch([*(part[x] for x in names), *columns], names=[*names, "base", "spans"])

    schema = T.StructType([*kept.schema.fields, T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    return kept.mapInArrow(_run(field, names, make), schema)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in square brackets, and ``n_chars``, where
    there is such a column, counted again."""
    field = field or default_field()
    names = docs.columns

    def clean(text: str | None, found: list) -> str | None:
        if text is None or not found:
            return text
        parts, at = [], 0
        for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
            # Spans of two kinds may overlap: what is left of the later one goes too.
            if b > at:
                parts += [text[at:a], f"[{kind.upper()}]"] if a >= at else []
                at = b
        return "".join([*parts, text[at:]])

    def make(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        text = [clean(x.as_py(), y[1]) for x, y in zip(part["text"], found, strict=True)]
        return pa.record_batch([pa.array(text, pa.string()) if x == "text" else part[x] for x in names], names=names)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(_run(field, names, make), out.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
