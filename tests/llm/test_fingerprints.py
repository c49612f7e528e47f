"""Digests byte by byte, edits across ranges of the order, odd rows, and how texts are told apart."""

import hashlib
import math
import random

import pyarrow as pa
import pytest

from lectern.llm import fingerprints
from lectern.llm.queries import ORACLES, QUERIES


def by_hand(text):
    """The digest of one text, a byte at a time."""
    raw = text.encode()
    counts = [0] * 512
    for i in range(len(raw) - 2):
        key = raw[i] + 256 * raw[i + 1] + 65536 * raw[i + 2]
        counts[key * 2654435761 % 2**32 >> 23] += 1
    order = sorted(counts)
    quarters = [sum(c > order[k * 128 - 1] for k in (1, 2, 3)) for c in counts]
    length = math.floor(4 * math.log2(1 + len(raw)))
    packed = [sum(q << s for q, s in zip(quarters[i : i + 4], (6, 4, 2, 0))) for i in range(0, 512, 4)]
    return bytes([length, *packed]).hex(), quarters, length


def alike(a, b):
    (_, p, m), (_, q, n) = by_hand(a), by_hand(b)
    body = sum([0, 1, 2, 6][abs(x - y)] for x, y in zip(p, q))
    return max(832 - body - 16 * min(abs(m - n), 16), 0) / 832


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), sha, by_hand(text)[0], by_hand(changed)[0], alike(text, changed), alike(text, after)))
    return sorted(out, key=str)


def texts(n, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé世🙂") for _ in range(rng.randint(1, 7))) for _ in range(90)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(n)]


def test_blocks_do_not_matter(monkeypatch):
    some = ["", "a", "ab", "abc", *texts(40)]
    want = [by_hand(x)[0] for x in some]
    for size in (1 << 20, 64, 3):
        monkeypatch.setattr(fingerprints, "BLOCK_BYTES", size)
        got = fingerprints.digests(pa.array(some, pa.large_string()))
        assert fingerprints.written(*got) == want
        back = fingerprints.read(want)
        assert (back[0] == got[0]).all() and (back[1] == got[1]).all()


@pytest.mark.parametrize("rows_at_once", [2048, 3])
def test_edits_along_the_order(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", rows_at_once)
    rows = [(7 * i % 83 - 20, x) for i, x in enumerate(texts(83))]
    rows[5], rows[9], rows[11] = (rows[5][0], None), (rows[9][0], ""), (None, "no id")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, head int")
    assert sorted(map(tuple, fingerprints.edited(docs).collect()), key=str) == expected(rows)


def test_repeats_one_and_none(spark):
    same = spark.createDataFrame([(1, "ab" * 75)] * 9, "doc_id long, text string")
    found = fingerprints.edited(same).collect()
    assert len(found) == 9 and {r.fingerprint for r in found} == {r.edited_fingerprint for r in found}
    assert {(r.near_edited, r.near_next) for r in found} == {(1.0, 1.0)}
    one = fingerprints.edited(same.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edited(same.limit(0)).collect() == []
    wide = spark.createDataFrame([("x y", "old", 2)], "text string, fingerprint string, row int")
    (row,) = fingerprints.fingerprint(wide).collect()
    assert row.asDict() == {"text": "x y", "row": 2, "fingerprint": by_hand("x y")[0]}


def test_edited_texts_are_nearer_than_others(spark):
    found = QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001")
    assert found.where("near_edited > near_next").count() >= 0.98 * found.count()
    assert found.selectExpr("avg(near_edited) - avg(near_next) AS gap").first().gap > 0.4
    assert "op12_fingerprints" in ORACLES
