"""Runs against brute force on random and hand-made words, and the registered query on whole rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import runs
from lectern.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(
                all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)
            ):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    kind = rng.randint(0, 4)
    pick = lambda n, k: [rng.randint(0, k) for _ in range(n)]
    if kind < 2:
        return pick(rng.randint(0, 60), 1 + 2 * kind)
    if kind == 2:
        return [9] * rng.randint(0, 3) + (pick(rng.randint(1, 12), 2) * 8)[: rng.randint(0, 90)] + pick(rng.randint(0, 9), 2)
    if kind == 3:
        return (pick(rng.randint(1, 4), 1) * rng.randint(1, 6) + pick(1, 2)) * rng.randint(1, 9)
    return [x for _ in range(rng.randint(1, 4)) for x in (pick(rng.randint(1, 5), 2) * 9)[: rng.randint(1, 30)]]


@pytest.mark.parametrize("least,times", [(6, 4), (4, 4), (20, 6)])
def test_random_words(least, times):
    rng = random.Random(least)
    for _ in range(400):
        docs = [made(rng) for _ in range(rng.randint(1, 4))]
        firsts = np.cumsum([0, *map(len, docs)])
        words = np.array([x for d in docs for x in d], np.int64)
        found = runs.find_runs(words, np.repeat(np.arange(len(docs)), list(map(len, docs))), least, times)
        want = [(s + at, s + at + n, q) for d, at in zip(docs, firsts) for s, n, q in brute(d, least, times)]
        assert sorted(zip(*map(np.ndarray.tolist, found))) == sorted(want), docs


def test_grammar_derives_the_words():
    rng = random.Random(8)
    docs = [made(rng) for _ in range(60)]
    words = np.array([x for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), list(map(len, docs)))
    grammar = runs.Grammar(words, doc)
    low, mid, high = np.concatenate(grammar.first, axis=1)
    derived, starts = np.concatenate(grammar.rules), np.concatenate(grammar.starts)
    assert (low < mid).all() and (mid < high).all() and len(derived) > len(low)
    for rule, start in zip(derived, starts):
        size = high[rule] - low[rule]
        assert (words[start : start + size] == words[low[rule] : high[rule]]).all()
        assert doc[start] == doc[start + size - 1]


def test_thue_morse_and_long_repeats():
    tm = [bin(i).count("1") % 2 for i in range(4096)]
    assert [x.size for x in runs.find_runs(np.array(tm), np.zeros(4096, int))] == [0, 0, 0]
    one = np.array([7] * 50_000 + [8, 9] * 20_000 + list(range(10, 5010)) * 5)
    found = list(zip(*map(np.ndarray.tolist, runs.find_runs(one, np.zeros(len(one), int)))))
    assert found == [(0, 50_000, 1), (50_000, 90_000, 2), (90_000, 115_000, 5000)]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_registered_query(spark, tmp_path):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["a", "b", "Ä c", "\x00", "\x01"]) for _ in range(rng.randint(0, 300))) for i in planted}
    rows = [*texts.items(), (planted[0], texts[planted[0]]), (planted[1], None), (planted[2], ""), (planted[3], "one")]
    rows += [(None, "x y " * 9), (5, None), (6, " \n\t "), (7, "go " * 900 + "on"), (8, "a b\x0bc\x0cd\re " * 6 + "  a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_word_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert QUERIES["op13_word_runs"](spark, "/root/testdata/sf0.001").where("n_runs > 0").count() > 0


def test_other_columns_and_empty(spark):
    docs = spark.createDataFrame([("a a a a a a a b", "k", 1)], "text string, runs string, row int")
    (row,) = runs.annotate(docs).collect()
    assert row.asDict(True) == {"row": 1, "n_words": 8, "runs": [{"start": 0, "length": 7, "period": 1}], "collapsed": "a b"}
    assert runs.annotate(docs.limit(0)).collect() == []
    assert runs.annotate(docs.select("text")).columns == ["n_words", "runs", "collapsed"]
    order = F.struct(F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("period"))
    (row,) = runs.annotate(spark.createDataFrame([("x a b c d e f g h",)], "text string"), order).collect()
    assert row.collapsed == "x a b" and [tuple(r) for r in row.runs] == [(1, 8, 2)]
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, int), np.zeros(9, int), 6, 3)
