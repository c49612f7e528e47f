"""Components against brute force over all pairs, edge rows, the boundary, keeping one of each."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from lectern.llm import near_copies as nc
from lectern.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """component id of every row, comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders.get(x, ())}:
            shared = len(s & sets[j])
            if 100 * shared >= 85 * len(s | sets[j]):
                parent[root(i)] = root(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def family(seed, n, length, changes, vocabulary=300):
    random.seed(seed)
    base = [f"w{random.randrange(vocabulary)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(random.randrange(changes + 1)):
            w[random.randrange(len(w))] = f"x{random.randrange(9999)}"
        out.append(" ".join(w))
    return out


def answers(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, key int, n string")
    found = nc.components(docs.repartition(3)).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


def cases():
    texts = [None, "", " \n ", "One", "one", "one two", "ONE two", "one two three four", "one\ttwo three  four"]
    for seed, (n, length, changes) in enumerate([(12, 9, 1), (15, 14, 2), (20, 30, 2), (40, 120, 6), (30, 500, 25), (60, 70, 1)]):
        texts += family(seed, n, length, changes)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {x}" for x in family(9, 50, 25, 25)]  # share a passage, mostly without linking
    texts += [f"{passage} {' '.join(f'q{i}' for i in range(k))}" for k in range(0, 40)]  # a chain
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    return [*rows, (rows[20][0], rows[20][1]), (None, rows[30][1]), (None, "alone in the world here"), (5, rows[40][1])]


def test_equals_brute_force(spark):
    rows = cases()
    assert answers(spark, rows) == plain(rows)


@pytest.mark.parametrize(("step", "peeled", "wanted"), [(1, 2, 0), (10**9, 1, 1 << 20)])
def test_result_does_not_depend_on_the_bounds(spark, monkeypatch, step, peeled, wanted):
    monkeypatch.setattr(nc, "STEP", step)
    monkeypatch.setattr(nc, "PEELED", peeled)
    monkeypatch.setattr(nc, "MAX_WANTED", wanted)
    monkeypatch.setattr(nc, "LONG_LIST", 2 if wanted else 10**9)
    monkeypatch.setattr(nc, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(nc, "CENTRES", 2 * peeled - 2)
    monkeypatch.setattr(nc, "HEAVY_DOCS", 3 * peeled)
    rows = cases()[:120]
    assert answers(spark, rows) == plain(rows)


@pytest.mark.parametrize("boundary", [2, 64])
def test_result_does_not_depend_on_the_boundary(spark, monkeypatch, boundary):
    monkeypatch.setattr(nc, "choose_boundary", lambda *_: boundary)
    rows = cases()[:130]
    assert answers(spark, rows) == plain(rows)


def test_large_sets_are_told_apart_by_bitmaps_of_their_size(spark):
    rng = np.random.default_rng(0)
    every = rng.integers(0, 1 << 62, 9000).astype(np.uint64)
    # Half of 3,000 in common; 4,000 of 4,200, whose bitmaps have two lengths.
    sets = {1: every[:3000], 2: every[1500:4500], 3: every[4500:8500], 4: every[4500:8700]}
    rows = [
        (k, len(s), nc._bitmap(s, nc.BIT_WORDS).tolist(), nc._bitmap(s, nc._wide_words(len(s))).tolist(), s.view(np.int64).tolist())
        for k, s in sets.items()
    ]
    assert len(rows[2][3]) * 2 == len(rows[3][3])
    found = spark.createDataFrame(rows * 2, "key long, n long, bits array<long>, wide array<long>, shingles array<long>")
    marks = found.drop("shingles").dropDuplicates(["key"])
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    left = lambda bits: sorted(map(tuple, nc._not_apart(pairs, marks, bits, 85).collect()))
    assert left("bits") == [(1, 2), (3, 4)]
    assert left("wide") == [(3, 4)]
    assert [tuple(r) for r in nc._linked(pairs, marks, found, 85).collect()] == [(3, 4)]


def test_boundary_by_cost():
    assert nc.choose_boundary({60: 1000}, 85) <= 60  # many subsets: rather lists
    assert nc.choose_boundary({6: 1000}, 85) == 8  # one subset instead of two list entries


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words stand in here"), (3, "other words stand in here"),
            (4, None), (4, None), (3, "a b c d e f"), (None, "a b c d e f"), (None, "no id at all here"), (9, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _id int")
    docs = docs.withColumnRenamed("_id", "lang")
    kept = nc.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("1", "a b c d e f"), ("3", "other words stand in here"), ("4", "None"), ("4", "None"), ("None", "no id at all here"), ("9", "")]
    )
    assert nc.one_of_each(docs.limit(0)).count() == 0


def test_rows_with_an_id_of_their_own_are_named_by_it(spark):
    """No text is read into Python again where no id has several rows; where one has, no other row of it is lost."""
    texts = {1: "a b c d e f", 2: "A b c d e f", 3: "other words stand in here", 4: None}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(2)
    kept = nc.one_of_each(docs)
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    more = docs.unionByName(spark.createDataFrame([(2, None), (2, "words that stand alone here"), (5, texts[3])], docs.schema))
    assert sorted((r.doc_id, str(r.text)) for r in nc.one_of_each(more).collect()) == sorted(
        [(1, texts[1]), (2, "None"), (2, "words that stand alone here"), (3, texts[3]), (4, "None")]
    )


def test_a_batch_is_hashed_in_small_slices():
    text = " ".join(f"w{i}" for i in range(4000))
    batch = nc.pa.record_batch([[*range(400)], [f"{i} {text}" for i in range(400)]], names=["doc_id", "text"])
    tracemalloc.start()
    assert sum(map(len, nc._sets(4)([batch]))) == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = QUERIES["op8_near_copies"](spark, d).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == plain(rows)
