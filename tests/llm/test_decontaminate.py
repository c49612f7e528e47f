"""Suffix-array search against plain search of every window in every text."""

import hashlib
import random
import re

import pytest

from lectern.llm import decontaminate as dc
from lectern.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases(n):
    random.seed(3)
    vocabulary = ["a", "bb", "é", "c1", "dd", "The"]
    sentence = lambda k: " ".join(random.choices(vocabulary, k=k))
    items = [(i, sentence(random.randint(0, 9))) for i in range(12)] + [(2, sentence(6)), (None, sentence(7)), (50, None)]
    texts = [(i, sentence(random.randint(0, 40)).replace(" ", random.choice([" ", ", ", "\n"]))) for i in range(n)]
    texts += [(4, texts[4][1]), (None, items[3][1]), (99, None), (98, ""), (97, "zz " * 30 + items[1][1] + " zz")]
    return texts, items


@pytest.mark.parametrize(("window", "block_chars"), [(4, 1 << 20), (4, 60), (3, 1 << 20)])
def test_equals_plain_search(spark, window, block_chars):
    texts, items = cases(60)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_words int, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.annotate(docs, bench, window, block_chars).select("doc_id", "text", "n_words", dc.n_hit("hits").alias("n"), "items").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n, r.items) == plain(r.text, items, window)


def test_long_items_only(spark):
    """No item is shorter than the window: the shortest match is the window."""
    texts, items = cases(40)
    items = [(i, t) for i, t in items if len(words(t)) >= 5]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in dc.annotate(docs, bench, 5).withColumn("n", dc.n_hit("hits")).collect():
        assert (r.n_words, r.n, r["items"]) == plain(r.text, items, 5)


def test_empty_tables_and_clean(spark):
    texts, items = cases(5)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.annotate(docs.limit(0), bench).count() == 0
    assert dc.annotate(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    kept = dc.clean(docs, bench, 4)
    assert kept.columns == docs.columns
    want = [t for _, t in texts if not plain(t, items, 4)[1]]
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, want))


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            windows.setdefault(tuple(v[k : k + 10]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op6_decontaminate"](spark, d).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        w = words(texts[r.doc_id])
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    found |= own
                    hit |= set(range(j, j + n))
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
