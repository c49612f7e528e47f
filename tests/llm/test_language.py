"""Language model: counts by hand, held-out accuracy, calibration, edge rows."""

import zlib

import numpy as np

from lectern.llm import language as lg
from lectern.llm.queries import QUERIES


def test_counts_are_those_of_the_whole_text(monkeypatch):
    text = "Über die Straße 😀 " * 50
    whole = lg.counts(text)
    n = len(text.lower())
    assert whole.sum() == n + n - 1 + n - 2
    monkeypatch.setattr(lg, "_BLOCK", 7)
    assert (lg.counts(text) == whole).all()
    assert lg.counts("").sum() == 0 and lg.counts("a").sum() == 1


def test_sparse_weights_and_calibration():
    rows = []
    rng = np.random.default_rng(1)
    for i in range(400):
        lang = "ab"[i % 2]
        other = lang if rng.random() < 0.8 else "ab"[(i + 1) % 2]  # a fifth of the labels is wrong
        text = " ".join(rng.choice(["aa", "ab"] if lang == "a" else ["bb", "ba"], 20))
        c = lg.counts(text)
        f = np.flatnonzero(c)
        rows.append((other, f, c[f]))
    model = lg.Model(["a", "b"], np.ones(lg.FEATURES)).fit(rows)
    used = np.unique(np.concatenate([f for _, f, _ in rows]))
    assert not model.weights[np.setdiff1d(np.arange(lg.FEATURES), used)].any()
    lang, score = model.predict("aa ab aa aa ab")
    assert lang == "a" and 0.65 < score < 0.95  # as sure as the labels allow


def test_edge_rows(spark):
    rows = [(1, "hello there", "en"), (1, "hello there", "en"), (2, None, "en"), (3, "  12 !", "de"), (None, "x", "en"), (4, "a" * 3000000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = lg.learn(docs)
    assert model.languages == ["de", "en"]
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in lg.identify(docs, model).collect())
    assert len(got) == len(rows) and all(0 <= x[2] <= 1 for x in got)
    assert [x[1] for x in got if x[0] in "23"] == ["und", "und"]
    empty = lg.learn(docs.limit(0))
    assert lg.identify(docs, empty).where("lang_pred <> 'und'").count() == 0
    assert lg.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_language"](spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.97
    assert abs(np.mean([r.score for r in held]) - right) < 0.05
