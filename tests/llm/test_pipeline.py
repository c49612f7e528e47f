"""The pipeline, stage by stage, against brute-force versions of what each stage decides."""

import zlib

import numpy as np

import corpus_pipeline as cp
from lectern.llm import privacy, quality
from lectern.llm.queries import QUERIES
from lectern.session import cut_lineage
from tests.llm.test_decontaminate import words as alnum_words
from tests.llm.test_near_copies import plain as plain_components
from tests.llm.test_output import BYTE, plain as plain_ids

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    schema = docs.schema
    rows = {r.doc_id: r for r in docs.collect()}

    kept = cut_lineage(cp.quality_rules(spark, docs, D))
    good = {r.doc_id for r in QUERIES["op3_quality"](spark, D).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and len(good) > 100

    single = cut_lineage(cp.near_copy_join(spark, kept, D))
    groups = plain_components([(i, rows[i].text) for i in sorted(good)])
    assert {str(r.doc_id) for r in single.collect()} == {c for _, _, c in groups}

    clean = cut_lineage(cp.benchmark_decontamination(spark, single, D))
    windows = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = alnum_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}

    def hit(text):
        w = alnum_words(text)
        return any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hit(r.text)}

    private = cut_lineage(cp.personal_data(spark, clean, D))
    for x in (kept, single, clean, private):
        assert [(f.name, f.dataType) for f in x.schema] == [(f.name, f.dataType) for f in schema]
    texts = {r.doc_id: r for r in private.collect()}
    for r in clean.collect():
        now = texts[r.doc_id]
        base = privacy.base_spans(r.text)
        assert all(r.text[a:b] not in now.text for _, a, b in base) and privacy.base_spans(now.text) == []
        assert now.n_chars == len(now.text) and (now.text == r.text) == (not base) or len(now.text) != len(r.text)

    pieces = cp.packed(spark, private, D).collect()
    joined = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = plain_ids(BYTE, texts[p.doc_id].text)
        own = ids[p.start : p.start + p.length]
        assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(np.array(own, "<u4").tobytes()), len(ids))
        assert joined.get(p.doc_id, 0) == p.start
        joined[p.doc_id] = p.start + p.length
    assert joined == {i: len(plain_ids(BYTE, r.text)) for i, r in texts.items()}


def test_run_on_edge_rows(spark, tmp_path):
    long = " ".join(f"word{i} stands" for i in range(30000))
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "a", 0), (None, long, None, None, 9),
            (3, long, "en", "b", 9), (3, long, "en", "b", 9)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {3} and sum(p.length for p in got) == got[0].doc_tokens
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "x", 9, True, 7, "k")], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, hits string")
    assert quality.accepted(docs).columns == docs.columns
