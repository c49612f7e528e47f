import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking as ch
from lectern.operators.ordered import block_of, previous_value, running_total
from lectern.operators.skew import lookup_join, spread_join


def plain_chunks(segments, size, overlap):
    out = set()
    by_video = {}
    for video, start, text in segments:
        by_video.setdefault(video, []).append((start, text))
    for video, rows in by_video.items():
        rows.sort()
        text = " ".join(t for _, t in rows if t is not None)
        for k, i in enumerate(range(0, len(text), size - overlap)):
            out.add((video, k, text[i : i + size], rows[0][0]))
    return out


@pytest.mark.parametrize("span", [1, 2, 7, 256])
@pytest.mark.parametrize("size, overlap", [(20, 5), (7, 0), (50, 49)])
def test_chunk_equals_plain_python(spark, span, size, overlap):
    rnd = random.Random(size)
    rows = []
    for video in "abc":
        for start in range(rnd.randint(1, 40)):
            rows.append((video, float(start), "".join(rnd.choice("xyé ") for _ in range(rnd.randint(0, 15)))))
    df = spark.createDataFrame(rows, "video_id string, start double, normalized_text string")
    got = {tuple(r) for r in ch.chunk(df, size, overlap, block_span=span).collect()}
    assert got == plain_chunks(rows, size, overlap)


def test_chunk_sizes(spark):
    rows = [("a", 0.0, "x" * 950), ("b", 0.0, "x" * 900), ("c", 0.0, ""), ("d", 0.0, None)]
    df = spark.createDataFrame(rows, "video_id string, start double, normalized_text string")
    got = sorted((r.video_id, r.chunk_id, len(r.normalized_text)) for r in ch.chunk(df).collect())
    assert got == [("a", 0, 950), ("a", 1, 50), ("b", 0, 900)]


def test_chunk_rejects_large_overlap(spark):
    df = spark.createDataFrame([], "video_id string, start double, normalized_text string")
    with pytest.raises(ValueError):
        ch.chunk(df, 20, 100)


def test_chunk_reads_its_input_once(spark, tmp_path):
    df = spark.createDataFrame([("a", float(i), "word") for i in range(50)], "video_id string, start double, normalized_text string")
    df.write.parquet(str(tmp_path / "s"))
    out = ch.chunk(spark.read.parquet(str(tmp_path / "s")))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_running_values_over_blocks(spark):
    rnd = random.Random(3)
    rows = [("k" if i % 3 else "m", float(o), rnd.randint(-5, 9)) for i, o in enumerate(rnd.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "k string, o double, n int")
    total = running_total(df, ["k"], ["o"], block_of(F.col("o"), 10), F.col("n"), "t")
    before = previous_value(df, ["k"], ["o"], block_of(F.col("o"), 10), F.col("n"), "p")
    want_t, want_p = {}, {}
    for k in "km":
        acc, prev = 0, None
        for o, n in sorted((o, n) for kk, o, n in rows if kk == k):
            want_t[k, o], want_p[k, o] = acc, prev
            acc, prev = acc + n, n
    assert {(r.k, r.o): r.t for r in total.collect()} == want_t
    assert {(r.k, r.o): r.p for r in before.collect()} == want_p


def test_merge_by_gap_and_spans(spark):
    rows = [("a", 0.0, 1.0), ("a", 3.0, 1.0), ("a", 9.0, 2.0), ("a", 15.9, 1.0), ("b", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id string, start double, duration double")
    merged = ch.merge_by_gap(df, 5.0, block_span=2)
    assert sorted((r.video_id, r.start, r.group_id) for r in merged.collect()) == [
        ("a", 0.0, 0), ("a", 3.0, 0), ("a", 9.0, 1), ("a", 15.9, 1), ("b", 7.0, 0),
    ]
    spans = {(r.video_id, r.group_id): (r.start, round(r.duration, 6), r.num_segments) for r in ch.gap_spans(merged).collect()}
    assert spans == {("a", 0): (0.0, 4.0, 2), ("a", 1): (9.0, 7.9, 2), ("b", 0): (7.0, 1.0, 1)}


def test_chunk_spans(spark):
    rows = [("a", 0.0, 1.0, "x" * 8), ("a", 1.0, 1.0, ""), ("a", 2.0, 1.0, "y" * 12), ("a", 3.0, 2.0, "z")]
    df = spark.createDataFrame(rows, "video_id string, start double, duration double, normalized_text string")
    # joined: 8 x, space, space, 12 y, space, z = 24 characters; chunks at 0..10, 8..18, 16..24
    got = sorted(tuple(r) for r in ch.chunk_spans(df, 10, 2, block_span=2).collect())
    assert got == [("a", 0, 0.0, 1.0, 1), ("a", 1, 2.0, 1.0, 1), ("a", 2, 2.0, 3.0, 2)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_with_hot_keys(spark, how):
    rows = [("hot" if i % 2 else f"k{i % 7}", i) for i in range(200)] + [(None, 999)]
    big = spark.createDataFrame(rows, "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3), ("other", 4)], "k string, w int")
    got = sorted(spread_join(big, small, ["k"], ["i"], how, slice_rows=10).collect(), key=str)
    assert got == sorted(big.join(small, ["k"], how).collect(), key=str)
    assert sorted(lookup_join(big, small, ["k"], ["i"], how).collect(), key=str) == got
    assert sorted(lookup_join(big, small, ["k"], ["i"], how, max_rows=2).collect(), key=str) == got
