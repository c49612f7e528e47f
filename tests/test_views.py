import pytest

from lectern.operators import sentiment as sn
from lectern.plans import views as v


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for topic, n in ((0, 2), (1, 2), (-1, 9)):
        for i in range(n):
            rows.append(("a", len(rows), f"text {topic}", 0.0, "A title", topic, 0.1 * topic))
    rows.append(("b", 0, "noise", 0.0, "B title", -1, -0.5))
    return spark.createDataFrame(
        rows, "video_id string, chunk_id bigint, normalized_text string, start_time double, title string, topic_id int, sentiment double"
    )


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(-1, "-1_x"), (0, "0_y"), (1, "1_z")], "topic_id int, name string")


def test_dominant_topic(chunks):
    got = [tuple(r) for r in v.dominant_topic(chunks).collect()]
    assert got == [("a", 0, 2, pytest.approx(2 / 13 * 100))]


def test_overview(chunks):
    assert tuple(v.overview(chunks).first()) == (14, 2, 2)


def test_video_sentiment_keeps_videos_of_outliers(chunks, names):
    got = {r.title: (r.dominant_topic, r.url) for r in v.video_sentiment(chunks, names).collect()}
    assert got == {
        "A title": ("0_y", "https://www.youtube.com/watch?v=a"),
        "B title": (None, "https://www.youtube.com/watch?v=b"),
    }


def test_explore_filters(chunks, names):
    assert v.explore(chunks, names, ["b"]).count() == 1
    assert v.explore(chunks, names, pattern="text [01]").count() == 4
    assert v.explore(chunks, names, ["b"], "text").count() == 0


def test_topic_options_skip_outliers(names):
    assert sorted(r.label for r in v.topic_options(names).collect()) == ["Topic 0: 0_y", "Topic 1: 1_z"]


def test_timeline_of_one_video(spark):
    rows = [("a", i, float(s), i / 10) for i, s in ((0, 5), (1, 5), (2, 0), (3, 5000), (4, 0))]
    df = spark.createDataFrame(rows, "video_id string, chunk_id bigint, start_time double, sentiment double")
    got = {r.chunk_id: r.x for r in v.sentiment_timeline(df, "a").collect()}
    assert got == {2: 0, 4: 1, 0: 2, 1: 3, 3: 4}
    assert v.sentiment_timeline(df, "none").count() == 0


def test_titles_do_not_multiply_chunks(chunks, spark):
    meta = spark.createDataFrame([("a", "T"), ("a", "T"), ("c", "C")], "video_id string, title string")
    got = v.with_titles(chunks.drop("title"), meta)
    assert got.count() == chunks.count()
    assert {(r.video_id, r.title) for r in got.collect()} == {("a", "T"), ("b", None)}


def test_has_scores(chunks):
    assert v.has_scores(chunks)
    assert not v.has_scores(chunks.drop("sentiment"))
    assert not v.has_scores(chunks.where("false"))


def test_sample_is_exact_and_stable(spark):
    df = spark.range(3000).selectExpr("cast(id % 7 as string) as video_id", "id as chunk_id")
    for n in (0, 1, 250, 2999):
        top = {tuple(r) for r in v.sample_n(df, n).collect()}
        cut = {tuple(r) for r in v.sample_n(df.repartition(5), n, sort_limit=-1).collect()}
        assert len(top) == n and top == cut
    assert v.sample_n(df, 5000, sort_limit=10).count() == 3000
    assert v.sample_n(df, None).count() == 3000
    assert {tuple(r) for r in v.sample_n(df, 50, seed=1).collect()} != {tuple(r) for r in v.sample_n(df, 50).collect()}


def test_sentiment_by_topic(spark):
    rows = [(1, 0, 0.9, 0.1, 0.8, 0.0), (2, 1, 0.1, 0.9, 0.0, 0.8), (3, 0, 0.8, 0.2, 0.7, 0.1), (4, 1, 0.2, 0.8, 0.1, 0.7)]
    cols = "chunk_id int, topic_id int, polarity_positive double, polarity_negative double, emotion_joy double, emotion_sadness double"
    df = spark.createDataFrame(rows, cols)
    got = [tuple(round(x, 6) for x in r) for r in sn.sentiment_by_topic(df).collect()]
    assert got == [(0, 0.85, 0.15, 0.75, 0.05), (1, 0.15, 0.85, 0.05, 0.75)]
    long = sn.sentiment_long(sn.sentiment_by_topic(df))
    assert long.count() == 8 and long.columns == ["topic_id", "sentiment", "score"]
    with pytest.raises(ValueError):
        sn.sentiment_by_topic(df.drop("topic_id"))
    only = df.select("topic_id")
    assert sorted(r.topic_id for r in sn.sentiment_by_topic(only).collect()) == [0, 1]
    assert sn.sentiment_long(only) is None


def test_polarity_learns_the_labels(spark):
    texts = spark.createDataFrame(
        [("good fine day", "positive"), ("bad awful day", "negative"), ("table chair day", "neutral")], "normalized_text string, label string"
    )
    weights, bias = sn.learn_polarity(texts)
    chunks = spark.createDataFrame(
        [("v", 0, "good good"), ("v", 1, "awful"), ("v", 2, ""), ("v", 3, "unknown")], "video_id string, chunk_id bigint, normalized_text string"
    )
    got = {r.chunk_id: r for r in sn.score_polarity(chunks, weights, bias).collect()}
    assert len(got) == 4
    assert got[0].sentiment > 0.1 and got[1].sentiment < -0.1
    assert abs(got[2].sentiment) < 1e-9 and abs(got[3].sentiment) < 1e-9
    for r in got.values():
        assert r.polarity_positive + r.polarity_neutral + r.polarity_negative == pytest.approx(1)


def test_many_words_score_by_blocks_as_by_a_broadcast(spark, monkeypatch):
    rows = [("good fine day", "positive"), ("bad bad day", "negative"), ("table of things", "neutral")]
    texts = spark.createDataFrame(rows, "normalized_text string, label string")
    cells = ["good bad day a", "", None, "unseen words good", "bad  day ", "x", "fine"] * 9
    chunks = spark.createDataFrame(
        [(f"v{i % 4}", i, t) for i, t in enumerate(cells)], "video_id string, chunk_id bigint, normalized_text string"
    )
    found = sn.learn_polarity(texts)
    score = lambda: {(r.video_id, r.chunk_id): r for r in sn.score_polarity(chunks, *found).collect()}
    want = score()
    monkeypatch.setattr(sn, "MAX_VOCABULARY", 3)
    monkeypatch.setattr(sn, "BLOCK_CHARS", 60)
    # The weights and the texts of a chunk must not meet word by word: only one row per block and word is moved.
    monkeypatch.setattr(sn.F, "explode_outer", None)
    got = score()
    assert got.keys() == want.keys() and len(got) == len(cells)
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_many_words_score_with_one_shuffle_of_the_texts(spark, monkeypatch, tmp_path):
    rows = [("good fine day", "positive"), ("bad bad day", "negative"), ("table of things", "neutral")]
    found = sn.learn_polarity(spark.createDataFrame(rows, "normalized_text string, label string"))
    chunks = spark.createDataFrame([("v", i, "good bad day") for i in range(40)], "video_id string, chunk_id bigint, normalized_text string")
    chunks.write.parquet(str(tmp_path / "c"))
    monkeypatch.setattr(sn, "MAX_VOCABULARY", 3)
    monkeypatch.setattr(sn, "BLOCK_CHARS", 60)
    out = sn.score_polarity(spark.read.parquet(str(tmp_path / "c")), *found)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    dealt = [x for x in final.split("\n") if "hashpartitioning(_block" in x]
    assert sum("ReusedExchange" not in x for x in dealt) == 1 and any("ReusedExchange" in x for x in final.split("\n"))


def test_emotions_are_independent(spark):
    texts = spark.createDataFrame(
        [("happy sun", True, False), ("sad rain", False, True), ("happy tears", True, True)], "normalized_text string, joy boolean, grief boolean"
    )
    weights, bias = sn.learn_emotions(texts, ["joy", "grief"])
    chunks = spark.createDataFrame([("v", 0, "happy"), ("v", 1, "rain rain")], "video_id string, chunk_id bigint, normalized_text string")
    got = {r.chunk_id: r for r in sn.score_emotions(chunks, weights, bias, ["joy", "grief"]).collect()}
    assert got[0].emotion_joy > got[1].emotion_joy and got[1].emotion_grief > got[0].emotion_grief


def test_model_scores(spark):
    def factory():
        import numpy as np

        return lambda texts: np.array([[0.7, 0.2] if "good" in t else [0.1, 0.6] for t in texts])

    df = spark.createDataFrame([("good",), ("bad",)], "normalized_text string")
    got = sn.score_with_model(df, factory, ["positive", "negative"], "polarity_").collect()
    assert [round(r.sentiment, 6) for r in got] == [0.5, -0.5]


def test_enriched_chunks_have_topics_polarity_and_emotions(spark, sf_dir):
    """All that the method puts next to a chunk, as the queries of its own have it."""
    from registry.all import QUERIES

    key = lambda r: (r.video_id, r.chunk_id)
    got = {key(r): r for r in QUERIES["enrich_chunks"](spark, sf_dir).collect()}
    emotions = {key(r): r for r in QUERIES["emotions"](spark, sf_dir).collect()}
    assert got.keys() == emotions.keys() and got
    for k, r in got.items():
        assert (r.emotion_approval, r.emotion_annoyance) == emotions[k][2:]
        assert r.topic_id is not None and r.polarity_negative + r.polarity_neutral + r.polarity_positive == pytest.approx(1, abs=1e-5)
