import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.config import Settings, TopicSettings
from lectern.operators import sentiment as sn
from lectern.plans.ingest import ingest
from lectern.plans.process import evaluate, process
from lectern.sources import captions as cp
from lectern.sources import reports, tables, video_ids
from lectern.sources.models import load_topic_model

LINKS = """https://youtu.be/X?si=1
https://www.youtube.com/watch?v=Y&t=3

  Z
https://youtube.com/shorts/Q
https://m.youtube.com/watch?t=1&v=a%2Db+c&v=second
youtube.com/watch?v=noscheme
https://example.org/?u=youtube.com
https://user@www.youtube.com:443/watch?v=up
https://www.youtube.com/watch?v=
Z
"""


def test_video_ids(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text(LINKS)
    got = [r.video_id for r in video_ids.read_video_ids(spark, str(path)).orderBy("line_key").collect()]
    assert got == ["X", "Y", "Z", "a-b c", "up"]
    every = [r.video_id for r in video_ids.read_video_ids(spark, str(path), dedupe=False).orderBy("line_key").collect()]
    assert every == got + ["Z"]
    assert [r.video_id for r in video_ids.read_video_ids(spark, str(path), 2).collect()] == ["X", "Y"]
    assert video_ids.read_video_ids(spark, str(path), 0).count() == 0
    more = video_ids.read_video_ids(spark, str(path), path_pattern="^/(?:shorts|live)/([^/]+)")
    assert "Q" in [r.video_id for r in more.collect()]


def test_url_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url,note\nhttps://youtu.be/X,n\n")
    (tmp_path / "b.csv").write_text("link\nx\n")
    assert video_ids.read_url_csv(spark, str(tmp_path / "a.csv")).first()["url"] == "https://youtu.be/X"
    with pytest.raises(ValueError):
        video_ids.read_url_csv(spark, str(tmp_path / "b.csv"))


VTT = "WEBVTT\nKind: captions\nLanguage: en\n\nt1 --> t2\nhi\n there\t\n\nt3 --> t4\n\nt5 --> t6\nbye\nKind: regards"


def test_captions(spark):
    files = spark.createDataFrame([("v", VTT), ("w", ""), ("u", "WEBVTT\n\nt1 --> t2\nhi\nthere\n\nt3 --> t4\nbye")], "video_id string, content string")
    got = sorted((r.video_id, r.segment, r.text) for r in cp.parse_captions(files).collect())
    assert got == [("u", 0, "hi there"), ("u", 1, "bye"), ("v", 0, "hi there"), ("v", 1, "bye Kind: regards")]
    kept = cp.parse_captions(files, strip_header=False).where("video_id = 'v'").orderBy("segment").collect()
    assert [r.text for r in kept] == ["Kind: captions Language: en", "hi there", "bye Kind: regards"]
    rows = cp.build_transcripts(cp.parse_captions(files))
    assert rows.schema == cp.TRANSCRIPTS or [f.dataType for f in rows.schema] == [f.dataType for f in cp.TRANSCRIPTS]
    assert cp.empty_transcripts(spark).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([("20240131",), ("20240230",), ("x",), (None,), ("2024131",)], "d string")
    got = [r[0] for r in df.select(cp.parse_day(F.col("d"))).collect()]
    assert got == [dt.date(2024, 1, 31), None, None, None, None]


def test_table_groups(spark, tmp_path):
    base = str(tmp_path / "p")
    assert tables.read_tables(spark, base, "raw") == {}
    tables.write_tables({"transcripts": spark.range(3), "metadata": spark.range(2)}, base, "raw")
    got = tables.read_tables(spark, base, "raw")
    assert {k: df.count() for k, df in got.items()} == {"transcripts": 3, "metadata": 2}
    assert tables.register_views(spark, base) == ["raw_transcripts", "raw_metadata"]
    assert tables.query(spark, "SELECT count(*) AS n FROM raw_transcripts WHERE id >= :low", low=1).first().n == 2
    assert tables.describe_schema(spark, tables.table_path(base, "raw", "metadata")).names == ["id"]
    vectors = spark.createDataFrame([("v", 0, [0.5, 1.0])], "video_id string, chunk_id bigint, embedding array<float>")
    tables.save_vectors(vectors, base, "main")
    assert tables.load_vectors(spark, base, "main").collect() == vectors.collect()
    with pytest.raises(FileNotFoundError):
        tables.load_vectors(spark, base, "other")


def test_report_round_trip(spark, tmp_path):
    info = spark.createDataFrame(
        [(0, 7, "0_a", ["a", 'b "q"'], ["one, two", "three"]), (-1, 3, "-1_x", ["x"], [])],
        "Topic int, Count bigint, Name string, Representation array<string>, Representative_Docs array<string>",
    )
    reports.write_report_csv(info, str(tmp_path / "r"))
    report, scores = reports.read_report_csv(spark, str(tmp_path / "r"))
    got = {r.Topic: r for r in report.collect()}
    assert scores == [] and set(got) == {0, -1}
    assert got[0].Representation == 'a, b "q"' and got[0].Representative_Docs == "one, two\n---\nthree"
    (tmp_path / "s.csv").write_text("Topic,c_v,u_mass\n1,0.5,-2\n")
    assert reports.read_report_csv(spark, str(tmp_path / "s.csv"))[1] == ["c_v", "u_mass"]


def test_ingest_process_evaluate(spark, tmp_path):
    themes = {"cook": "bread flour oven butter dough", "car": "engine wheel brake motor fuel", "sea": "wave sail harbour anchor reef"}
    links, meta = [], []
    (tmp_path / "vtt").mkdir()
    for n in range(24):
        name = list(themes)[n % 3]
        words = themes[name].split()
        vid = f"{name}{n}"
        links.append(f"https://youtu.be/{vid}")
        lines = [" ".join(words[(i + j) % 5] for j in range(3 + (i + n) % 3)) for i in range(4)]
        cues = "\n\n".join(f"00:0{i} --> 00:0{i + 1}\n{line}" for i, line in enumerate(lines))
        (tmp_path / "vtt" / f"{vid}.en.vtt").write_text(f"WEBVTT\nKind: captions\n\n{cues}\n")
        meta.append(json.dumps({"id": vid, "title": f"About {vid}", "channel_id": "c", "channel": "C", "upload_date": f"202401{5 + n % 9:02d}", "view_count": n}))
    (tmp_path / "links.txt").write_text("\n".join([*links, "https://youtu.be/missing", links[0]]))
    (tmp_path / "meta.json").write_text("\n".join(meta))
    base = str(tmp_path / "data")
    raw = ingest(spark, str(tmp_path / "links.txt"), str(tmp_path / "vtt"), str(tmp_path / "meta.json"), base)
    assert raw["metadata"].agg({"publish_date": "min"}).first()[0] == dt.date(2024, 1, 5)

    labelled = spark.createDataFrame(
        [("bread butter", "positive"), ("brake fuel", "negative"), ("reef", "neutral")], "normalized_text string, label string"
    )
    settings = Settings(topics=TopicSettings(dims=64, project_dims=2, cell_size=0.3, min_cluster_size=3, min_df=1))
    model = process(spark, base, sn.learn_polarity(labelled), settings=settings)
    chunks = tables.read_tables(spark, base, "processed")["chunks"]
    rows = chunks.collect()
    assert len(rows) == 24 and all(r.title == f"About {r.video_id}" for r in rows)
    kinds = {}
    for r in rows:
        kinds.setdefault(r.topic_id, set()).add(r.video_id[:3])
    assert all(len(k) == 1 for t, k in kinds.items() if t != -1) and len(kinds) >= 3
    assert {"sentiment", "polarity_positive", "embedding_umap_x"} <= set(chunks.columns)
    assert sum(r.Count for r in model.topic_info.collect()) == 24

    loaded = load_topic_model(spark, f"{base}/model")
    assert loaded.tables["hierarchy"].count() == len([t for t in kinds if t != -1]) - 1
    info = evaluate(spark, base, str(tmp_path / "report"))
    report, scores = reports.read_report_csv(spark, str(tmp_path / "report"))
    assert report.count() == info.count() and scores == ["c_v", "c_npmi", "u_mass"]
    assert {"diversity"} <= set(report.columns) and report.where("Topic <> -1 and c_v is null").count() == 0
    assert loaded.tables["topics_over_time"].select("bin").distinct().count() > 1
    assert tables.register_views(spark, base) == ["raw_transcripts", "raw_metadata", "processed_chunks"]

    fixed = Settings(
        topics=TopicSettings(dims=64, project_dims=2, cell_size=0.3, min_cluster_size=3, min_df=1, num_topics=2)
    )
    process(spark, base, sn.learn_polarity(labelled), settings=fixed, sample=20)
    again = tables.read_tables(spark, base, "processed")["chunks"]
    assert again.count() == 20 and {r.topic_id for r in again.collect()} - {-1} == {0, 1}


def test_process_of_empty_tables(spark, tmp_path):
    from lectern.sources.captions import TRANSCRIPTS

    meta = "video_id string, title string, channel_id string, channel_name string, publish_date date, view_count bigint"
    raw = {"transcripts": spark.createDataFrame([], TRANSCRIPTS), "metadata": spark.createDataFrame([], meta)}
    tables.write_tables(raw, str(tmp_path), "raw")
    labelled = spark.createDataFrame([("bread butter", "positive")], "normalized_text string, label string")
    model = process(spark, str(tmp_path), sn.learn_polarity(labelled))
    assert tables.read_tables(spark, str(tmp_path), "processed")["chunks"].count() == 0
    assert model.topic_info.count() == 0 and model.tables["hierarchy"].count() == 0
    assert load_topic_model(spark, f"{tmp_path}/model").topic_info.count() == 0


def test_process_needs_raw_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        process(spark, str(tmp_path), (None, None))


def test_labelled_texts_are_cleaned_once_for_both_models(spark, sf_dir, monkeypatch):
    from registry import sources

    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("v", "good day", "positive", True, False), ("w", "bad day", "negative", False, True)]
    texts = spark.createDataFrame(rows, "video_id string, normalized_text string, label string, approval boolean, annoyance boolean")
    monkeypatch.setattr(sources.b, "labelled_norm", lambda spark, d: texts.mapInArrow(read, texts.schema))

    def learned(spark, base, polarity, emotions):
        assert {r.word for r in polarity[0].collect()} == {r.word for r in emotions[0].collect()} == {"good", "bad", "day"}
        assert polarity[1].count() == emotions[1].count() == 1
        sources.tb.write_tables({"chunks": texts.select("video_id", "normalized_text")}, base, "processed")

    monkeypatch.setattr(sources, "process", learned)
    assert sources.Q["process"](spark, sf_dir).count() == 2
    assert seen.value == 2
