import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import coherence as co
from lectern.operators import labels as lb
from lectern.operators import overtime as ot
from lectern.operators import terms as tm
from lectern.session import cut_lineage

TEXTS = [
    ("v1", 0, 0, "apple pie apple tart"),
    ("v1", 1, 0, "apple cake baking"),
    ("v2", 0, 1, "engine wheel apple"),
    ("v2", 1, 1, "engine oil wheel engine"),
    ("v3", 0, -1, "wheel baking oil"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(TEXTS, "video_id string, chunk_id bigint, topic_id int, normalized_text string")


def plain_counts(min_df=2):
    tf = Counter()
    for _, _, topic, text in TEXTS:
        w = text.split()
        for t in w + [" ".join(p) for p in zip(w, w[1:])]:
            tf[topic, t] += 1
    topics = Counter(t for _, t in tf)
    return {k: n for k, n in tf.items() if topics[k[1]] >= min_df}


def test_counts_and_ctfidf(chunks):
    want = plain_counts()
    counts = tm.term_counts(chunks, stop_words=[])
    assert {(r.topic_id, r.term): r.tf for r in counts.collect()} == want
    size = Counter()
    total = Counter()
    for (topic, term), n in want.items():
        size[topic] += n
        total[term] += n
    mean = math.floor(sum(size.values()) / len(size))
    got = {(r.topic_id, r.term): r.score for r in tm.ctfidf(counts).collect()}
    for (topic, term), n in want.items():
        assert got[topic, term] == pytest.approx(n / size[topic] * math.log(1 + mean / total[term]))


def test_english_stop_words_are_the_default(spark):
    df = spark.createDataFrame([(0, "the apple and pears"), (1, "the apple and pears")], "topic_id int, normalized_text string")
    assert {r.term for r in tm.term_counts(df).collect()} == {"apple", "pears", "apple pears"}


def test_topic_info_with_documents(chunks):
    weights = tm.ctfidf(tm.term_counts(chunks, stop_words=[]))
    docs = tm.representative_docs(chunks, weights, 1, stop_words=[])
    info = {r.Topic: r for r in tm.topic_info(chunks, tm.topic_keywords(weights), docs).collect()}
    assert set(info) == {-1, 0, 1}
    assert info[0].Count == 2 and info[0].Name.startswith("0_apple")
    assert info[0].Representative_Docs == ["apple pie apple tart"]
    assert len(info[1].Representation) <= 10


@pytest.mark.parametrize("max_n", [1, 2])
def test_representative_docs_by_slices_equal_plain_cosine(spark, monkeypatch, max_n):
    """Slices of some words: the terms of a slice meet its topic's weights once, those of other topics never."""
    rng = random.Random(max_n)
    rows = [(f"v{i % 5}", i, i % 3 - 1, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "x", "only" * (i % 7)], k=i % 11))) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id string, chunk_id bigint, topic_id int, normalized_text string")
    weights = tm.ctfidf(tm.term_counts(df, stop_words=["ee"], max_n=max_n)).localCheckpoint()
    table = {(r.topic_id, r.term): (r.idf, r.score) for r in weights.collect()}
    best = defaultdict(list)
    for video, chunk, topic, text in rows:
        words = [w for w in text.split() if len(w) > 1 and w != "ee"]
        terms = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])] * (max_n - 1))
        found = [(n, *table[topic, t]) for t, n in terms.items() if (topic, t) in table]
        norm = math.sqrt(sum(s * s for (k, _), (_, s) in table.items() if k == topic))
        if found:
            close = sum(n * i * s for n, i, s in found) / math.sqrt(sum((n * i) ** 2 for n, i, _ in found)) / norm
            best[topic].append((-round(close, 9), video, chunk))
    monkeypatch.setattr(tm, "SLICE_CHARS", 60)
    got = tm.representative_docs(df, weights, 4, stop_words=["ee"], max_n=max_n).collect()
    assert sorted((r.topic_id, r["rank"], r.video_id, r.chunk_id) for r in got) == sorted(
        (topic, rank, video, chunk) for topic in best for rank, (_, video, chunk) in enumerate(sorted(best[topic])[:4], 1)
    )


def test_distances_equal_plain_cosine(spark):
    rnd = random.Random(5)
    rows = [(t, f"w{w}", rnd.random()) for t in (-1, 0, 1, 2, 7) for w in rnd.sample(range(30), 12)]
    rows.append((9, "alone", 1.0))
    df = spark.createDataFrame(rows, "topic_id int, term string, score double")
    vec = defaultdict(dict)
    for t, w, s in rows:
        vec[t][w] = s
    for block, per in ((512, 1024), (2, 3)):
        got = {(r.topic_a, r.topic_b): r.distance for r in tm.topic_distances(df, block, per).collect()}
        assert set(got) == {(a, b) for a in vec for b in vec if -1 < a < b}
        for (a, b), d in got.items():
            dot = sum(s * vec[b].get(w, 0) for w, s in vec[a].items())
            norm = math.prod(math.sqrt(sum(s * s for s in vec[x].values())) for x in (a, b))
            assert d == pytest.approx(1 - dot / norm)
        near = {(r.topic_a, r.topic_b): r.distance for r in tm.related_topics(df, block, per).collect()}
        assert near == {k: pytest.approx(got[k]) for k in got if vec[k[0]].keys() & vec[k[1]].keys()} and len(near) < len(got)


def windows_of(text, size):
    w = text.split()
    if size is None or len(w) <= size:
        return [set(w)] if w else []
    return [set(w[i : i + size]) for i in range(len(w) - size + 1)]


def test_pairs_of_many_topics_come_in_bounded_parts(monkeypatch):
    """A thousand terms of 20,000 topics: one matrix per pair of blocks would be 820 of them."""
    monkeypatch.setattr(tm, "HELD_PAIRS", 5000)
    rng = np.random.default_rng(1)
    sizes = [*rng.integers(1, 40, 998).tolist(), 300, 700]
    lists = [rng.choice(np.arange(-7, 20_000), n, replace=False).astype(np.int32) for n in sizes]
    scores = [rng.random(n) for n in sizes]
    batch = pa.record_batch([pa.array(lists), pa.array(scores)], names=["topics", "scores"])
    want = {}
    for names, values in zip(lists, scores, strict=True):
        order = np.argsort(names)
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                pair = names[a].item(), names[b].item()
                want[pair] = want.get(pair, 0.0) + values[a] * values[b]
    got = {}
    for pairs, dots in tm._pair_products(batch, 512):
        assert len(pairs) <= max(5000 + 128, 512 * 512)
        for pair, dot in zip(pairs.tolist(), dots.tolist(), strict=True):
            b = pair & 0xFFFFFFFF
            pair = pair >> 32, b - (b >> 31 << 32)
            got[pair] = got.get(pair, 0.0) + dot
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_window_counts_equal_listed_windows(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rnd.randint(0, 15))) for _ in range(60)]
    chunks = spark.createDataFrame([(t,) for t in texts], "normalized_text string")
    top = spark.createDataFrame([(0, "aa"), (0, "bb"), (0, "cc"), (1, "cc"), (1, "ee")], "topic_id int, word string")
    wanted = {(a, b) for g in (("aa", "bb", "cc"), ("cc", "ee")) for a in g for b in g}
    for size in (3, 10, None):
        want = Counter()
        for t in texts:
            for win in windows_of(t, size):
                for a, b in wanted:
                    want[a, b] += a in win and b in win
        want = {k: n for k, n in want.items() if n}
        got = {(r.word_i, r.word_j): r.n for r in co.pair_counts(chunks, top, size).collect()}
        assert got == want
        monkeypatch.setattr(co, "MAX_TOP_WORDS", 2)
        sliced = {(r.word_i, r.word_j): r.n for r in co.pair_counts(chunks, top, size).collect()}
        monkeypatch.undo()
        assert sliced == want


def test_diversity(spark):
    rows = [(0, "a"), (0, "b"), (1, "a"), (1, "c"), (-1, "z")]
    words = spark.createDataFrame(rows, "topic_id int, word string")
    assert tm.topic_diversity(words).first()[0] == 0.75


def test_time_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 5.0, 5.1, 10.0, None)], "t double")
    got = {r.t: (r.bin, r.bin_start) for r in ot.with_time_bin(df, "t", 2).collect()}
    assert got == {0.0: (0, 0.0), 5.0: (0, 0.0), 5.1: (1, 5.0), 10.0: (1, 5.0)}
    same = spark.createDataFrame([(3.0,), (3.0,)], "t double")
    assert {r.bin for r in ot.with_time_bin(same, "t", 20).collect()} == {0}


def plain_over_time(rows, weights, bins, glob, evo):
    lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
    number = lambda t: min(max(math.ceil((t - lo) * bins / (hi - lo)) - 1, 0), bins - 1)
    periods = sorted({number(r[0]) for r in rows})
    out = {}
    for topic in {r[1] for r in rows}:
        terms = {t: v for (k, t), v in weights.items() if k == topic}
        total = sum(s for _, s in terms.values())
        before, last = None, None
        for p, b in enumerate(periods):
            here = [r for r in rows if r[1] == topic and number(r[0]) == b]
            if not here:
                continue
            tf = Counter()
            for _, _, text in here:
                w = text.split()
                tf.update(t for t in w + [" ".join(x) for x in zip(w, w[1:])] if t in terms)
            x = {t: tf[t] * terms[t][0] for t in terms}
            if glob or evo:
                s = sum(x.values())
                x = {t: v / s if s else 0.0 for t, v in x.items()}
            else:
                s = sum(tf.values())
                x = {t: v / s if s else 0.0 for t, v in x.items()}
            if evo and last == p - 1:
                x = {t: (x[t] + before[t]) / 2 for t in x}
            if glob:
                x = {t: (x[t] + terms[t][1] / total) / 2 for t in x}
            before, last = x, p
            best = sorted((t for t in x if x[t] > 0), key=lambda t: (-round(x[t], 12), t))[:5]
            out[topic, b] = (len(here), ", ".join(best))
    return out


def test_topics_over_time_moves_words_once(spark, monkeypatch):
    """The written table is one row per (topic, term), and the weights are not joined a second time."""
    rows = [(float(i % 7), i % 2, f"aa b{i % 3} cc d{i % 5}d") for i in range(40)]
    df = spark.createDataFrame(rows, "t double, topic_id int, normalized_text string")
    weights = tm.ctfidf(tm.term_counts(df, stop_words=[])).localCheckpoint()
    written = []
    monkeypatch.setattr(ot, "cut_lineage", lambda d: written.append(d.localCheckpoint()) or written[-1])
    ot.topics_over_time(df, weights, "t", 5, stop_words=[]).collect()
    per_term = [d for d in written if "term" in d.columns]
    assert len(per_term) == 1 and per_term[0].count() == weights.count()


def test_nth_largest_of_a_group():
    topic, value = np.array([0, 1, 0, 0, 1, 0]), np.array([3.0, 1, 2, 3, 5, 1])
    assert ot._nth(topic, value, 2).tolist() == [3, 1, 3, 3, 1, 3]
    assert ot._nth(topic, value, 9).tolist() == [1, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("glob, evo", [(True, True), (True, False), (False, True), (False, False)])
def test_topics_over_time(spark, glob, evo):
    rnd = random.Random(11)
    vocab = ["red", "blue", "green", "gold", "grey", "pink"]
    rows = [(float(rnd.randint(0, 100)), rnd.choice([0, 1, -1]), " ".join(rnd.choices(vocab, k=rnd.randint(3, 7)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "t double, topic_id int, normalized_text string")
    weights = tm.ctfidf(tm.term_counts(df, stop_words=[]))
    plain = {(r.topic_id, r.term): (r.idf, r.score) for r in weights.collect()}
    found = ot.topics_over_time(df, weights, "t", 6, glob, evo, stop_words=[])
    got = {(r.topic_id, r.bin): (r.frequency, r.words) for r in found.collect()}
    assert got == plain_over_time(rows, plain, 6, glob, evo)


def similar(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


def test_near_copies_are_left_out(spark):
    rnd = random.Random(2)
    rows = [(t, "".join(rnd.choices("ab", k=12)), rnd.random()) for t in (0, 1) for _ in range(150)]
    rows = [(t, p, s) for (t, p), s in {(t, p): s for t, p, s in rows}.items()]
    df = spark.createDataFrame(rows, "topic_id int, phrase string, score double")
    got = defaultdict(list)
    for r in lb.keywords_statistical(df, 5, 0.7).orderBy("topic_id", "rank").collect():
        got[r.topic_id].append(r.phrase)
    for t in (0, 1):
        want = []
        for _, p in sorted((round(s, 9), p) for tt, p, s in rows if tt == t):
            if len(want) < 5 and all(similar(p, w) <= 0.7 for w in want):
                want.append(p)
        assert got[t] == want


def test_statistical_scores_read_the_texts_three_times(spark):
    """For words, pairs and the number of chunks; the pairs are used three times."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i % 2, i, f"aa b{i}b cc dd aa") for i in range(10)], "topic_id int, chunk_id bigint, normalized_text string")
    lb.statistical_scores(df.mapInArrow(read, df.schema), []).collect()
    assert seen.value <= 30


def test_keyphrases_and_labels(chunks, spark):
    phrases = lb.keyphrases(chunks, 3, dims=512, stop_words=[])
    got = {(r.topic_id, r.rank): r.phrase for r in phrases.collect()}
    assert {t for t, _ in got} == {0, 1} and "apple" in got[0, 1] and "engine" in got[1, 1]
    names = spark.createDataFrame([(0, "0_a"), (1, "1_b"), (5, "5_c")], "topic_id int, name string")
    stat = lb.keywords_statistical(lb.statistical_scores(chunks, []))
    merged = {r.topic_id: r for r in lb.merge_labels(names, phrases, stat).collect()}
    assert merged[5].keyphrases == [] and merged[5].keywords == [] and merged[5].extra is None
    assert merged[0].default_name == "0_a" and len(merged[0].keyphrases) == 3


def test_counts_move_once(spark, monkeypatch):
    """Terms are counted before they move, and move by term only; parts of any size give the same sums."""
    rng = random.Random(3)
    words = ["aa", "bb", "cé", "x", "of", "", "dd dd"]
    rows = [(rng.choice([0, 1, 1, 2, -1, None]), rng.choice([None, "", " ".join(rng.choices(words, k=9))])) for _ in range(300)]
    df = spark.createDataFrame(rows, "topic_id int, normalized_text string")
    want = Counter()
    for topic, text in rows:
        w = [x for x in (text or "").split(" ") if len(x) > 1 and x != "of"]
        want.update((topic, t) for t in w + [" ".join(p) for p in zip(w, w[1:])])
    per_term = defaultdict(list)
    for (_, t), n in want.items():
        per_term[t].append(n)
    want = {(k, t, n, len(per_term[t]), sum(per_term[t])) for (k, t), n in want.items() if len(per_term[t]) > 1}
    counts = tm.term_counts(df, stop_words=["of"])
    assert {tuple(r) for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("hashpartitioning(topic_id") == 0

    batches = df.withColumnRenamed("normalized_text", "_text").toArrow().to_batches(max_chunksize=50)
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(tm, "COUNTED_BYTES", size)
        found = Counter()
        for part in tm._counted(["of"], 2)(iter(batches)):
            for r in part.to_pylist():
                found[r["topic_id"], r["term"]] += r["n"]
        assert {(k, t, n) for (k, t), n in found.items() if len(per_term[t]) > 1} == {x[:3] for x in want}


def _dealt_by(df):
    """What each exchange in the plan is dealt by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?)\)", plan)]


def _written(monkeypatch, module):
    """The tables that a module writes."""
    written = []
    monkeypatch.setattr(module, "cut_lineage", lambda d: written.append(d) or d.localCheckpoint())
    return written


def test_packed_rows_come_back():
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.choice(["aa", "bé cc", "x" * 300, "dd"]), i, i / 7) for i in range(200)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(["t", "term", "n", "w"], r)) for r in rows[k : k + 60]]) for k in range(0, 200, 60)]
    packed, order = tm.packed(batches, ["t"], {"n": "<i8", "w": "<f8"}, 7)
    terms, (topic,), (n, w) = tm.unpacked(pa.Table.from_batches([packed]), ["t"], {"n": "<i8", "w": "<f8"})
    assert list(zip(topic.to_pylist(), terms.to_pylist(), n.tolist(), w.tolist())) == [rows[i] for i in order]
    of = {(term, b) for b, term in zip(np.repeat(packed["bucket"].to_numpy(), packed["rows"].to_numpy()), terms.to_pylist())}
    assert len(of) == len({term for term, _ in of}) and packed["bucket"].to_pylist() == sorted(set(packed["bucket"].to_pylist()))


def test_terms_of_slices_meet_weights_packed(spark, monkeypatch):
    """No row per term is shuffled: the texts are dealt by slices, once, and terms by buckets."""
    rows = [("v", i, i % 3, f"aa bb c{i % 4}c aa") for i in range(40)]
    df = spark.createDataFrame(rows, "video_id string, chunk_id bigint, topic_id int, normalized_text string")
    weights = tm.ctfidf(tm.term_counts(df, stop_words=[])).localCheckpoint()
    written = _written(monkeypatch, tm)
    assert tm.representative_docs(df, weights, 2, stop_words=[]).count() == 6
    top = next(d for d in written if "similarity" in d.columns)
    assert not any("term" in x for x in _dealt_by(top)) and any("bucket" in x for x in _dealt_by(top))


def test_terms_over_time_meet_weights_packed(spark, monkeypatch):
    rows = [(float(i % 7), i % 2, f"aa b{i % 3} cc d{i % 5}d") for i in range(40)]
    df = spark.createDataFrame(rows, "t double, topic_id int, normalized_text string")
    weights = tm.ctfidf(tm.term_counts(df, stop_words=[])).localCheckpoint()
    written = _written(monkeypatch, ot)
    ot.topics_over_time(df, weights, "t", 5, stop_words=[]).collect()
    per_term = next(d for d in written if "term" in d.columns)
    assert not any("term" in x for x in _dealt_by(per_term)) and any("bucket" in x for x in _dealt_by(per_term))


def test_what_was_shuffled_for_a_written_table_is_removed(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    kept = spark.range(1000).repartition(3, "id").localCheckpoint()
    mine = files() - before
    assert mine
    table = cut_lineage(spark.range(1000).repartition(3, "id"))
    # Block managers are asked to remove them; they may take a moment.
    end = time.time() + 20
    while files() - before - mine and time.time() < end:
        time.sleep(0.1)
    assert not files() - before - mine
    assert table.count() == kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_weights_are_not_stored_beside_their_counts(chunks, monkeypatch):
    """The report reads weights four times; they are worked out from the stored counts."""
    from registry import base, topics

    written = [*map(lambda module: _written(monkeypatch, module), (tm, base))]
    assert topics.weights(chunks).count()
    assert any("tf" in d.columns for d in sum(written, [])) and not any("score" in d.columns for d in sum(written, []))
