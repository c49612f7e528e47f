import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.repeats import collapse_text, collapse_texts, may_change
from lectern.plans import views as v


def adjacent_copies(text):
    """All (phrase, phrase) that stand next to each other, by trying every run of words and spaces."""
    cells = re.findall(r"\w+|\s+|[^\w\s]", text)
    words = [i for i, c in enumerate(cells) if c[0].isalnum() or c[0] == "_"]
    found = []
    for a in words:
        for b in words:
            end = 2 * b - 1 - a
            if b > a and cells[b - 1].isspace() and end <= len(cells):
                first, second = cells[a : b - 1], cells[b:end]
                clean = all(c[0].isalnum() or c[0] == "_" or c.isspace() for c in first)
                if clean and first and [c.lower() for c in first] == [c.lower() for c in second]:
                    found.append(("".join(first), "".join(second)))
    return found


@pytest.mark.parametrize(
    "text, want",
    [
        ("hello world hello world", "hello world"),
        ("a b c a b c a b c", "a b c"),
        ("The the cat", "The cat"),
        ("one, one", "one, one"),
        ("", ""),
        ("a  b a b", "a  b a b"),
    ],
)
def test_collapse_examples(text, want):
    assert collapse_text(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a b a b a b a b", "a b"),
        ("x a b c a b c b c", "x a b c"),
        ("a a, a a b", "a, a b"),
        ("go Go GO on on", "go on"),
        ("a b  a b", "a b"),
        ("cat-cat cat", "cat-cat"),
        ("\u00e9t\u00e9 \u00c9T\u00c9 now", "\u00e9t\u00e9 now"),
        ("1 2 1 2 3 1 2 3", "1 2 3"),
    ],
)
def test_collapse_more_examples(text, want):
    assert collapse_text(text) == want


def test_collapse_leaves_no_copies_and_only_drops_copies():
    rnd = random.Random(7)
    for _ in range(1500):
        n = rnd.randint(0, 16)
        text = "".join(rnd.choice("ab cA B") + rnd.choice([" ", " ", "  ", ", ", "\n", ""]) for _ in range(n))
        got = collapse_text(text)
        assert not adjacent_copies(got), repr(text)
        if not adjacent_copies(text):
            assert got == text
        assert {w.lower() for w in re.findall(r"\w+", got)} == {w.lower() for w in re.findall(r"\w+", text)}


def test_collapse_column_sends_only_what_can_change(spark):
    texts = ["a b c", "a A b", "x-cat cat-y", None, "", "\u5b57 \u5b57", "\u00e9 \u00c9", "no copy, no", "x\u0301 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", tx.collapse_repeats(F.col("text")).alias("c")).collect()}
    assert got == {i: collapse_text(t) for i, t in enumerate(texts)}


def test_whole_batches_miss_no_text_that_changes():
    rnd = random.Random(11)
    letters = ["a", "b", "cé", "A", "B"]
    odd = ["É", "é", "ß", "x_1", "ſ", "İ", "\u212a", "ж", "\u01c5", "\u023a", "²", "\u0130i", "i\u0307"]
    gaps = [" "] * 6 + ["  ", ", ", "\n", "", "\u2014", " - ", "\u2019", "\u2003", "×", "\xa0", "\x1c", "«", "º"]
    texts = [
        "".join(rnd.choice(odd if rnd.random() < 0.1 else letters) + rnd.choice(gaps) for _ in range(rnd.randint(0, 24)))
        for _ in range(6000)
    ]
    # Two words that stand together often, without and with a copy at the end.
    texts += ["a b " + " ".join(f"{i} a b" for i in range(40)), "a b " + " ".join(f"{i} a b" for i in range(40)) + " 39 a b"]
    want = [collapse_text(t) for t in texts]
    flagged = may_change(pa.array(texts))
    assert not [t for t, w, f in zip(texts, want, flagged) if t != w and not f]
    assert not may_change(pa.array(["a b c", "a, a", "one two\u2014one two", "", "été \u201cété\u201d"])).any()
    with_nulls = pa.array([*texts, None])
    assert collapse_texts(with_nulls).to_pylist() == [*want, None]
    assert collapse_texts(with_nulls.slice(7, 900)).to_pylist() == want[7:907]
    assert collapse_texts(with_nulls.slice(0, 0)).to_pylist() == []


def test_collapse_long_text_with_many_copies():
    assert collapse_text("x y z " * 20_000) == "x y z "


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "text string").select(col.alias("c")).first()[0]


def test_normalize_examples(spark):
    df = spark.createDataFrame(
        [("<c>The</c> c12 Cat, the cat's 2 toys",), ("",), (None,), ("C12 c12 x y",), ("d d e <i>d",)],
        "text string",
    )
    got = [r[0] for r in tx.normalize(df).select("normalized_text").collect()]
    assert got == ["cat cats toys", "", None, "c x y", "d e d"]


def test_normalize_takes_stop_words(spark):
    df = spark.createDataFrame([("the big cat",)], "text string")
    assert tx.normalize(df, ["big"]).first()["normalized_text"] == "the cat"


def test_small_functions(spark):
    t = F.col("text")
    assert one(spark, tx.video_url(t), "X") == "https://www.youtube.com/watch?v=X"
    assert one(spark, tx.short_title(t), "a" * 81) == "a" * 80 + "..."
    assert one(spark, tx.short_title(t), "a" * 80) == "a" * 80
    assert one(spark, tx.collapse_repeated_words(t), "a A b b a") == "a b a"
    df = spark.createDataFrame([(0.1,), (0.11,), (-0.1,), (-0.11,)], "s double")
    got = [r[0] for r in df.select(tx.sentiment_bucket(F.col("s"))).collect()]
    assert got == ["Neutral", "Positive", "Neutral", "Negative"]


def test_stop_word_list():
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 126


def test_normalize_on_a_stream(spark, tmp_path):
    from lectern.sources.captions import TRANSCRIPTS
    from lectern.streaming.segments import normalize_stream, read_segments

    rows = [("v", "the cat the cat sat", 0.0, 1.0, "en"), ("v", "Two <b>dogs</b>", 1.0, 1.0, "en")]
    spark.createDataFrame(rows, TRANSCRIPTS).write.parquet(str(tmp_path / "in"))
    q = normalize_stream(read_segments(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["normalized_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"cat sat", "two dogs"}


def test_first_n_and_optional_column(spark):
    df = spark.range(10)
    assert [r.id for r in v.first_n(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert v.first_n(df, 0, ["id"]).count() == 0
    assert v.first_n(df, None, ["id"]).count() == 10
    assert v.with_optional(df, "chunk_id", "bigint").first()["chunk_id"] is None
    assert [r["index"] for r in v.row_index(df, ["id"]).orderBy("id").collect()] == list(range(10))
