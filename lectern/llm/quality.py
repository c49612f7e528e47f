"""Quality rules whose limits come from the data: quantile sketches per language and source.

Every document is measured by column functions. A sketch of a measure is its count per bin, where a bin
keeps the six leading bits of a whole number (so quantiles are right to one part in 32) and sketches are
merged by adding counts. From the sketch of each (language, source) come the median and the outer octiles
(an eighth of the documents lies beyond each). A document fails a measure if it lies farther beyond an
octile than ``FENCE`` times the distance of that octile from the median, so each side has a limit of its
own and both follow the spread of the group. Where the octile is the median, its bin's width stands for
the distance. Groups with fewer than ``MIN_DOCS`` documents use the merged sketches of their language, and
languages with fewer those of all documents. The limits are then joined to the documents.

Only DataFrame functions are used. Equality of word windows inside one text is that of 64-bit hashes.

Nulls: a null text has no words (and so fails the fixed rule on few words); null languages and sources
are groups of their own. Repeated rows count each. An empty table gives an empty table. Added columns
are ``MEASURES`` and ``kept`` with the base measures; columns of ``docs`` with these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.skew import lookup_join
from lectern.session import cut_lineage

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
MIN_DOCS = 200
FENCE = 3
WINDOW = 5

#: Each measure, as a whole number.
MEASURES = {
    "symbol_rate": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "capital_rate": "1000 * n_capitals div greatest(word_chars, 1)",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_lines", "n_capitals")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the measures of each text."""
    own = [x for x in docs.columns if x not in (*BASE, *_EXTRA, *MEASURES, "kept", "base_failed")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = docs.select(
        *own,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    hashes = ", ".join(f"_words[i + {k}]" for k in range(WINDOW))
    counted = counted.select(
        *own, "word_chars", "n_symbols", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"""CASE WHEN size(_words) >= {WINDOW}
                     THEN transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({hashes}))
                     ELSE cast(array() AS array<bigint>) END"""
        ).alias("_grams"),
    )
    # Only texts with a repeated window are looked at further: windows by hash, then by place.
    counted = counted.withColumn(
        "_sorted",
        F.expr(
            """CASE WHEN size(array_distinct(_grams)) < size(_grams)
                    THEN sort_array(transform(_grams, (g, i) -> struct(g AS g, i AS i)))
                    ELSE cast(array() AS array<struct<g: bigint, i: int>>) END"""
        ),
    ).drop("_grams")
    counted = counted.withColumn(
        "_places",
        F.expr(
            """sort_array(transform(filter(_sorted, (x, k) ->
                 (k > 0 AND x.g = get(_sorted, k - 1).g) OR coalesce(x.g = get(_sorted, k + 1).g, false)), x -> x.i))"""
        ),
    ).drop("_sorted")
    covered = F.expr(
        f"""aggregate(_places, struct(cast(0 AS bigint) AS n, cast(0 AS int) AS end),
              (a, i) -> struct(a.n + {WINDOW} - greatest(0, a.end - i) AS n, i + {WINDOW} AS end), a -> a.n)"""
    )
    counted = counted.withColumn("n_repeat_words", covered).drop("_places")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measures = {name: F.expr(value).cast("long") for name, value in MEASURES.items()}
    return counted.withColumn("base_failed", failed).withColumns(measures)


def _cut(x: str) -> str:
    """How many low bits of a number its bin leaves out."""
    return f"greatest(length(bin({x})) - 6, 0)"


def _bin(x: str) -> str:
    return f"shiftleft(shiftright({x}, {_cut(x)}), {_cut(x)})"


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (language, source, measure, bin). Adding the counts merges sketches."""
    pairs = ", ".join(f"'{x}', {_bin(x)}" for x in MEASURES)
    return (
        _keyed(measured)
        .select("_lang", "_source", F.expr(f"stack({len(MEASURES)}, {pairs}) AS (measure, bin)"))
        .groupBy("_lang", "_source", "measure", "bin")
        .agg(F.count("*").alias("n"))
    )


def _keyed(df: DataFrame) -> DataFrame:
    """Join keys that are never null."""
    key = lambda x: F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("null"))
    return df.withColumns({"_lang": key("lang"), "_source": key("source")})


def _octiles(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Docs, median and outer octiles per group, from sketches merged over all other keys."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    at = merged.select(
        *keys, "measure", "bin",
        F.sum("n").over(group.orderBy("bin")).alias("upto"),
        F.sum("n").over(group).alias("docs"),
    )
    return at.groupBy(*keys, "measure").agg(
        F.first("docs").alias(f"docs{suffix}"),
        *(
            F.min(F.when(8 * F.col("upto") >= k * F.col("docs"), F.col("bin"))).alias(f"q{k}{suffix}")
            for k in (1, 4, 7)
        ),
    )


def limits(sketch: DataFrame, min_docs: int = MIN_DOCS, fence: int = FENCE) -> DataFrame:
    """One row per (language, source): the lowest and highest passing value of each measure."""
    own = _octiles(sketch, ["_lang", "_source"], "")
    lang = _octiles(sketch, ["_lang"], "_l")
    every = _octiles(sketch, [], "_e")
    found = own.join(lang, ["_lang", "measure"]).join(F.broadcast(every), "measure")
    pick = lambda q: (
        F.when(F.col("docs") >= min_docs, F.col(q))
        .when(F.col("docs_l") >= min_docs, F.col(f"{q}_l"))
        .otherwise(F.col(f"{q}_e"))
    )
    found = found.select("_lang", "_source", "measure", *(pick(q).alias(q) for q in ("q1", "q4", "q7")))
    reach = lambda q, spread: fence * F.greatest(spread, F.expr(f"shiftleft(1L, {_cut(q)})"))
    found = found.withColumns(
        {
            "low": F.col("q1") - reach("q1", F.col("q4") - F.col("q1")),
            "high": F.col("q7") + reach("q7", F.col("q7") - F.col("q4")),
        }
    )
    cells = []
    for name in MEASURES:
        own_row = F.col("measure") == name
        cells += [
            F.max(F.when(own_row, F.col("low"))).alias(f"_low_{name}"),
            F.max(F.when(own_row, F.col("high"))).alias(f"_high_{name}"),
        ]
    return found.groupBy("_lang", "_source").agg(*cells)


def judge(measured: DataFrame, min_docs: int = MIN_DOCS, fence: int = FENCE) -> DataFrame:
    """The measured documents with ``kept``. ``measured`` is read twice, so it should be stored."""
    found = cut_lineage(limits(sketches(measured), min_docs, fence))
    joined = lookup_join(_keyed(measured), found, ["_lang", "_source"], measured.columns[:1])
    within = ~F.col("base_failed")
    for name in MEASURES:
        within = within & F.col(name).between(F.col(f"_low_{name}"), F.col(f"_high_{name}"))
    return joined.select(*measured.columns, within.alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judge(cut_lineage(measure(docs))).where("kept").select(*docs.columns)
