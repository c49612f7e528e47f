"""Licence texts in files, by a positional index of the rarest words of licence templates.

The index holds, for every template, the places of its words, weighted by their inverse document
frequency over all files. A posting (template, place) and a place in the file give the word at which the
template would start; of the words whose postings agree on a start, the ``RAREST`` of highest weight
support it, so no template and no word elsewhere in the file takes the place of another's. A start is
confirmed if one of the template's mandatory key phrases stands where it should, give or take ``SLACK``
words, and the support is at least ``SUPPORT`` of the weight of the template's ``RAREST`` heaviest postings.
Files without any key phrase cannot be confirmed, and words beyond the reach of every key phrase support
nothing, so they are not looked up.

Apart from that, every place of a base phrase is found and its label always kept. The score is 1 for a
file with a base phrase, else the best confirmed support, else 0.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Only DataFrame functions are
used. The templates are a fixed list, so their index may be broadcast and their words stand in the plan.

Nulls: a null text has no words. Repeated rows are treated each for itself. Ties between words of equal
weight go by the word. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Phrases of the base rule and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Openings and marked sentences of licences, with the phrases one of which must stand there.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4", "cc by 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)

RAREST = 8
SLACK = 2
SUPPORT = 0.5


def _licence_words() -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for _, text, _ in TEMPLATES for w in text.split()))


def _phrase_places(phrase: str) -> F.Column:
    """Starts of a phrase in ``words``; texts without its longest word are not searched."""
    first, *rest = phrase.split()
    same = "".join(f" AND get(words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1))
    return F.expr(
        f"""CASE WHEN contains(lowered, '{max(phrase.split(), key=len)}')
                 THEN filter(transform(words, (w, i) -> CASE WHEN w = '{first}'{same} THEN i END), i -> i IS NOT NULL)
                 ELSE cast(array() AS array<int>) END"""
    )


def _worded(docs: DataFrame) -> DataFrame:
    lowered = F.translate(
        F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    words = F.filter(F.split("lowered", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
    return docs.select("doc_id", lowered.alias("lowered")).select("doc_id", "lowered", words.alias("words"))


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all files; as many numbers as there are words."""
    known = _licence_words()
    listed = ", ".join(f"'{w}'" for w in known)
    own = F.array_distinct(F.expr(f"filter(words, w -> w IN ({listed}))"))
    per_file = _worded(docs).select(F.explode(F.array_append(own, F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in per_file.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((counts.get("", 0) + 1) / max(counts.get(w, 0), 1)) for w in known}


def scan(docs: DataFrame, rarest: int = RAREST, support: float = SUPPORT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted lists), score and
    ``starts``: the confirmed templates as (label, start, score)."""
    idf = weights(docs)
    weight = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    listed = ", ".join(f"'{w}'" for w in idf)
    base = {phrase: F.col(f"_b{k}") for k, phrase in enumerate(BASE)}
    phrases = tuple(dict.fromkeys(p for _, _, keys in TEMPLATES for p in keys))
    # A key phrase puts the template's start so many words before itself.
    keys = F.expr(
        "concat({})".format(
            ", ".join(
                f"transform(_k{phrases.index(phrase)}, i -> struct({t} AS template,"
                f" i - {len(text.split(phrase)[0].split())} AS start))"
                for t, (_, text, own) in enumerate(TEMPLATES)
                for phrase in own
            )
        )
    )
    every = F.concat(*base.values())
    labels = F.array_compact(F.array(*(F.when(F.size(base[p]) > 0, F.lit(label)) for p, label in BASE.items())))
    places = F.expr(
        f"""CASE WHEN size(_keys) > 0
                 THEN filter(transform(words, (w, i) -> CASE WHEN w IN ({listed}) THEN struct(w AS word, i AS place) END),
                             x -> x IS NOT NULL)
                 ELSE cast(array() AS array<struct<word: string, place: int>>) END"""
    )
    files = (
        _worded(docs)
        .select(
            "doc_id",
            "words",
            *(_phrase_places(phrase).alias(f"_b{k}") for k, phrase in enumerate(BASE)),
            *(_phrase_places(phrase).alias(f"_k{k}") for k, phrase in enumerate(phrases)),
        )
        .select(
            "doc_id",
            "words",
            F.size("words").cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(labels)).alias("base_labels"),
            keys.alias("_keys"),
        )
        .withColumn("_places", places)
        .drop("words")
    )
    files = cut_lineage(files.withColumn("_row", F.monotonically_increasing_id()))

    reach = F.create_map(*(F.lit(x) for t, (_, text, _) in enumerate(TEMPLATES) for x in (t, len(text.split()))))
    near = lambda place: F.exists(
        "_keys", lambda k: place.between(k["start"] - SLACK, k["start"] + reach[k["template"]] - 1 + SLACK)
    )
    looked_up = (
        files.where(F.size("_keys") > 0)
        .select("_row", "_keys", F.explode(F.filter("_places", lambda x: near(x["place"]))).alias("x"))
        .select("_row", "_keys", "x.*")
    )
    index, needed = [], []
    for t, (label, text, _) in enumerate(TEMPLATES):
        words = text.split()
        index += [(t, w, p, idf[w]) for p, w in enumerate(words)]
        needed.append((t, label, sum(sorted((idf[w] for w in words), reverse=True)[:rarest])))
    spark = docs.sparkSession
    postings = spark.createDataFrame(index, "template int, word string, posting int, weight double")
    templates = spark.createDataFrame(needed, "template int, label string, needed double")
    agreed = F.exists(
        "_keys", lambda k: (k["template"] == F.col("template")) & (F.abs(k["start"] - F.col("start")) <= SLACK)
    )
    heaviest = F.slice(F.sort_array(F.array_distinct("_words")), 1, rarest)
    support_of = F.aggregate(
        F.filter(F.sort_array("_words"), lambda x: F.array_contains("_rare", x)), F.lit(0.0), lambda a, x: a - x["k"]
    )
    confirmed = (
        looked_up.join(F.broadcast(postings), "word")
        .withColumn("start", F.col("place") - F.col("posting"))
        .where(agreed)
        .groupBy("_row", "template", "start")
        .agg(F.collect_list(F.struct((-F.col("weight")).alias("k"), F.col("word").alias("w"))).alias("_words"))
        .withColumn("_rare", heaviest)
        .withColumn("weight", support_of)
        .join(F.broadcast(templates), "template")
        .withColumn("score", F.least(F.col("weight") / F.col("needed"), F.lit(1.0)))
        .where(F.col("score") >= support)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("label", F.col("start").cast("long").alias("start"), "score"))).alias("starts"))
    )
    joined = files.join(confirmed, "_row", "left")
    starts = F.coalesce("starts", F.array().cast("array<struct<label: string, start: bigint, score: double>>"))
    best = F.array_max(F.transform(starts, lambda x: x["score"]))
    found = F.transform(starts, lambda x: x["label"])
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", found))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        starts.alias("starts"),
    )
