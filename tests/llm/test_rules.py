"""Quality measures and limits, licence scan: against plain Python and on edge rows."""

import math
import random
import re
from collections import Counter

from lectern.llm import licenses, quality
from lectern.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def texts():
    random.seed(4)
    parts = ["a", "b", "é", "😀", "#", "|", " ", "  ", "\n", "\t", "A", "line one\n", "\x00", "\x0b", "a b a b a b "]
    return ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(400)] + [None, "", "\n\n", "x " * 200000]


def test_measures_equal_plain_ones(spark):
    rows = [(i, t, None if i % 3 else "en", "s", "clash", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, kept string, n_words int")
    measured = cut_lineage(quality.measure(docs))
    found = quality.judge(measured).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        want = measures(rows[r.doc_id][1])
        assert tuple(r[x] for x in quality.BASE) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(cut_lineage(quality.measure(docs.limit(0)))).count() == 0
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns


def test_limits_follow_their_group(spark):
    """A source of 4 to 8 marks may have 7; one marked document among plain ones may not have 20."""
    marks = lambda n: " ".join(f"#{k}" for k in range(n))
    body = "some plain words stand in this line and more of them follow "
    rows = [(i, f"{body}{i} " + marks(4 + i // 2 % 5 if i % 2 else 0), "en", "ab"[i % 2]) for i in range(600)]
    rows += [(1000, body + marks(20), "en", "a"), (1001, body + marks(7), "en", "b"), (1002, body, "en", "rare"), (1003, body, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in quality.judge(cut_lineage(quality.measure(docs))).where("not kept").collect()}
    assert gone == {1000}


def test_limits_follow_the_spread_of_their_group(spark):
    """Two sources of one median and different spread: the wider one has the wider limits, on either side by itself."""
    word = lambda n: "w" * n
    rows = []
    for i in range(800):
        n = 5 + (i // 2) % 5 - 2 if i % 2 else 5 + ((i // 2) % 8 == 0)
        rows.append((i, " ".join([word(n)] * 2 + [f"{k:03d}{word(n - 3)}" for k in range(20)]), "en", "narrow wide".split()[i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r._source: r for r in quality.limits(quality.sketches(quality.measure(docs))).collect()}
    narrow, wide = found["=narrow"], found["=wide"]
    assert wide._high_word_length - wide._low_word_length > 4 * (narrow._high_word_length - narrow._low_word_length)
    # Bins of 8 at 500; the octiles of the narrow source are both its median, those of the wide one 300 and 700.
    assert (narrow._low_word_length, narrow._high_word_length) == (496 - 3 * 8, 496 + 3 * 8)
    assert (wide._low_word_length, wide._high_word_length) == (296 - 3 * 200, 688 + 3 * 192)


def test_sketch_merges_by_addition(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40 + 10), "en", "ab"[i % 2]) for i in range(100)], "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs)
    whole = {(r.measure, r.bin): r.n for r in quality.sketches(measured.withColumn("source", measured.lang)).collect()}
    parts = Counter()
    for r in quality.sketches(measured).collect():
        parts[r.measure, r.bin] += r.n
    assert whole == dict(parts)


def test_licences(spark):
    cases = {
        1: ("Released under the MIT License.", ["mit"], ["mit"], 1),
        2: ("x Licensed under the APACHE License, Version 2.0. y\nLicensed under CC BY-NC 4.0.", ["apache-2", "cc-by-nc"], ["apache-2", "cc-by-nc"], 2),
        3: ("This work is licensed under the GNU General Public License, version 3.", [], ["gpl-3"], 0),
        4: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", [], ["mit"], 0),
        5: ("the general public of the gnu and its license version", [], [], 0),
        6: (None, [], [], 0),
        7: ("", [], [], 0),
        8: ("under the mit license " * 3000, ["mit"], ["mit"], 3000),
        9: ("underthe mit license; under the mitlicense", [], [], 0),
    }
    rows = [(i, c[0], 4, "x") for i, c in cases.items()]
    docs = spark.createDataFrame([*rows, rows[0], (None, cases[1][0], 4, "x")], "doc_id long, text string, words int, score string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        text, base, labels, n = cases[r.doc_id or 1]
        w = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [i for i in range(len(w)) for p in licenses.BASE if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(w), n, base, labels), text
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels) and math.isfinite(r.score)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_do_not_take_each_others_support(spark):
    """Files with several licences, and a long one with licence words all over it, have the label of each."""
    gpl = "This work is licensed under the GNU General Public License, version 3."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    cc = "Licensed under CC BY 4.0."
    stray = " of a binary charge to copy with permission, redistribution and obtaining forms;" * 20
    cases = [
        (gpl, ["gpl-3"]), (gpl + " " + bsd, ["bsd", "gpl-3"]), ("\n".join([gpl, bsd, mpl]), ["bsd", "gpl-3", "mpl-2"]),
        (cc + " " + bsd, ["bsd", "cc-by"]), (stray + gpl + stray, ["gpl-3"]), (stray + cc + stray, ["cc-by"]),
        (stray + "Permission is hereby granted, free of charge" + stray, ["mit"]),
    ]
    plain = [(100 + i, f"this work is subject to the terms of the public version {i}") for i in range(60)]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(cases)), *plain], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert [found[i] for i in range(len(cases))] == [labels for _, labels in cases]
    assert not any(found[i] for i, _ in plain)


def test_registered_licences_equal_their_sql(spark, tmp_path):
    """Bundled licence files tell the rule apart from one that looks at the rarest words of the whole file."""
    import duckdb

    from lectern.llm.queries import ORACLES, QUERIES

    gpl = "This work is licensed under the GNU General Public License, version 3."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    cc = "Licensed under CC BY 4.0."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    filler = "binary charge copy permission redistribution source form " * 40
    rows = [gpl, bsd, gpl + "\n" + bsd, "\n".join([gpl, bsd, mpl]), cc + bsd, filler + gpl + filler + mpl, mit + " " + cc, None, "", filler]
    rows += [gpl[8:] + " " + bsd[:60], "under the mit license " + mpl, "plain words"] + ["nothing here"] * 40
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op5_licenses"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ", ".join(found.columns)
    assert got == sorted(con.sql(f"SELECT {names} FROM ({ORACLES['op5_licenses']})").fetchall())
    labels = {r.doc_id: r.labels for r in found.collect()}
    assert labels[2] == "bsd,gpl-3" and labels[3] == "bsd,gpl-3,mpl-2" and labels[5] == "gpl-3,mpl-2"
