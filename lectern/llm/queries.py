"""The registered queries of the operators: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    fingerprints,
    language,
    licenses,
    near_copies,
    negatives,
    packing,
    privacy,
    quality,
    runs,
    scoring,
    token_files,
    urls,
)
from lectern.llm.subwords import tokenizer_path
from lectern.session import cut_lineage, scratch_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def fold(n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) != 2).alias("train"))
    blocks = scoring.blocked(docs, "train")
    model, words = scoring.learn(blocks, tokenizer_path("byte_bpe_50k.json"))
    return scoring.score(blocks, words, model).select(
        "doc_id",
        F.coalesce(~F.col("train"), F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(fold(5) != 0))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (F.coalesce(fold(5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


@query
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = quality.judge(cut_lineage(quality.measure(docs).drop("text")))
    return measured.select("doc_id", *quality.BASE, "base_failed", "kept")


# The limits, octiles and patterns are written out here so that they are checked too.
ORACLES["op3_quality"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS words FROM d),
grams AS (
  SELECT rid, i, words[i:i + 4] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
places AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM places, range(5) AS r(k) GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
m AS MATERIALIZED (
  SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
v AS MATERIALIZED (
  SELECT rid, lang, source, unnest([
    {'m': 1, 'x': 1000 * n_symbols // greatest(n_words, 1)},
    {'m': 2, 'x': 1000 * n_dup_lines // greatest(n_lines, 1)},
    {'m': 3, 'x': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'m': 4, 'x': 1000 * n_capitals // greatest(word_chars, 1)},
    {'m': 5, 'x': 100 * word_chars // greatest(n_words, 1)}], recursive := true) FROM m),
b AS MATERIALIZED (
  SELECT *, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b FROM v),
own AS (SELECT lang, source, m, count(*) AS n, quantile_disc(b, 0.125) AS q1, quantile_disc(b, 0.5) AS q4, quantile_disc(b, 0.875) AS q7
        FROM b GROUP BY ALL),
bylang AS (SELECT lang, m, count(*) AS n, quantile_disc(b, 0.125) AS q1, quantile_disc(b, 0.5) AS q4, quantile_disc(b, 0.875) AS q7
           FROM b GROUP BY ALL),
every AS (SELECT m, quantile_disc(b, 0.125) AS q1, quantile_disc(b, 0.5) AS q4, quantile_disc(b, 0.875) AS q7 FROM b GROUP BY ALL),
verdict AS (
  SELECT rid, bool_and(x BETWEEN q1 - 3 * greatest(q4 - q1, 1::BIGINT << greatest(length(bin(q1)) - 6, 0))
                         AND q7 + 3 * greatest(q7 - q4, 1::BIGINT << greatest(length(bin(q7)) - 6, 0))) AS ok
  FROM (SELECT b.rid, b.x,
               CASE WHEN own.n >= 200 THEN own.q1 WHEN bylang.n >= 200 THEN bylang.q1 ELSE every.q1 END AS q1,
               CASE WHEN own.n >= 200 THEN own.q4 WHEN bylang.n >= 200 THEN bylang.q4 ELSE every.q4 END AS q4,
               CASE WHEN own.n >= 200 THEN own.q7 WHEN bylang.n >= 200 THEN bylang.q7 ELSE every.q7 END AS q7
        FROM b JOIN own ON own.m = b.m AND own.lang IS NOT DISTINCT FROM b.lang
                       AND own.source IS NOT DISTINCT FROM b.source
               JOIN bylang ON bylang.m = b.m AND bylang.lang IS NOT DISTINCT FROM b.lang
               JOIN every ON every.m = b.m)
  GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ok AS kept
FROM m JOIN verdict USING (rid)
"""


def _joined_spans(name: str):
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query
def op4_privacy(spark, sf_dir):
    found = privacy.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(n(kind) for kind in privacy.KINDS),
        F.sha2(_joined_spans("base"), 256).alias("base_sha256"),
        _joined_spans("spans").alias("spans"),
    )


@query
def op5_licenses(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda x: F.array_join(x, ",").alias(x)
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined("base_labels"), joined("labels"), F.round("score", 6).alias("score"),
    )


def _licence_sql() -> str:
    postings = ", ".join(
        f"({t}, '{label}', '{w}', {p})"
        for t, (label, text, _) in enumerate(licenses.TEMPLATES)
        for p, w in enumerate(text.split())
    )
    keys = ", ".join(
        f"({t}, '{k}', {len(text.split(k)[0].split())})"
        for t, (_, text, own) in enumerate(licenses.TEMPLATES)
        for k in own
    )
    base = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE.items())
    return rf"""
WITH postings(template, label, word, posting) AS (VALUES {postings}),
keys(template, phrase, shift) AS (VALUES {keys}),
base(phrase, label) AS (VALUES {base}),
phrases AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS p FROM (SELECT phrase FROM keys UNION ALL SELECT phrase FROM base)),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
w AS MATERIALIZED (
  SELECT rid, words, unnest(range(len(words))) AS i, unnest(words) AS word FROM d),
hits AS MATERIALIZED (
  SELECT rid, i, phrase FROM w JOIN phrases ON word = p[1] WHERE words[i + 1:i + len(p)] = p),
b AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM hits JOIN base USING (phrase) GROUP BY rid),
idf AS (
  SELECT word, ln(((SELECT count(*) FROM d) + 1) / greatest(count(DISTINCT rid), 1)) AS weight
  FROM (SELECT DISTINCT word FROM postings) LEFT JOIN w USING (word) GROUP BY word),
marks AS (SELECT rid, template, i - shift AS start FROM hits JOIN keys USING (phrase)),
aligned AS MATERIALIZED (
  SELECT w.rid, template, label, i - posting AS start, word, weight
  FROM w JOIN postings USING (word) JOIN idf USING (word)
  WHERE EXISTS (SELECT 1 FROM marks m WHERE m.rid = w.rid AND m.template = postings.template AND abs(m.start - (i - posting)) <= 2)),
rare AS (
  SELECT rid, template, start, word FROM (
    SELECT *, row_number() OVER (PARTITION BY rid, template, start ORDER BY weight DESC, word) AS k
    FROM (SELECT DISTINCT rid, template, start, word, weight FROM aligned)) WHERE k <= 8),
support AS (
  SELECT rid, template, label, start, sum(weight) AS weight
  FROM aligned JOIN rare USING (rid, template, start, word) GROUP BY ALL),
needed AS (
  SELECT template, sum(weight) AS needed FROM (
    SELECT template, weight, row_number() OVER (PARTITION BY template ORDER BY weight DESC) AS k
    FROM postings JOIN idf USING (word)) WHERE k <= 8 GROUP BY template),
confirmed AS (
  SELECT rid, list(label) AS labels, max(least(weight / needed, 1.0)) AS score
  FROM support s JOIN needed USING (template)
  WHERE least(weight / needed, 1.0) >= 0.5
  GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(coalesce(b.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(c.labels, [])))), ',') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END, 6) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN confirmed c USING (rid)
"""


ORACLES["op5_licenses"] = _licence_sql()


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit("hits")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "longest_match",
    )


@query
def op7_token_files(spark, sf_dir):
    path = scratch_table(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_near_copies(spark, sf_dir):
    found = near_copies.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_urls(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op9_urls"] = r"""
WITH RECURSIVE u AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fits AS (
  SELECT rid, r.host || r.path AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                      ('allow', 'org', '/fr/')) AS r(verdict, host, path)
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
l AS MATERIALIZED (
  SELECT p.*, rule, verdict, CASE WHEN verdict IS NOT NULL THEN verdict = 'block'
    WHEN page_id % 2 = 0 THEN list_has_any(string_split_regex(p.host, '[.-]'), ['casino', 'bets', 'pills', 'spam', 'adult', 'ads']) END AS bad
  FROM p LEFT JOIN fits ON fits.rid = p.rid AND k = 1),
a AS MATERIALIZED (
  SELECT host, path, count(*) AS pages, count(*) FILTER (bad) AS bad, count(bad) AS labelled, string_split(path, '/') AS s
  FROM l GROUP BY host, path),
step AS (
  SELECT 0 AS level, host, path, pages, bad, labelled, s, '' AS template FROM a
  UNION ALL
  SELECT level + 1, host, path, pages, bad, labelled, s,
         CASE WHEN seg IS NULL THEN template ELSE template || '/' || CASE
           WHEN seg <> '' AND v >= 8 AND n < 4 * v THEN '*' || regexp_extract(seg, '(\.[A-Za-z]{1,5})$', 1) ELSE seg END END
  FROM (
    SELECT *, sum(CASE WHEN first THEN 1 END) OVER node AS v, sum(CASE WHEN seg IS NOT NULL THEN pages END) OVER node AS n
    FROM (SELECT *, seg IS NOT NULL AND row_number() OVER (PARTITION BY host, template, seg) = 1 AS first
          FROM (SELECT *, CASE WHEN level = 6 THEN CASE WHEN len(s) > 7 THEN '**' END ELSE s[level + 2] END AS seg FROM step))
    WINDOW node AS (PARTITION BY host, template))
  WHERE level < 7),
tree AS MATERIALIZED (SELECT * FROM step WHERE level = 7),
merging AS (
  SELECT 5 AS level, host, template, template AS branch, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(labelled) AS DOUBLE) AS labelled
  FROM tree GROUP BY host, template
  UNION ALL
  SELECT level - 1, host, template,
         CASE WHEN fl = 0 OR bl = 0 OR fb / fl IN (0.0, 1.0) OR pow(bb - bl * (fb / fl), 2) / (bl * (fb / fl) * (1 - fb / fl)) <= 3.84
              THEN family ELSE branch END, bad, labelled
  FROM (
    SELECT *, sum(bad) OVER b AS bb, sum(labelled) OVER b AS bl, sum(bad) OVER f AS fb, sum(labelled) OVER f AS fl
    FROM (
      SELECT *, CASE WHEN coalesce(seg, '') = '' OR seg[1] IN ('*', '?') THEN branch
             ELSE array_to_string(list_concat(s[:level + 1], ['?' || regexp_extract(seg, '(\.[A-Za-z]{1,5})$', 1)], s[level + 3:]), '/') END AS family
      FROM (SELECT *, string_split(branch, '/') AS s, string_split(branch, '/')[level + 2] AS seg FROM merging WHERE level >= 0))
    WINDOW b AS (PARTITION BY host, branch), f AS (PARTITION BY host, family, family = branch))),
branches AS MATERIALIZED (
  SELECT host, branch, sum(bad) AS bad, sum(labelled) AS labelled FROM merging WHERE level = -1 GROUP BY host, branch),
heads AS (
  SELECT regexp_extract(template, '^/[^/]*') AS head, (sum(bad) + 0.2::DOUBLE * 2) / (sum(labelled) + 2.0::DOUBLE) AS prior
  FROM merging WHERE level = -1 GROUP BY ALL),
pure AS (
  SELECT host, template, (b.bad + prior * 2.0::DOUBLE) / (b.labelled + 2.0::DOUBLE) AS purity
  FROM (SELECT * FROM merging WHERE level = -1) m JOIN branches b USING (host, branch)
  JOIN heads ON head = regexp_extract(template, '^/[^/]*'))
SELECT page_id, l.host, l.path, rule, coalesce(verdict, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM l JOIN tree USING (host, path) JOIN pure ON pure.host = l.host AND pure.template = tree.template
"""


@query
def op10_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(
        table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"), lambda x: F.floor(256 * x)
    )
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS found_id, a.label = r.label AS same,
         CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, found_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, found_id) <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, found_id AS negative_id, positive_score, score AS negative_score
FROM (
  SELECT p.*, found_id, score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, found_id) AS k
  FROM positives p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE k <= 10
"""


@query
def op12_fingerprints(spark, sf_dir):
    return fingerprints.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Bytes as pairs of hexadecimal digits, one row per triplet; the buckets, costs and steps are written out.
ORACLES["op12_fingerprints"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS MATERIALIZED (
  SELECT rid, doc_id, t, lead(rid) OVER w AS after, first_value(rid) OVER w AS first, length(t) AS n
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS MATERIALIZED (
  SELECT n.rid, n.doc_id, n.n, x.rid AS after, n.t, left(n.t, n.n - n.n // 3) || left(x.t, n.n // 3) AS changed
  FROM n JOIN d x ON x.rid = coalesce(n.after, n.first)),
texts AS MATERIALIZED (
  SELECT rid, 'own' AS kind, t FROM e UNION ALL SELECT rid, 'changed', changed FROM e),
bytes AS MATERIALIZED (
  SELECT rid, kind, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM texts),
triplets AS (
  SELECT rid, kind, ((x[1] + 256 * x[2] + 65536 * x[3]) * 2654435761 % 4294967296) // 8388608 AS bucket
  FROM (SELECT rid, kind, unnest(list_zip(b[:-3], b[2:-2], b[3:])) AS z FROM bytes WHERE len(b) > 2)
  CROSS JOIN LATERAL (SELECT [z[1], z[2], z[3]] AS x)),
counts AS MATERIALIZED (SELECT rid, kind, bucket, count(*) AS c FROM triplets GROUP BY ALL),
every AS (
  SELECT rid, kind, bucket, coalesce(c, 0) AS c
  FROM (SELECT rid, kind, unnest(range(512)) AS bucket FROM texts) LEFT JOIN counts USING (rid, kind, bucket)),
lists AS (SELECT rid, kind, list(c ORDER BY bucket) AS cs, list(c ORDER BY c) AS s FROM every GROUP BY ALL),
prints AS MATERIALIZED (
  SELECT rid, kind, CAST(floor(4 * log2(1 + len(b))) AS BIGINT) AS steps,
         list_transform(cs, lambda c: CAST(c > s[128] AS INT) + CAST(c > s[256] AS INT) + CAST(c > s[384] AS INT)) AS q
  FROM lists JOIN bytes USING (rid, kind)),
shown AS MATERIALIZED (
  SELECT rid, kind, steps, q, lower(array_to_string(list_transform(list_prepend(steps, list_transform(range(128),
         lambda i: 64 * q[4 * i + 1] + 16 * q[4 * i + 2] + 4 * q[4 * i + 3] + q[4 * i + 4])),
         lambda x: lpad(hex(CAST(x AS BIGINT)), 2, '0')), '')) AS fingerprint
  FROM prints)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(changed) AS edited_sha256, o.fingerprint,
       c.fingerprint AS edited_fingerprint,
       greatest(832 - list_sum(list_transform(list_zip(o.q, c.q), lambda x: [0, 1, 2, 6][1 + abs(x[1] - x[2])]))
                    - 16 * least(abs(o.steps - c.steps), 16), 0) / 832 AS near_edited,
       greatest(832 - list_sum(list_transform(list_zip(o.q, f.q), lambda x: [0, 1, 2, 6][1 + abs(x[1] - x[2])]))
                    - 16 * least(abs(o.steps - f.steps), 16), 0) / 832 AS near_next
FROM e JOIN shown o ON o.rid = e.rid AND o.kind = 'own' JOIN shown c ON c.rid = e.rid AND c.kind = 'changed'
JOIN shown f ON f.rid = e.after AND f.kind = 'own'
"""


@query
def op13_word_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    start = g % n
    order = F.when(
        (h % 10 == 0) & (n > 0),
        F.struct(start.alias("start"), (1 + F.floor((n - start) / (3 + g % 8))).alias("period")),
    )
    found = runs.annotate(docs, order)
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate(
        "runs",
        F.lit(None).cast(found.schema["runs"].dataType.elementType),
        lambda top, x: F.when(
            top.isNull() | (x["length"] * top["period"] > top["length"] * x["period"]), x
        ).otherwise(top),
    )
    line = lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))
    return found.withColumn("top", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("top")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
