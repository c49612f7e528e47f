"""Verdicts on page addresses: rules on hosts and paths, and a tree of path templates for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A rule fits its host and all subdomains if the path starts with the rule's; the
longest host plus path wins.

The tree has one root per host. Level by level, a segment that takes many values for few pages each is
generalised to ``*``; a segment of a file name keeps its ending (``*.html``). What is deeper than
``LEVELS`` segments is one ``**``. Then, from the deepest level up, branches of a host that differ in one
literal segment only are a family: those whose labelled share of bad pages does not differ beyond chance
from that of the family become one branch with ``?`` there, and a branch without labels goes with the
family. The purity of a template is the share of bad pages in its branch, smoothed by ``STRENGTH``
pseudo-pages towards the share of all templates, on any host, with the same first segment, which is smoothed
towards ``PRIOR`` likewise; so a branch without any label takes the share of those it resembles. Templates
are rejected from ``REJECT`` on.

Labels are what the rules say and those of a labelled table (url, bad). Without a table, the pages of even
page_id under no rule are labelled: bad if a word of the host is one of ``BAD_WORDS``, else good. All other
pages are judged by the tree alone, whatever their host is called.

The tree is made of counts of (host, path), so pages are aggregated before any of it. Nulls: a null
address, or one without ``://``, has an empty host and path and the template of the empty path. Repeated
rows count each. Ties between rules cannot happen, as rules are different. An empty table gives an empty
table. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.skew import lookup_join
from lectern.session import cut_lineage

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Words of hosts that mark a labelled page as bad.
BAD_WORDS = ("casino", "bets", "pills", "spam", "adult", "ads")

LEVELS = 6
MANY_VALUES = 8
FEW_PAGES = 4
PRIOR, STRENGTH, REJECT = 0.2, 2.0, 0.5
#: Squared standard score (one degree of freedom) up to which two shares are alike.
ALIKE = 3.84


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(cast(url AS string), instr(cast(url AS string), '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return pages.select(
        "page_id", "url", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")
    )


def _rule() -> F.Column:
    """The winning rule of a host and path as host + path, with its verdict; null if none fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segment(level: int) -> F.Column:
    """The segment of a level: null beyond the path, ``**`` for all that is deeper than the tree."""
    rest = F.split(F.col("path"), "/")
    if level == LEVELS:
        return F.when(F.size(rest) > level + 1, F.lit("**"))
    return F.get(rest, F.lit(level + 1))


def templates(addresses: DataFrame) -> DataFrame:
    """``addresses`` (host, path, pages, ...), one row each, with the ``template`` of the path."""
    out = addresses.withColumn("template", F.lit(""))
    for level in range(LEVELS + 1):
        out = out.withColumn("_s", _segment(level))
        values = out.where("_s is not null").groupBy("host", "template", "_s").agg(F.sum("pages").alias("n"))
        nodes = values.groupBy("host", "template").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
        varied = nodes.where((F.col("v") >= MANY_VALUES) & (F.col("n") < FEW_PAGES * F.col("v")))
        varied = cut_lineage(varied.select("host", "template", F.lit(True).alias("_many")))
        out = lookup_join(out, varied, ["host", "template"], ["path"])
        ending = F.regexp_extract("_s", r"(\.[A-Za-z]{1,5})$", 1)
        name = F.when(F.col("_many") & (F.col("_s") != ""), F.concat(F.lit("*"), ending)).otherwise(F.col("_s"))
        step = F.when(F.col("_s").isNotNull(), F.concat("template", F.lit("/"), name)).otherwise(F.col("template"))
        out = cut_lineage(out.withColumn("template", step).drop("_s", "_many"))
    return out


def _literal(level: int) -> F.Column:
    """A branch with ``?`` for the segment of a level; the branch itself if that is none or no literal one."""
    parts = F.split("branch", "/")
    own = F.coalesce(F.get(parts, F.lit(level + 1)), F.lit(""))
    ending = F.regexp_extract(own, r"(\.[A-Za-z]{1,5})$", 1)
    there = F.transform(parts, lambda x, i: F.when(i == level + 1, F.concat(F.lit("?"), ending)).otherwise(x))
    return F.when((own == "") | own.rlike(r"^[*?]"), F.col("branch")).otherwise(F.array_join(there, "/"))


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))


def branches(tree: DataFrame) -> DataFrame:
    """host, template, bad, labelled and the merged ``branch`` of every leaf of ``tree``. What differs from
    its family in one level may still be merged in another."""
    leaves = cut_lineage(_counts(tree, "host", "template").withColumn("branch", F.col("template")))
    for level in reversed(range(LEVELS)):
        own = cut_lineage(_counts(leaves, "host", "branch").withColumn("to", _literal(level)).where("to <> branch"))
        family = own.groupBy("host", "to").agg(F.sum("bad").alias("_b"), F.sum("labelled").alias("_l"))
        share = F.col("_b") / F.col("_l")
        score = F.pow(F.col("bad") - F.col("labelled") * share, 2) / (F.col("labelled") * share * (1 - share))
        alike = F.when((F.col("labelled") == 0) | share.isin(0.0, 1.0), True).otherwise(score <= ALIKE)
        merged = lookup_join(own, cut_lineage(family), ["host", "to"], ["branch"], "inner").where(alike)
        merged = cut_lineage(merged.select("host", "branch", "to"))
        leaves = lookup_join(leaves, merged, ["host", "branch"], ["template"])
        leaves = cut_lineage(leaves.withColumn("branch", F.coalesce("to", "branch")).drop("to"))
    return leaves


def purities(tree: DataFrame) -> DataFrame:
    """One row per (host, template) of ``tree`` (host, path, template, pages, bad, labelled): the branch it
    belongs to and the smoothed share of bad pages there."""
    leaves = branches(tree).withColumn("head", F.regexp_extract("template", "^/[^/]*", 0))
    towards = (F.sum("bad") + PRIOR * STRENGTH) / (F.sum("labelled") + STRENGTH)
    heads = cut_lineage(leaves.groupBy("head").agg(towards.alias("prior")))
    own = cut_lineage(_counts(leaves, "host", "branch"))
    leaves = lookup_join(leaves.drop("bad", "labelled"), heads, ["head"], ["host", "template"], "inner")
    found = lookup_join(leaves, own, ["host", "branch"], ["template"], "inner")
    purity = (F.col("bad") + F.col("prior") * STRENGTH) / (F.col("labelled") + STRENGTH)
    return found.select("host", "template", "branch", purity.alias("purity"))


def judge(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch and purity of every row of ``pages``.

    ``labels`` (url, bad) is the labelled table of pages that no rule decides.
    """
    known = parts(pages).withColumn("found", _rule())
    if labels is None:
        words = F.split("host", "[.-]")
        bad = F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS)))
        known = known.withColumn("_seed", F.when(F.col("page_id") % 2 == 0, bad))
    else:
        own = labels.groupBy("url").agg(F.max(F.col("bad").cast("boolean")).alias("_seed"))
        known = lookup_join(known, cut_lineage(own), ["url"], ["page_id"])
    bad = F.coalesce(F.col("found.verdict") == "block", F.col("_seed"))
    known = cut_lineage(known.withColumn("_bad", bad).drop("url", "_seed"))
    addresses = known.groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.count_if("_bad").alias("bad"),
        F.count("_bad").alias("labelled"),
    )
    tree = templates(addresses)
    named = lookup_join(tree, cut_lineage(purities(tree)), ["host", "template"], ["path"], "inner")
    named = cut_lineage(named.select("host", "path", "template", "branch", "purity"))
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return lookup_join(known, named, ["host", "path"], ["page_id"]).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"), "template", "branch", "purity",
    )
