"""URL filtering by a path-template tree.

A url has a host and a path; given rules decide first, the longest that fits. The rest is decided per host: segments with
digits become wildcards, then the tree is walked from the root, level by level. A branch stays literal only if it holds
``LEAST_URLS`` urls, however many its parent has, and its labelled share of bad pages differs significantly (two-proportion
z-test) from that of its siblings; similar and rare branches merge into the wildcard. A template is blocked if its labelled purity, smoothed
towards its host's and that towards the overall purity, is below ``least_purity``.

The tree is built from counts of distinct digit-free templates, aggregated before any shuffle; the pages themselves meet
only the finished verdicts. Levels are walked as long as some template has ``LEAST_URLS`` urls that go deeper; beyond that no
branch can stay literal, so all further segments are wildcards.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, and is judged like any other
host. Null labels and labels of unknown pages don't count; repeated pages count each. With no label everything without a
rule is allowed. Extra columns pass through; one that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dijkstone.llm.common import discard, materialize, splittable_join

RESULTS = ("host", "path", "rule", "verdict", "template", "purity")
LEAST_URLS = 20
LEAST_Z = 2.58
#: Labelled pages that a prior counts as, and the purity below which a template is blocked.
PRIOR_PAGES, LEAST_PURITY = 20.0, 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*(/?[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, "host/path") that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):
        top, _, tail = r.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Path segments with those that hold digits as wildcards."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda x: F.when(F.rlike(x, F.lit("[0-9]")), "*").otherwise(x))


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "page_id", bad_col: str = "bad"
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity. ``labels``: which pages (label_id) are bad (0 or 1)."""
    pages = pages.drop(*(c for c in RESULTS if c not in (id_col, url_col)))
    names = pages.columns
    host, path = host_and_path(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path}).withColumn("__segments", _segments(F.col("path")))
    known = labels.where(F.col(label_id).isNotNull() & F.col(bad_col).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.max(F.col(bad_col).cast("int")).alias("__bad"))
    counted = pages.select(F.col(id_col).alias("__id"), "host", "__segments").join(known, "__id", "left")
    sums = [F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad")]
    raw = counted.groupBy("host", F.col("__segments").alias("segments")).agg(F.count("*").alias("n"), F.count("__bad").alias("seen"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    raw = materialize(raw, "templates")
    tree, before, level = raw.withColumn("template", F.lit("")), None, 0
    while not tree.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_URLS).isEmpty():
        here = F.get("segments", F.lit(level))
        child = tree.where(here.isNotNull()).groupBy("host", "template", here.alias("segment")).agg(*sums)
        parent = child.groupBy("host", "template").agg(F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"))
        both = splittable_join(child, parent, "host", "template")
        others, rest = F.col("all_seen") - F.col("seen"), F.col("all_bad") - F.col("bad")
        share = F.try_divide("all_bad", "all_seen")
        spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), "seen") + F.try_divide(F.lit(1), others)))
        z = F.coalesce(F.try_divide(F.abs(F.try_divide("bad", "seen") - F.try_divide(rest, others)), spread), F.lit(0.0))
        literal = (F.col("n") >= LEAST_URLS) & (z >= LEAST_Z)
        chosen = both.select("host", "template", "segment", F.when(literal, F.col("segment")).otherwise("*").alias("as"))
        tree = tree.withColumn("segment", here).join(chosen, ["host", "template", "segment"], "left")
        below = tree.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "as"))).drop("segment", "as")
        below = materialize(below, "tree")  # each level is one pass over the templates
        discard(before)
        tree = before = below
        level += 1
    tree = tree.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))))

    sums_ = raw.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (sums_[0] - sums_[1] + 1) / (sums_[0] + 1)
    hosts = raw.groupBy("host").agg(F.sum("seen").alias("s"), F.sum("bad").alias("b"))
    hosts = hosts.select("host", ((F.col("s") - F.col("b") + PRIOR_PAGES * overall) / (F.col("s") + PRIOR_PAGES)).alias("of_host"))
    pure = splittable_join(tree.groupBy("host", "template").agg(F.sum("seen").alias("s"), F.sum("bad").alias("b")), hosts, "host")
    pure = pure.select("host", "template", ((F.col("s") - F.col("b") + PRIOR_PAGES * F.col("of_host")) / (F.col("s") + PRIOR_PAGES)).alias("purity"))
    verdicts = tree.select("host", "template", F.col("segments").alias("__segments")).join(pure, ["host", "template"])

    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.join(verdicts, ["host", "__segments"], "left").withColumns({"rule": rule, "verdict": F.coalesce(said, F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))})
    return out.select(*names, *RESULTS)
