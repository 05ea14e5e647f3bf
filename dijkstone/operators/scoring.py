"""Keyword and concept scores, cutoffs, hybrid retrieval and nearest centroids."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dijkstone.functions.text import match_strength

#: Weights of fields, of concept matches and of cutoffs.
FIELD_WEIGHTS = (1.0, 0.5, 0.7, 0.3, 0.3, 0.2)
SYNONYM_CENTRALITY, ACTIVITY_BOOST, CONCEPT_CUTOFF, TEXT_CUTOFF = 0.6, 1.5, 0.35, 0.4
RRF_K, CENTRAL_TIER_WEIGHT = 60, 0.55


def parse_weighted(text: str | None) -> dict[str, float]:
    """``term:weight`` pairs: weights between 0 and 1, a missing one is 1; what can't be read or isn't positive goes."""
    out: dict[str, float] = {}
    for part in (text or "").split(","):
        term, _, w = part.strip().rpartition(":") if re.search(r":\s*-?[\d.]+\s*$", part) else (part.strip(), "", "1")
        try:
            weight = min(1.0, float(w))
        except ValueError:
            continue
        term = term.strip(" :").lower()
        if term and weight > 0:
            out.setdefault(term, weight)
    return out


def keyword_table(spark, words: dict[str, float]) -> DataFrame:
    """A small table (term, weight); as many rows as a caller typed."""
    return spark.createDataFrame(list(words.items()), "term string, weight double")


def field_score(df: DataFrame, words: DataFrame, fields: dict[str, float], key: str) -> DataFrame:
    """(key, score): sum over keywords of weight x the best of field weight x match strength. Every row meets every typed keyword."""
    each = df.crossJoin(F.broadcast(words))  # keywords are a caller's handful
    best = F.greatest(F.lit(0.0), *[match_strength(F.coalesce(F.col(f), F.lit("")), F.col("term")) * w for f, w in fields.items()])
    return each.withColumn("part", F.col("weight") * best).where("part > 0").groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("term")).alias("terms"))


def composite_score(text_rank: Column, keyword: Column) -> Column:
    """Half full-text rank, half keyword score, rounded half even to four places."""
    return F.bround(0.5 * text_rank + 0.5 * keyword, 4)


def concept_matches(terms: DataFrame, concepts: DataFrame, synonyms: DataFrame, keywords: DataFrame) -> DataFrame:
    """(uri, term, source_rank): by name (1), synonym (2) or keyword (3), the best for each pair."""
    named = concepts.select("uri", F.lower("name").alias("term"), F.lit(1).alias("source_rank"))
    other = synonyms.select("uri", F.lower("synonym").alias("term"), F.lit(2).alias("source_rank"))
    loose = keywords.select("uri", F.lower("keyword").alias("term"), F.lit(3).alias("source_rank"))
    every = named.unionByName(other).unionByName(loose)
    return every.join(terms.select("term").distinct(), "term").groupBy("uri", "term").agg(F.min("source_rank").alias("source_rank"))


def preselected(matches: DataFrame, concepts: DataFrame, schemes: list[str], limit: int) -> DataFrame:
    """(uri, terms, n_terms, source_rank): concepts of the allowed schemes with all their terms; those of the most terms, the
    best source and the least uri, at most ``limit``. A concept has no more terms than the request."""
    allowed = matches.join(concepts.where(F.col("scheme").isin(schemes)).select("uri"), "uri", "left_semi")
    rows = allowed.groupBy("uri").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.min("source_rank").alias("source_rank"))
    return rows.withColumn("n_terms", F.size("terms")).orderBy(F.desc("n_terms"), "source_rank", "uri").limit(limit)


def term_frequency(concepts: DataFrame, synonyms: DataFrame, keywords: DataFrame) -> DataFrame:
    """(term, freq): in how many concepts a term stands, in whichever role."""
    every = concepts.select("uri", F.lower("name").alias("term")).union(synonyms.select("uri", F.lower("synonym"))).union(keywords.select("uri", F.lower("keyword")))
    return every.groupBy("term").agg(F.count_distinct("uri").alias("freq"))


def concept_score(matches: DataFrame, freq: DataFrame, n_keywords: DataFrame, boosted: DataFrame) -> DataFrame:
    """(uri, score): words squared x idf x centrality, summed over terms, more for activities."""
    m = matches.join(freq, "term", "left").join(n_keywords, "uri", "left")
    n = F.size(F.split("term", r"\s+"))
    idf = 1 / (1 + F.log(F.greatest(F.coalesce("freq", F.lit(1)), F.lit(1))))
    central = F.when(F.col("source_rank") <= 1, 1.0).when(F.col("source_rank") == 2, SYNONYM_CENTRALITY).otherwise(1 / (1 + F.log(F.greatest(F.coalesce("n_keywords", F.lit(1)), F.lit(1)))))
    summed = m.groupBy("uri").agg(F.sum(n * n * idf * central).alias("score"))
    lifted = summed.join(boosted.select("uri").distinct().withColumn("__b", F.lit(True)), "uri", "left")
    return lifted.select("uri", (F.col("score") * F.when(F.col("__b"), ACTIVITY_BOOST).otherwise(1.0)).alias("score"))


def relative_cutoff(df: DataFrame, score: str, share: float, group: list[str] | None = None) -> DataFrame:
    """Rows with at least ``share`` of the best score (of their group)."""
    if not group:
        top = df.agg(F.max(score).alias("__top"))
        return df.crossJoin(F.broadcast(top)).where(F.col(score) >= share * F.col("__top")).drop("__top")  # one row
    top = df.groupBy(*group).agg(F.max(score).alias("__top"))
    return df.join(top, group).where(F.col(score) >= share * F.col("__top")).drop("__top")


def content_first(df: DataFrame, action: str) -> DataFrame:
    """Without the matches that are only verbs of action, if any other is there."""
    some = df.agg(F.coalesce(F.bool_or(~F.col(action)), F.lit(False)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(~F.col(action) | ~F.col("__some")).drop("__some")  # one row


def score_and_cut(df: DataFrame, score: str, content_hit: str, limit: int, tie: str, share: float = TEXT_CUTOFF) -> DataFrame:
    """Rows with a content hit and at least ``share`` of the best score, at most ``limit``. Without any, the first rows with a null score."""
    good = df.where(F.col(content_hit))
    cut = relative_cutoff(good, score, share).orderBy(F.desc(score), tie).limit(limit)
    none = good.limit(1).agg((F.count("*") == 0).alias("__none"))
    rest = df.orderBy(tie).limit(limit).crossJoin(F.broadcast(none)).where("__none").drop("__none").withColumn(score, F.lit(None).cast("double"))  # one row
    return cut.unionByName(rest)


def term_weight(is_content: Column, freq: Column, source: Column) -> Column:
    """Word class (content 1, else a half) x idf x weight of the source."""
    return F.when(is_content, 1.0).otherwise(0.5) * (1 / (1 + F.log(F.greatest(freq, F.lit(1))))) * source


def weighted_keywords(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(term, weight) from several sources in order of trust; the first source of a term wins; ordered by weight, then length."""
    every = reduce(DataFrame.unionByName, [d.select("term").distinct().withColumns({"weight": F.lit(w), "__o": F.lit(i)}) for i, (d, w) in enumerate(parts)])
    first = every.groupBy("term").agg(F.min_by("weight", "__o").alias("weight"))
    return first.orderBy(F.desc("weight"), F.desc(F.length("term")), "term")


def chips(terms: DataFrame, rare: int = 5) -> DataFrame:
    """Terms to show: of several words always, single words only if they stand in few concepts; else verbs of action too."""
    several = F.size(F.split("term", r"\s+")) > 1
    fit = terms.where(several | (F.coalesce("freq", F.lit(0)) <= rare))
    return content_first(fit, "action")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, query: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """(key, cosine, rank) of the k vectors nearest to one query vector (a one-row table with column q)."""
    scored = vectors.crossJoin(F.broadcast(query.select(F.col(vector).alias("q")).limit(1))).select(key, cosine(F.col(vector), F.col("q")).alias("cosine"))  # one row
    top = scored.where("cosine is not null").orderBy(F.desc("cosine"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), key)))


def fuse_ranks(lists: dict[str, DataFrame], key: str, weight: Column | None = None, k: int = RRF_K) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked lists (key, rank)."""
    every = reduce(DataFrame.unionByName, [d.select(key, (1 / (k + F.col("rank"))).alias("part")) for d in lists.values()])
    fused = every.groupBy(key).agg(F.sum("part").alias("score"))
    return fused.withColumn("score", F.col("score") * weight) if weight is not None else fused


def nearest_centroid(vectors: DataFrame, vector: str, key: str, label: str, classes: list | None = None, least: float | None = None) -> DataFrame:
    """(key, nearest label, similarity): by cosine to the mean vector of each label; below ``least`` no label.

    Means are summed per component, pre-aggregated; there is one per label, and the labels are a code list.
    """
    parts = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "v"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centroids = means.groupBy(F.col(label).alias("nearest")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))
    if classes is not None:
        centroids = centroids.where(F.col("nearest").isin(classes))
    scored = vectors.select(key, vector).crossJoin(F.broadcast(centroids)).withColumn("similarity", cosine(F.col(vector), F.col("c")))  # one row a label
    best = scored.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("nearest")).alias("n"))).alias("b"))
    out = best.select(key, (-F.col("b.n")).alias("nearest"), F.col("b.similarity").alias("similarity"))
    return out if least is None else out.withColumn("nearest", F.when(F.col("similarity") >= least, F.col("nearest")))


def text_fallback(texts: DataFrame, scopes: list[DataFrame], terms: list[str], key: str, fields: list[str], order: list[str], least: int = 5) -> DataFrame:
    """Rows of the keys in any scope where a term begins a word of any field, the first in order for each key.

    Terms of fewer letters than ``least`` say too little and go; without any other nothing is found. The scopes cut the texts
    down before a text is searched.
    """
    kept = sorted({x.strip().lower() for x in terms if len(x.strip()) >= least})
    if not kept:
        return texts.where(F.lit(False))
    pattern = r"(?iU)(?<!\w)(" + "|".join(re.escape(x) for x in kept) + ")"
    within = reduce(DataFrame.unionByName, [s.select(key) for s in scopes]).distinct()
    found = reduce(Column.__or__, [F.coalesce(F.rlike(f, F.lit(pattern)), F.lit(False)) for f in fields])
    hits = texts.join(within, key, "left_semi").where(found)
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def word_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str, words: str, least: int = 5, share: float = 0.3) -> DataFrame:
    """Pairs of texts that share more than max(least, share x words of the first) distinct words of four letters or more."""
    long = lambda d, k: d.select(k, F.explode(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))).alias("w"))
    n = a.select(key_a, F.size(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))).alias("n"))
    shared = long(a, key_a).join(long(b, key_b), "w").groupBy(key_a, key_b).agg(F.count("*").alias("shared"))
    return shared.join(n, key_a).where(F.col("shared") > F.greatest(F.lit(least), share * F.col("n"))).select(key_a, key_b, "shared")


def match_vocabulary(texts: DataFrame, vocabulary: DataFrame, key: str, words: str, least: float = 0.5) -> DataFrame:
    """(key, entry, score): vocabulary entries by the share of their words that a text holds, through an inverted index.

    An entry that needs h of its m words is met by one of its m - h + 1 rarest at least, so only these are in the index, and a
    word that all entries have finds none. A text meets an entry at the first of these that it holds, and counts there.
    """
    entries = vocabulary.select("entry", F.explode("entry_words").alias("w")).distinct()
    rare = entries.join(entries.groupBy("w").agg(F.count("*").alias("df")), "w", "left")
    told = rare.groupBy("entry").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("df", "w")))).alias("s"))
    need = F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-9)).cast("int")
    told = told.select("entry", "n", F.col("s.w").alias("entry_words"), F.slice("s.w", F.lit(1), F.greatest(F.size("s") - need + 1, F.lit(0))).alias("first"))
    index = told.withColumn("w", F.explode("first"))
    met = texts.select(key, F.col(words).alias("held"), F.explode(F.array_distinct(words)).alias("w")).join(index, "w")
    met = met.where(F.get(F.filter("first", lambda x: F.array_contains("held", x)), F.lit(0)) == F.col("w"))
    score = F.size(F.array_intersect("held", "entry_words")) / F.col("n")
    return met.withColumn("score", score).where(F.col("score") >= least).select(key, "entry", "score")
