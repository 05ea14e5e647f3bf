"""Text as Column expressions: normalising, labels, tokens, n-grams, matching, full-text scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tags(c: Column, by: str = " ") -> Column:
    """Markup out, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", by), r"\s+", " "))


def article_label(heading: Column, wid: Column) -> Column:
    """The heading, else "Artikel" and the number in the id, else null."""
    number = F.nullif(F.regexp_extract(wid, "art_([^_]+)", 1), F.lit(""))
    return F.coalesce(F.nullif(F.trim(heading), F.lit("")), F.concat(F.lit("Artikel "), number))


def normal_hash(c: Column) -> Column:
    """MD5 of the trimmed text with single spaces; null stays null."""
    return F.md5(F.trim(F.regexp_replace(c, r"\s+", " ")).cast("binary"))


#: Question words and fillers that carry no content, and verbs of action.
STOP_WORDS = (
    "de", "het", "een", "van", "in", "op", "is", "wat", "mag", "mogen", "mocht", "ik", "hier", "er", "kan", "kunnen",
    "kunt", "die", "dat", "voor", "met", "aan", "te", "en", "of", "wel", "niet", "hoe", "waar", "mijn", "jouw", "onze",
    "uw", "zijn", "worden", "moet", "moeten", "deze", "dit", "wil", "wilt", "wilde", "willen", "als", "dan", "nog", "al",
    "maar", "ook", "zo", "gebruiken", "doen", "gaan", "komen", "laten", "maken", "iets", "graag", "even", "eigenlijk",
    "over", "qua", "geldt", "gelden", "geldend", "geldende", "omtrent", "inzake", "betreft", "betreffende", "regelgeving",
    "regels", "regel", "hierover", "welke", "welk", "wanneer", "waarom", "wie", "wiens", "hoeveel", "waarmee", "waarvoor",
    "waaraan", "waarbij", "waarin", "waarop", "waarover", "waarnaar", "waardoor", "waaruit", "hiervoor", "hierbij",
    "hieronder", "daarbij", "daarvoor", "daarover", "alle", "elke", "elk", "iedere", "ieder", "sommige", "enkele",
)


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Words in lower case without stop words and single characters; hyphen and & stay inside a word."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s\-&]", " ")), r"\s+")
    stops = F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words)).cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def stem_variant(w: Column) -> Column:
    """Plural to singular: of six letters or more an ending ``en`` or ``s`` goes; else null."""
    return F.when(F.length(w) < 6, None).when(F.endswith(w, F.lit("en")), F.left(w, F.length(w) - 2)).when(F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1))


def _gram(words: Column, n: int):
    """The n words from a place on, and their variant with a stemmed last word (or null)."""

    def at(i):
        part = F.slice(words, i, n)
        last = stem_variant(F.element_at(part, -1))
        variant = F.array_join(F.concat(F.slice(part, 1, n - 1), F.array(last)), " ") if n > 1 else last
        return F.array(F.array_join(part, " "), F.when(last.isNotNull(), variant))

    return at


def ngrams(words: Column, longest: int = 3) -> Column:
    """1- to 3-grams, longest first, each followed by its variant with a stemmed last word, then the parts of hyphened words;
    each once, at its first place."""
    out = []
    for n in range(longest, 0, -1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))

        out.append(F.flatten(F.transform(starts, _gram(words, n))))
    pieces = F.transform(words, lambda w: F.filter(F.split(w, "-"), lambda p: F.length(p) > 1))
    pieces = F.filter(pieces, lambda p: F.size(p) >= 2)
    hyphened = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(F.array_join(p, " ")), F.flatten(F.transform(p, lambda q: F.array(q, stem_variant(q)))))))
    return F.array_distinct(F.array_compact(F.concat(*out, hyphened)))


def only_action(term: Column, actions: list[str]) -> Column:
    """Every word of the term is a verb of action (and there is one)."""
    words = F.regexp_extract_all(F.lower(term), F.lit("([a-zà-ÿ]+)"), F.lit(1))
    known = F.array(*map(F.lit, actions))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w))


def whole_word(text: Column, word: Column) -> Column:
    """The word stands in the text, bounded by something that is no letter, digit or underscore; case is ignored."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.rlike(text, quoted)


def match_strength(text: Column, word: Column) -> Column:
    """1.0 for a whole word, 0.7 within a word, 0 for none."""
    return F.when(whole_word(text, word), 1.0).when(F.contains(F.lower(text), F.lower(word)), 0.7).otherwise(0.0)


def matches_any(words: Column, query: Column) -> Column:
    """A text's tokens hold any of the query's (an OR query); an empty query matches nothing."""
    return (F.size(query) > 0) & F.arrays_overlap(words, query)


def matches_prefixes(words: Column, query: Column) -> Column:
    """Every word of the query begins a token."""
    return (F.size(query) > 0) & F.forall(query, lambda q: F.exists(words, lambda w: F.startswith(w, q)))


def bm25(docs: DataFrame, query: DataFrame, id_col: str = "id", words: str = "words", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents for query terms (column term): BM25, in place of the ranking of a text-search engine.

    Texts are cut down to the terms of the query before they are exploded and counted; the two corpus figures are one row.
    """
    sized = docs.select(F.col(id_col).alias("id"), words, F.size(words).alias("n"))
    corpus = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean_n"))
    asked = query.agg(F.collect_set("term").alias("__asked"))  # one row, as long as the query
    held = F.filter(words, lambda w: F.array_contains("__asked", w))
    hits = sized.crossJoin(F.broadcast(asked)).select("id", "n", F.explode(held).alias("term"))
    tf = hits.groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # df has a row for each query term, corpus one
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean_n")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def markdown_chunks(docs: DataFrame, text: str, blacklist: list[str], least: int = 50) -> DataFrame:
    """Sections of Markdown texts (front matter off), each with its heading; short and listed ones are left out."""
    body = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    parts = docs.select("*", F.posexplode(F.split(body, r"(?m)^## ")).alias("ord", "__part"))
    heading = F.when(F.col("ord") > 0, F.trim(F.substring_index("__part", "\n", 1)))
    content = F.regexp_replace(F.when(F.col("ord") > 0, F.regexp_replace("__part", r"(?s)\A[^\n]*\n?", "")).otherwise(F.col("__part")), r"^\s+|\s+$", "")
    rows = parts.withColumns({"heading": heading, "content": content}).drop("__part")
    return rows.where((F.length("content") >= least) & ~F.coalesce(F.lower("heading").isin([x.lower() for x in blacklist]), F.lit(False)))


def greedy_context(parts: DataFrame, group: str, order: list[str], size: str, budget: int = 6000) -> DataFrame:
    """Parts of each group in order, up to the first that would exceed the budget (later small ones don't slip in)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return parts.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def confidence(answer: Column) -> Column:
    """A confidence from 0 to 1 out of an answer like "confidence: 80%" or "confidence: 0.8"; null if there is none."""
    number = F.regexp_extract(answer, r"(?i)(?:confidence|zekerheid)\s*[:=]?\s*([0-9]+(?:[.,][0-9]+)?)", 1)
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 1, F.least(value / 100, F.lit(1.0))).otherwise(value)
