"""A positional index of stemmed words, kept as a table that searches read by term."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dijkstone.functions.stems import ACCENTED, PLAIN, dutch_stem
from dijkstone.functions.text import tokens

#: Fixed value: words of a search by beginnings.
MOST_PREFIXES = 10
#: Letters of a term by which its partition is found; stems keep them, but for accents.
HEAD = 2


def _spelled(letters: str) -> list[str]:
    """The letters with all accents that a stem loses."""
    return ["".join(x) for x in product(*[[c, *(a for a, p in zip(ACCENTED, PLAIN) if p == c)] for c in letters])]


class Postings:
    """The index below a folder.

    Postings (word, id, n, tf, places) lie in ``heads`` partitions by the first letters of the word without accents, sorted by
    word; the vocabulary (word, term) lies in the same partitions, sorted by term. A stem begins with the same letters as its
    words, so a search lists the partitions of its terms alone, finds their words in the vocabulary, and the statistics of the
    files exclude most postings. A frequent word is spread over ``slices`` tasks and files by document. Texts of a key are one
    row; null texts and texts without words have no postings, but null texts count as documents.
    """

    def __init__(self, spark: SparkSession, path: str, heads: int = 32):
        self.spark, self.path, self.heads = spark, path.rstrip("/"), heads

    def _head(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.left(F.translate(term, ACCENTED, PLAIN), F.lit(HEAD))), F.lit(self.heads)).cast("int")

    def write(self, docs: DataFrame, key: str, text: str, slices: int | None = None) -> Postings:
        """Index all texts. They are dealt over ``slices`` (the session's shuffle partitions) by document, and that is the one
        shuffle of words: a task counts and sorts its documents. Each different word is stemmed once, from what is written."""
        n = slices or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition(n, "id")
        rows = dealt.select("id", tokens(F.col("text"), []).alias("w")).select("id", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "word"))
        # An inner explode would also ask before the shuffle whether there are words, and so part all texts twice.
        held = rows.where("word is not null").groupBy("id", "n", "word").agg(F.sort_array(F.collect_list("at")).alias("places"))
        held = held.select("word", "id", "n", "places", F.size("places").alias("tf"), self._head(F.col("word")).alias("head")).sortWithinPartitions("head", "word", "id")
        held.write.partitionBy("head").parquet(f"{self.path}/postings")
        no_id = F.lit(None).cast(held.schema["id"].dataType).alias("id")  # tells a reader the type, also of an empty index
        total = self.spark.read.schema("tf int").parquet(f"{self.path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        sizes = docs.agg(F.count("*").alias("docs"), F.count(text).alias("texts")).crossJoin(F.broadcast(total))  # one row
        sizes.select("docs", F.try_divide("words", "texts").alias("mean_n"), no_id).write.parquet(f"{self.path}/corpus")
        words = self.held().select("head", "word").distinct().select("word", dutch_stem(F.col("word")).alias("term"), "head")
        words.sortWithinPartitions("head", "term").write.partitionBy("head").parquet(f"{self.path}/vocabulary")
        return self

    def corpus(self) -> DataFrame:
        """(docs, mean_n): one row."""
        return self.spark.read.parquet(f"{self.path}/corpus").select("docs", "mean_n")

    def held(self) -> DataFrame:
        """All postings, by word."""
        of_id = self.spark.read.parquet(f"{self.path}/corpus").schema["id"].dataType.simpleString()
        schema = f"word string, id {of_id}, n int, places array<int>, tf int, head int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def vocabulary(self) -> DataFrame:
        """(word, term) of all words."""
        return self.spark.read.schema("word string, term string, head int").parquet(f"{self.path}/vocabulary")

    def _of(self, words: DataFrame, terms: list[tuple[str, int]], heads: list[int] | None) -> DataFrame:
        """(term, id, n, tf, places): postings of these words of the vocabulary, which begin like the terms."""
        begins = {x for t, _ in terms for x in _spelled(t[:HEAD])}
        held = self.held() if heads is None else self.held().where(F.col("head").isin(heads))
        held = held.where(reduce(lambda x, y: x | y, [F.startswith("word", F.lit(x)) for x in sorted(begins)], F.lit(False)))
        met = held.join(words, ["head", "word"]).groupBy("term", "id", "n")
        return met.agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))

    def asked(self, words: list[str]) -> list[tuple[str, int]]:
        """Stems of a caller's words, each once, with their partitions."""
        rows = self.spark.range(1).select(F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("w")).select(dutch_stem(F.trim("w")).alias("t"))
        return [tuple(r) for r in rows.select("t", self._head(F.col("t"))).where("t <> ''").collect()]

    def of_terms(self, terms: list[tuple[str, int]]) -> DataFrame:
        """Postings of these terms."""
        heads = sorted({h for _, h in terms})
        words = self.vocabulary().where(F.col("head").isin(heads) & F.col("term").isin([t for t, _ in terms]))
        return self._of(words, terms, heads)

    def of_prefixes(self, terms: list[tuple[str, int]]) -> DataFrame:
        """Postings of all terms that begin with one of these; a beginning of one letter may lie in any partition."""
        fit = F.lit(False)
        for t, h in terms:
            here = F.startswith("term", F.lit(t))
            fit = fit | ((F.col("head") == h) & here if len(t) >= HEAD else here)
        heads = None if any(len(t) < HEAD for t, _ in terms) else sorted({h for _, h in terms})
        return self._of(self.vocabulary().where(fit), terms, heads)

    def any_of(self, words: list[str]) -> DataFrame:
        """(id, n_terms): texts with any of the words, and how many of their stems they hold."""
        return self.of_terms(self.asked(words)).groupBy("id").agg(F.count("*").alias("n_terms"))

    def all_prefixes(self, words: list[str]) -> DataFrame:
        """(id): texts where each word (the first ten) begins some word, by stems; no words find nothing."""
        terms = sorted(set(self.asked(words[:MOST_PREFIXES])))
        begun = [F.max(F.startswith("term", F.lit(t))).alias(f"p{i}") for i, (t, _) in enumerate(terms)]
        if not terms:
            return self.of_prefixes(terms).select("id")
        found = self.of_prefixes(terms).groupBy("id").agg(*begun)
        return found.where(" and ".join(f"p{i}" for i in range(len(terms)))).select("id")

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, at): places where the words follow each other, by stems. Each place votes for the start it would belong to."""
        terms = self.asked(words)
        slots = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, _) in enumerate(terms)]), lambda s: s["t"] == F.col("term"))
        if not terms:
            return self.of_terms(terms).select("id", F.lit(0).alias("at"))
        starts = self.of_terms(terms).select("id", F.explode(F.flatten(F.transform("places", lambda p: F.transform(slots, lambda s: p - s["i"])))).alias("at"))
        return starts.groupBy("id", "at").agg(F.count("*").alias("votes")).where(F.col("votes") == len(terms)).select("id", "at")

    def ranked(self, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score): BM25 of the texts with any of the words, from postings alone."""
        hits = self.of_terms(self.asked(words)).select("id", "n", "tf", "term")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the search
        both = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.corpus()))  # one row
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean_n")))
        return both.groupBy("id").agg(F.sum(part).alias("score"))
