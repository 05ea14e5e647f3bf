"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window is contained only if
all its words are there, so its necessary prefix is one token: its rarest word, by counts over all documents. Each document
word that is such a token meets the windows it stands for; the offset gives the one start at which the window can lie
(positional bound), the text must be long enough for it (length bound), and then the words are compared exactly.

The window table is broadcast only if its counted size is within ``broadcast_windows``; beyond it the same join runs
shuffled, and verifies after joining candidates back to their texts.

Defined results: a null text or item has no words; an item without words is no item. A row with a null id gets its own
result. Rows equal in id and text get equal results, rows that share only the id are judged apart. Repeated item rows
count once per item_id; an item with a null id takes part as hit words but isn't listed or counted. Extra columns pass
through; one that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Windows (of up to 13 words) that are broadcast at most: some 40 MB.
BROADCAST_WINDOWS = 200_000

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Words of a text, A-Z as a-z; null: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _APART), "")


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, window): the windows of each item as arrays of words."""
    worded = items.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return worded.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.least(F.size("w"), F.lit(window))).alias("window")).distinct()


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, window, before): of each distinct window its rarest word and the number of words before it."""
    parts = windows.select("window").distinct().select("window", F.posexplode("window").alias("before", "token"))
    known = parts.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("window").agg(F.min(F.struct("n", "token", "before")).alias("p"))
    return rarest.select(F.col("p.token").alias("token"), "window", F.col("p.before").alias("before"), F.size("window").alias("size"), F.col("window")[0].alias("head"))


def occurrences(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(key, start, window): where the distinct ``windows`` lie in ``docs`` (key, text)."""
    maybe = F.broadcast if small else (lambda x: x)
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    tokens = docs.select(F.explode(words_of("text")).alias("token"))
    if not small:  # one row for each word and task before anything is joined
        counts = tokens.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token", "left_semi")
    else:
        counts = tokens.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    prefixes = _prefixes(windows, counts)
    worded = docs.select("key", words_of("text").alias("words"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("words"))
    same = fits & (F.get("words", F.col("start")) == F.col("head")) & (F.slice("words", F.when(fits, F.col("start") + 1).otherwise(1), F.col("size")) == F.col("window"))
    if small:
        placed = worded.select("key", "words", F.posexplode("words").alias("at", "token")).join(maybe(prefixes), "token").withColumn("start", F.col("at") - F.col("before"))
        return placed.where(same).select("key", "start", "window")
    placed = worded.select("key", F.size("words").alias("n"), F.posexplode("words").alias("at", "token")).join(prefixes, "token").withColumn("start", F.col("at") - F.col("before"))
    placed = placed.where("start >= 0 and start + size <= n").select("key", "start", "window", "size", "head")
    return placed.join(worded, "key").where(same).select("key", "start", "window").distinct()


def judge(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit)."""
    docs = docs.drop(*(c for c in RESULTS if c not in (id_col, text_col)))
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.withColumn("__key", key)
    listed = _windows(benchmark, item_id, item_text, window)
    small = listed.select("window").distinct().limit(broadcast_windows + 1).count() <= broadcast_windows
    maybe = F.broadcast if small else (lambda x: x)
    found = occurrences(keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), listed, small)
    ends = F.col("start") + F.size("window") - 1
    per_doc = found.groupBy("key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", ends))))).alias("n_hit"), F.collect_set("window").alias("windows")
    )
    named = per_doc.select("key", "n_hit", F.explode("windows").alias("window")).join(maybe(listed), "window")
    hits = named.groupBy(F.col("key").alias("__key")).agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD)).cast("long")
    out = keyed.withColumn("n_words", n_words).join(hits, "__key", "left")
    out = out.withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256)}
    )
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")).select(*docs.columns, *RESULTS)
