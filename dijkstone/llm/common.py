"""Helpers shared by the operators: folds, tokenising, rolling hashes, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dijkstone.sources.storage import discard, materialize, shared_dir

__all__ = ["Powers", "byte_slices", "connected_components", "discard", "in_fold", "in_small_batches", "materialize", "mix64", "plain_words", "prefix_ends", "ranges", "run_hash", "shared_dir", "sliding_argmin", "span_hash", "splittable_join", "word_spans", "word_table"]


def in_fold(key: str, of: int):
    """crc32 of the id as text, modulo ``of``: the fold of a row."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


#: Rows of an Arrow batch between Spark and Python at most: whole texts are handed over, so a batch of the default 10,000 is large.
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches have been bounded to BATCH_ROWS (a smaller setting stays)."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def splittable_join(many: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """Inner join to one aggregated row a key. The extra key has both sides shuffled for the join itself (the rows of an
    aggregate lie by its own keys already); only then can adaptive execution split a key that holds much of ``many``."""
    extra = F.xxhash64(*keys)
    return many.withColumn("__extra", extra).join(few.withColumn("__extra", extra), [*keys, "__extra"]).drop("__extra")


# ---------------------------------------------------------------- words as arrays

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # 0x09-0x0D and 0x20 part words
_U64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


def byte_slices(texts, limit: int = 500_000):
    """Cut an Arrow string array into ranges of rows with about ``limit`` bytes of text (one row at least)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == "string" else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


#: Bytes that part words of letters, and of letters and digits: all other ASCII. Bytes of other characters are within words.
NO_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
NO_LETTER_OR_DIGIT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def plain_words(texts, digits: bool):
    """An Arrow string array in lower case with every run of other characters than letters (and digits) as one space, or as
    it is where the table for ``word_spans``, also returned, parts its words alike."""
    low = pc.utf8_lower(texts)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    lead = data >= 0xC0
    # Two-byte letters from U+00C0 to U+024F, but for the signs of multiplication and division.
    signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if ((data >= 0xC3) & (data <= 0xC8))[lead].all() and not signs.any():
        return low, NO_LETTER_OR_DIGIT if digits else NO_LETTER
    return pc.replace_substring_regex(low, r"[^\pL\pN]+" if digits else r"[^\pL]+", " "), _SPACE


def word_spans(texts, powers: Powers, apart: np.ndarray = _SPACE):
    """Words of an Arrow string array (nulls: none), parted by the bytes in ``apart`` (ASCII white space).

    Returns (data, start, end, row, sums): the bytes, each word's byte span, its row, and sums for ``span_hash``.
    """
    kind = np.int32 if texts.type == "string" else np.int64
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none, np.zeros(1, np.uint64)
    base = offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : offsets[-1]]
    offsets = offsets - base
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.to(len(data))[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return data, start, end, row, sums


def span_hash(sums: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of spans; equal bytes have equal hashes, wherever they stand."""
    return mix64((sums[end] - sums[start]) * powers.to(len(sums))[1][start])


def word_table(texts, powers: Powers):
    """(data, start, end, row, hash): the words of ``word_spans`` with a 64-bit hash of each one's bytes."""
    data, start, end, row, sums = word_spans(texts, powers)
    return data, start, end, row, span_hash(sums, powers, start, end)


def prefix_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Where the first ``k`` characters of each word end; -1 for words of no more than ``k``."""
    first = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    at = np.searchsorted(first, start) + k
    to = np.append(first, len(data))[np.minimum(at, len(first))]
    return np.where((at < len(first)) & (to < end), to, -1)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges one after the other, and for each the number of its range."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(size) - size), size), of


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values, by doubling; empty if there are fewer."""
    total, out, done, part, length = len(hashes) - n + 1, None, 0, hashes, 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    while n - done:
        if (n - done) & length:
            piece = part[done : done + total]
            out = piece if out is None else out * np.uint64(pow(_STEP, length, 1 << 64)) + piece
            done += length
        if n - done:
            part = part[: len(part) - length] * np.uint64(pow(_STEP, length, 1 << 64)) + part[length:]
            length *= 2
    return mix64(out)


def sliding_argmin(values: np.ndarray, n: int) -> np.ndarray:
    """Index of the least of every ``n`` consecutive values, the leftmost of equal ones."""
    total = len(values) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    best, length = np.arange(len(values)), 1
    while length < n:
        step = min(length, n - length)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        length += step
    return best


# ---------------------------------------------------------------- graphs


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest id reachable over undirected ``edges`` (a, b): rows (id, component) for every id that an edge names.

    Alternating large-star and small-star passes; each pass is written to the shared folder, and only a count of changes
    reaches the driver. Minima are pre-aggregated before the shuffle, and the join of a hub's edges to its one minimum can
    be split, so no task holds the whole neighbourhood of a node.
    """

    def towards(pairs: DataFrame, both: bool) -> DataFrame:
        seen = pairs.union(pairs.select("b", "a")).toDF("a", "b") if both else pairs
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return splittable_join(seen, least, "a")

    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    while True:
        if now.isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        # large star: larger neighbours are linked to the least of all neighbours
        large = towards(now, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, label)
        # small star: smaller neighbours, and the node itself, are linked to the least of them
        near = towards(large, False)
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, label)
        # every node with one parent, and no parent with a parent of its own: stars
        chained = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        single = chained and small.groupBy("a").count().where("count > 1").isEmpty()
        discard(now)
        discard(large)
        now = small
        if single:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
