"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every run of ``window - seed + 1`` consecutive ``seed``-word grams, the one with the least
hash. Equal windows choose the same anchor at the same place, so a window can only repeat where its anchor does. The span of
an anchor is what it extends to both ways: all words of the windows that chose it.

1. Documents meet on anchors: each occurrence is joined to the one row of its anchor (first and last document, least and
   greatest span; pre-aggregated, so a common passage is no hot key). Anchors of one document are done.
2. Where all occurrences of an anchor have one span, the match extends over the whole of it, and every document but the
   least loses it. Otherwise occurrences of equal spans are settled among themselves in the same way.
3. What is left, the least document of each of an anchor's different spans, is extended window by window: per window the
   least document keeps it.
4. Repeats within a text are found in the text. Adjacent and overlapping repeated windows join into maximal repeats, and
   their words go.

No pair of documents is ever formed, and nothing is capped. Spans and windows are named by 128 bits, the anchor's hash and
their own.

Defined results: a null text has no words and keeps a null text; a text of fewer words than ``window`` loses none. Ids are
whole numbers; a row with a null id takes the 64-bit hash of its text as its id. Rows that share an id don't repeat one
another, only what smaller ids hold and what their own text holds earlier. Extra columns pass through; one that has the name
of a result column is replaced by the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.llm.common import Powers, byte_slices, in_small_batches, materialize, mix64, ranges, run_hash, sliding_argmin, splittable_join, word_table

#: Words in a seed. The window less this, plus one, is the number of grams that an anchor is chosen from.
SEED_WORDS = 5

RESULTS = ("n_words", "n_removed", "kept_text", "repeats")


class _Anchors:
    """Anchors of several texts: the row, seed and span of each, and the windows [first, last] that chose it."""

    def __init__(self, texts, window: int, seed: int, powers: Powers):
        self.data, self.start, self.end, self.words_row, hashes = word_table(texts, powers)
        self.window = run_hash(hashes, window)
        grams = run_hash(hashes, seed)
        chosen = sliding_argmin(grams, window - seed + 1)
        row = self.words_row
        whole = np.flatnonzero(row[: len(chosen)] == row[window - 1 :]) if len(chosen) else np.zeros(0, np.int64)
        lead = np.flatnonzero(np.append(True, chosen[whole][1:] != chosen[whole][:-1])) if len(whole) else whole
        # A gram of one text is chosen by consecutive windows of that text only.
        self.first, self.last = whole[lead], whole[np.append(lead[1:], len(whole)) - 1] if len(whole) else whole
        at = chosen[self.first]
        self.row, self.seed = row[self.first], grams[at]
        place = mix64(((at - self.first) * (window + 1) + self.last - self.first).astype(np.uint64))
        self.span = mix64(self.window[self.first] ^ place) + self.window[self.last]

    def windows(self, which: np.ndarray):
        """(window start, number of its anchor) of the windows of some anchors."""
        starts, of = ranges(self.first[which], self.last[which] + 1)
        return starts, np.flatnonzero(which)[of] if which.dtype == bool else which[of]


def _first_of(*keys) -> np.ndarray:
    """For each row of the keys the index of the first equal row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
    return lead


def _in_lists(value: np.ndarray, row: np.ndarray, lists) -> np.ndarray:
    """Whether each value is in the list of its row (a list column of longs)."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.isin(value ^ mix64(row.astype(np.uint64)), flat ^ mix64(np.repeat(np.arange(len(counts)), counts).astype(np.uint64)))


def _signed(x: np.ndarray):
    return pa.array(x.view(np.int64))


def _seed_rows(window: int, seed: int):
    """(doc, text) to (seed, span, doc), each span of a text once."""

    def rows(batches):
        powers = Powers()
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                x = _Anchors(batch.column(1)[a:b], window, seed, powers)
                once = np.flatnonzero(_first_of(x.row, x.seed, x.span) == np.arange(len(x.row)))
                if len(once):
                    docs = batch.column(0)[a:b].take(pa.array(x.row[once]))
                    yield pa.RecordBatch.from_arrays([_signed(x.seed[once]), _signed(x.span[once]), docs], names=["seed", "span", "doc"])

    return rows


def _window_rows(window: int, seed: int, text_name: str):
    """Texts with the spans to extend (__open) to (seed, window, doc), each window of a text once."""

    def rows(batches):
        powers = Powers()
        for batch in batches:
            doc, text, spans = (batch.column(n) for n in ("__doc", text_name, "__open"))
            for a, b in byte_slices(text):
                if not spans[a:b].flatten():
                    continue
                x = _Anchors(text[a:b], window, seed, powers)
                starts, of = x.windows(_in_lists(x.span, x.row, spans[a:b]))
                once = np.flatnonzero(_first_of(x.row[of], x.window[starts]) == np.arange(len(starts)))
                if len(once):
                    docs = doc[a:b].take(pa.array(x.row[of[once]]))
                    yield pa.RecordBatch.from_arrays([_signed(x.seed[of[once]]), _signed(x.window[starts[once]]), docs], names=["seed", "window", "doc"])

    return rows


def _result_rows(window: int, seed: int, text_name: str, names: list[str]):
    """Input: the columns ``names``, then __gone (spans), __open (spans) and __marked (windows of those that go)."""

    def gone_starts(x, gone, open_, marked):
        whole = _in_lists(x.span, x.row, gone)
        twice = np.bincount(_first_of(x.row, x.seed), minlength=len(x.row))[_first_of(x.row, x.seed)] > 1
        part = (_in_lists(x.span, x.row, open_) | twice) & ~whole
        starts, of = x.windows(part)
        again = _first_of(x.row[of], x.window[starts])
        later = _in_lists(x.window[starts], x.row[of], marked) | (again != np.arange(len(starts)))
        return np.concatenate([x.windows(whole)[0], starts[later]])

    def rows(batches):
        powers = Powers()
        for batch in batches:
            text, gone, open_, marked = (batch.column(n) for n in (text_name, "__gone", "__open", "__marked"))
            for a, b in byte_slices(text):
                x = _Anchors(text[a:b], window, seed, powers)
                row, start, end = x.words_row, x.start, x.end
                cover = np.zeros(len(row) + 1, np.int64)
                starts = gone_starts(x, gone[a:b], open_[a:b], marked[a:b])
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                out = np.cumsum(cover[:-1]) > 0
                n = np.bincount(row, minlength=b - a)
                edge = np.ones(len(row) + 1, bool)
                edge[1:-1] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
                edges = np.flatnonzero(edge)
                removed = np.bincount(row[out], minlength=b - a)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                kept, spans = [], []
                raw = x.data.tobytes()
                for i in range(b - a):
                    lo, hi = bounds[i], bounds[i + 1]
                    if removed[i] == 0:
                        kept.append(b" ".join(raw[start[lo] : end[hi - 1]].split()) if hi > lo else (None if not text[a + i].is_valid else b""))
                        spans.append(None)
                        continue
                    mine = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi) + 1].tolist()
                    runs = list(zip(mine[:-1], mine[1:]))
                    kept.append(b" ".join(w for s, t in runs if not out[s] for w in raw[start[s] : end[t - 1]].split()))
                    spans.append([{"at": int(s - lo), "words": int(t - s)} for s, t in runs if out[s]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[a:b] for c in names]
                    + [
                        pa.array(n.astype(np.int64)),
                        pa.array(removed.astype(np.int64)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32())]))),
                    ],
                    names=[*names, *RESULTS],
                )

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = SEED_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by one space) and repeats (maximal removed runs)."""
    docs = in_small_batches(docs).drop(*(c for c in RESULTS if c not in (id_col, text_col)))
    names = docs.columns
    keyed = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)))

    seeds = keyed.select("__doc", text_col).mapInArrow(_seed_rows(window, seed), "seed long, span long, doc long")
    anchors = seeds.groupBy("seed").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("span").alias("one"), F.max("span").alias("other"))
    anchors = anchors.where("least < most").select("seed", "least", (F.col("one") != F.col("other")).alias("mixed"))
    met = materialize(splittable_join(seeds, anchors, "seed"), "anchors")
    alike, mixed = met.where("not mixed and doc > least").select("doc", "span"), met.where("mixed").select("seed", "span", "doc")
    classes = mixed.groupBy("seed", "span").agg(F.min("doc").alias("least"))
    settled = splittable_join(mixed, classes, "seed", "span").select("doc", "span", (F.col("doc") == F.col("least")).alias("open"))
    told = alike.withColumn("open", F.lit(False)).union(settled).groupBy(F.col("doc").alias("__doc"))
    told = told.agg(F.collect_set(F.when(~F.col("open"), F.col("span"))).alias("__gone"), F.collect_set(F.when(F.col("open"), F.col("span"))).alias("__open"))
    # Both steps below read these texts, so that they share one shuffle of them.
    placed = keyed.join(told, "__doc", "left").select(*keyed.columns, "__gone", "__open")

    windows = placed.mapInArrow(_window_rows(window, seed, text_col), "seed long, window long, doc long")
    least = windows.groupBy("seed", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    later = splittable_join(windows, least, "seed", "window").where("doc > least")
    marked = later.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("window").alias("__marked"))

    schema = T.StructType(
        [docs.schema[c] for c in names]
        + list(T._parse_datatype_string("n_words long, n_removed long, kept_text string, repeats array<struct<at:int,words:int>>"))
    )
    return (
        placed.join(marked, "__doc", "left")
        .select(*names, "__gone", "__open", "__marked")
        .mapInArrow(_result_rows(window, seed, text_col, names), schema)
    )
