"""Language ID, word first with backoff.

Each known word adds its per-language log frequency. A word no language knows is cut greedily from the left into the
longest known character n-grams, falling back to shorter ones; a character never seen adds the floor; the word adds the
mean of its parts. The language of the largest sum wins (equal sums: the first by name); the score is its softmax share of
the mean log frequency per word.

The tables are counted by Spark over a bounded sample of the labelled texts: at most ``max_texts``, those of the least
hashes of their ids. All their words and n-grams count; they are named by 64-bit hashes, and what is collected and broadcast
are their counts. Whole texts are scored, in slices.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all are. Ids
are whole numbers; a row with a null id is predicted and never learned from. Repeated rows get equal results and are learned
from each. Extra columns pass through; one that has the name of a result column is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.llm.common import Powers, byte_slices, in_small_batches, mix64, plain_words, span_hash, word_spans

MAX_TEXTS = 20_000
LONGEST_GRAM = 4
UNKNOWN = "und"
RESULTS = ("lang_pred", "score")
_FLOOR = math.log(1e-6)


def _named(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Names of words (kind 0) and of n-grams (their length) by their bytes' hashes."""
    return mix64(hashes + np.uint64(kind))


def _characters(data: np.ndarray) -> np.ndarray:
    """Where characters begin, and the end of the last."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _count_rows(longest: int):
    """(lang, text) to (lang, gram, kind, n) of a slice of texts; kind 0: word, else the length of an n-gram."""

    def rows(batches):
        powers = Powers()
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                langs = batch.column(0)[a:b].dictionary_encode()
                code, names = langs.indices.to_numpy(), langs.dictionary
                plain, apart = plain_words(batch.column(1)[a:b], digits=False)
                data, start, end, row, sums = word_spans(plain, powers, apart)
                if not len(start):
                    continue
                # Distinct words by language with their counts, then all n-grams of these.
                cell, seen, n = np.unique(span_hash(sums, powers, start, end) * np.uint64(2 * len(names) + 1) + code[row].astype(np.uint64), return_index=True, return_counts=True)
                lang, start, end, at = code[row[seen]], start[seen], end[seen], _characters(data)
                first, last = np.searchsorted(at, start), np.searchsorted(at, end)
                out = [(lang, _named(span_hash(sums, powers, start, end), 0), np.zeros(len(lang), np.int64), n)]
                for k in range(1, longest + 1):
                    size = np.maximum(last - first - k + 1, 0)
                    of = np.repeat(np.arange(len(size)), size)
                    begin = np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)
                    grams, back = np.unique(_named(span_hash(sums, powers, at[begin], at[begin + k]), k) * np.uint64(2 * len(names) + 1) + lang[of].astype(np.uint64), return_inverse=True)
                    one = np.zeros(len(grams), np.int64)
                    one[back] = np.arange(len(of))
                    total = np.bincount(back, n[of], minlength=len(grams)).astype(np.int64)
                    out.append((lang[of[one]], _named(span_hash(sums, powers, at[begin[one]], at[begin[one] + k]), k), np.full(len(grams), k), total))
                lang, gram, kind, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(gram.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], names=["lang", "gram", "kind", "n"])

    return rows


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> dict:
    """Learn from the rows of ``docs`` whose id and language are not null. Returns a dict of arrays: langs, the sorted names
    of words and n-grams, and their log frequencies by language."""
    labelled = in_small_batches(docs).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    drawn = labelled.select(lang_col, F.xxhash64(F.col(id_col).cast("long"), F.lit(10)).alias("__h"), id_col)
    last = drawn.orderBy("__h", id_col).limit(max_texts).agg(F.max("__h")).first()[0]
    if last is None:
        return {"langs": [], "grams": np.zeros(0, np.uint64), "table": np.zeros((0, 0))}
    sample = labelled.where(F.xxhash64(F.col(id_col).cast("long"), F.lit(10)) <= last)
    counted = sample.select(F.col(lang_col).cast("string"), text_col).mapInArrow(_count_rows(LONGEST_GRAM), "lang string, gram long, kind int, n long")
    counted = counted.groupBy("lang", "gram", "kind").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    langs = sorted(set(counted.column("lang").unique().to_pylist()))
    code = pc.index_in(counted.column("lang"), pa.array(langs)).to_numpy()
    kind, n = counted.column("kind").to_numpy(), counted.column("n").to_numpy()
    grams, at = np.unique(counted.column("gram").to_numpy().view(np.uint64), return_inverse=True)
    totals = np.zeros((LONGEST_GRAM + 1, len(langs)))
    np.add.at(totals, (kind, code), n)
    kinds, table = np.zeros(len(grams), np.int64), np.zeros((len(grams), len(langs)))
    kinds[at] = kind
    table[at, code] = n
    return {"langs": langs, "grams": grams, "table": np.log((table + 0.1) / (totals[kinds] + 1))}


class _Reader:
    """Log frequencies of words by a model's arrays."""

    def __init__(self, model: dict):
        self.grams, self.table, self.powers = model["grams"], model["table"], Powers()

    def _find(self, names):
        """Rows of the table of some names, -1 for unknown ones."""
        at = np.minimum(np.searchsorted(self.grams, names), len(self.grams) - 1)
        return np.where(self.grams[at] == names, at, -1)

    def sums(self, texts, rows: int):
        """By text the summed log frequencies of its words, and their number."""
        plain, apart = plain_words(texts, digits=False)
        data, start, end, row, sums = word_spans(plain, self.powers, apart)
        hashes, seen, word = np.unique(span_hash(sums, self.powers, start, end), return_index=True, return_inverse=True)
        found = self._find(_named(hashes, 0))
        weights = self.table[found]
        unknown = np.flatnonzero(found < 0)
        weights[unknown] = self._backed_off(data, start[seen[unknown]], end[seen[unknown]], sums)
        total = np.stack([np.bincount(row, w, minlength=rows) for w in weights[word].T], axis=1) if len(word) else np.zeros((rows, self.table.shape[1]))
        return total, np.bincount(row, minlength=rows)

    def _backed_off(self, data, start, end, sums):
        """Mean log frequencies of the longest known n-grams that words are cut into from the left, all words step by step."""
        at = _characters(data)
        now, last = np.searchsorted(at, start), np.searchsorted(at, end)
        total, parts = np.zeros((len(now), self.table.shape[1])), np.zeros(len(now), np.int64)
        open_ = np.flatnonzero(now < last)
        while len(open_):
            here, step, row = now[open_], np.ones(len(open_), np.int64), np.full(len(open_), -1)
            for k in range(LONGEST_GRAM, 0, -1):
                left = np.flatnonzero((row < 0) & (here + k <= last[open_]))
                got = self._find(_named(span_hash(sums, self.powers, at[here[left]], at[here[left] + k]), k))
                hit = left[got >= 0]
                row[hit], step[hit] = got[got >= 0], k
            total[open_] += np.where((row >= 0)[:, None], self.table[row], _FLOOR)
            parts[open_] += 1
            now[open_] += step
            open_ = open_[now[open_] < last[open_]]
        return total / np.maximum(parts, 1)[:, None]


def _predict_rows(handed, text_name: str, names: list[str]):
    def rows(batches):
        model = handed.value
        langs, reader = pa.array([*model["langs"], UNKNOWN], pa.string()), _Reader(model)
        for batch in batches:
            for a, b in byte_slices(batch.column(text_name)):
                best, share = np.full(b - a, len(langs) - 1), np.zeros(b - a)
                if len(langs) > 1:
                    total, n = reader.sums(batch.column(text_name)[a:b], b - a)
                    some = np.flatnonzero(n)
                    best[some] = total[some].argmax(axis=1)
                    share[some] = 1 / np.exp((total[some] - total[some].max(axis=1)[:, None]) / n[some, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(c)[a:b] for c in names] + [langs.take(pa.array(best)), pa.array(share)], names=[*names, *RESULTS])

    return rows


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = in_small_batches(docs).drop(*(c for c in RESULTS if c != text_col))
    schema = T.StructType([*docs.schema, *T._parse_datatype_string("lang_pred string, score double")])
    return docs.mapInArrow(_predict_rows(docs.sparkSession.sparkContext.broadcast(model), text_col, docs.columns), schema)
