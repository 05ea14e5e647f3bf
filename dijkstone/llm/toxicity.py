"""Toxicity by nearest labelled examples.

Texts become TF-IDF vectors over all words, and beginnings of words (so unseen endings of a known stem count), that the
examples hold. A term's weight is (1 + log tf) times IDF, counted over all documents, times how far the examples tell it
apart: ``GENERAL`` plus its log likelihood ratio for the toxic label in units of what the best of so many terms would
reach by chance. No term is left out. A score is a vote of the ``k`` nearest labelled examples by exact cosine, each
weighted by its similarity, smoothed by the share of toxic examples; the ids of the voters are the evidence.

Neighbours come from a block-max inverted index: examples lie in blocks, and for each term and block the largest weight is
kept. The few most frequent terms, which nearly all examples hold, are summed for all at once; with that, the other terms
give every block an upper bound, and only blocks whose bound reaches the k-th similarity found so far are completed. That is
exact.

The classifier is fitted on a bounded sample of the labelled rows: at most ``max_examples``, those of the least hashes of
their ids. What is collected and broadcast are the terms of these examples. Terms are named by 64-bit hashes.

Defined results: null and empty texts, and others without a term that an example holds, get no evidence and the share of
toxic examples, half of ``THRESHOLD`` at most, so that they are never predicted toxic. Ids are whole numbers. A row with a null id is scored and never learned from. Repeated rows get equal scores; repeated labels of an
id count once, the greatest. If nothing is labelled the score is half of ``THRESHOLD``. Extra columns pass through; one
that has the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.llm.common import Powers, byte_slices, in_small_batches, plain_words, prefix_ends, ranges, span_hash, word_spans

MAX_EXAMPLES = 2_000
NEIGHBOURS = 15
THRESHOLD = 0.3
#: Weight of a term that tells nothing apart, and summed similarity that the prior counts as in a vote.
GENERAL, SMOOTHING = 0.1, 0.5
BLOCK, DENSE_TERMS = 64, 384
#: Terms of texts that are searched together.
_TOGETHER = 6_000

RESULTS = ("score", "predicted", "evidence")
_STEMS = (4, 5)


def _words_of(texts, powers: Powers):
    """(row, word, count) by row, and the terms of each word: (word, term). Words are runs of letters and digits in lower
    case; a beginning of a word is a term of its own."""
    plain, apart = plain_words(texts, digits=True)
    data, start, end, row, sums = word_spans(plain, powers, apart)
    hashes, seen, word = np.unique(span_hash(sums, powers, start, end), return_index=True, return_inverse=True)
    words, terms = [np.arange(len(hashes))], [hashes]
    for k in _STEMS:
        to = prefix_ends(data, start[seen], end[seen], k)
        longer = np.flatnonzero(to >= 0)
        words.append(longer)
        terms.append(span_hash(sums, powers, start[seen[longer]], to[longer]) ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF))
    cell, n = np.unique(row * len(hashes) + word, return_counts=True)
    return cell // max(len(hashes), 1), cell % max(len(hashes), 1), n, np.concatenate(words), np.concatenate(terms)


def _by_row(row, word, n, words, numbers, size: int):
    """(row, number, count) by row and number, where ``words`` have ``numbers`` below ``size``."""
    order = np.argsort(words, kind="stable")
    first = np.searchsorted(words[order], np.arange(word.max(initial=-1) + 2))
    at, of = ranges(first[word], first[word + 1])
    cell, back = np.unique(row[of] * size + numbers[order][at], return_inverse=True)
    return cell // max(size, 1), cell % max(size, 1), np.bincount(back, n[of], minlength=len(cell))


def terms_of(texts, powers: Powers):
    """(row, term, count) of the texts of an Arrow string array, by row and term."""
    row, word, n, words, terms = _words_of(texts, powers)
    all_, number = np.unique(terms, return_inverse=True)
    row, number, n = _by_row(row, word, n, words, number, len(all_))
    return row, all_[number], n


def known_terms(texts, vocabulary: np.ndarray, powers: Powers):
    """(row, number of the term in the sorted ``vocabulary``, count), of the terms that are in it, by row and term."""
    row, word, n, words, terms = _words_of(texts, powers)
    at = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
    held = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else np.zeros(0, np.int64)
    return _by_row(row, word, n, words[held], at[held], len(vocabulary))


def unit_vectors(row, term, n, weight: np.ndarray, rows: int):
    """TF-IDF weights of the terms of several texts, at unit length."""
    w = (1 + np.log(n)) * weight[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=rows))
    return w / norm[row]


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks. The most frequent terms are rows of a dense table; for every other term
    and block the largest weight is kept, and the examples that hold the term. Plain arrays, so that a broadcast of
    ``state()`` needs no class on the executors."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    @staticmethod
    def build(row, term, weight, rows: int, terms: int, block: int = BLOCK, dense: int = DENSE_TERMS) -> BlockMaxIndex:
        # Examples with like strongest terms share blocks, which makes the bounds tight.
        best = np.full(rows, -1, np.int64)
        by_weight = np.lexsort((term, weight))
        best[row[by_weight]] = term[by_weight]
        ids = np.lexsort((np.arange(rows), best))
        place_of = np.empty(rows, np.int64)
        place_of[ids] = np.arange(rows)
        frequent = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:dense]
        dense_of = np.full(terms, -1, np.int64)
        dense_of[frequent] = np.arange(len(frequent))
        blocks = -(-rows // block)
        table, common = np.zeros((len(frequent), blocks * block)), dense_of[term] >= 0
        table[dense_of[term[common]], place_of[row[common]]] = weight[common]
        term, place, weight = term[~common], place_of[row[~common]], weight[~common]
        order = np.lexsort((place, term))
        term, place, weight = term[order], place[order], weight[order]
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (place[1:] // block != place[:-1] // block))) if len(term) else order
        return BlockMaxIndex(
            {
                "ids": ids, "block": block, "n_blocks": blocks, "dense_of": dense_of, "table": table,
                "place": place.astype(np.int32), "weight": weight,
                "entry": np.searchsorted(term[starts], np.arange(terms + 1)),  # of each term: its blocks
                "entry_block": (place[starts] // block).astype(np.int32),
                "entry_max": np.maximum.reduceat(weight, starts) if len(starts) else weight,
                "posting": np.append(starts, len(term)),  # of each entry: its examples
            }
        )

    def state(self) -> dict:
        return self.__dict__

    def search(self, row, term, weight, rows: int, k: int):
        """Of each of ``rows`` texts, given as (row, term, weight) by row, the k examples of greatest positive cosine:
        [(similarities, numbers)], greatest first, equal ones by number."""
        width = self.n_blocks * self.block
        if not width:
            return [(np.zeros(0), np.zeros(0, np.int64))] * rows
        common = self.dense_of[term] >= 0
        asked = np.zeros((rows, len(self.table)))
        asked[row[common], self.dense_of[term[common]]] = weight[common]
        scores = asked @ self.table
        row, term, weight = row[~common], term[~common], weight[~common]
        entry, of = ranges(self.entry[term], self.entry[term + 1])
        cell = row[of] * self.n_blocks + self.entry_block[entry]
        bound = np.bincount(cell, weight[of] * self.entry_max[entry], minlength=rows * self.n_blocks) + scores.reshape(-1, self.block).max(axis=1)
        # What the dense part has found already, a block must reach with the best that its other terms may add.
        alive = bound * (1 + 1e-9) >= np.repeat(self._kth(scores, k), self.n_blocks)
        if 2 * alive.sum() > len(alive):  # then it costs less to complete all blocks term by term
            first, last, source = self.posting[self.entry[term]], self.posting[self.entry[term + 1]], np.arange(len(term))
        else:
            seen = np.flatnonzero(alive[cell])
            first, last, source = self.posting[entry[seen]], self.posting[entry[seen] + 1], of[seen]
        at, size = ranges(first, last)[0], last - first
        slot = self.place[at] + np.repeat(row[source] * width, size)
        scores = scores + np.bincount(slot, np.repeat(weight[source], size) * self.weight[at], minlength=rows * width).reshape(rows, width)
        kth, out = self._kth(scores, k), []
        for i in range(rows):
            held = np.flatnonzero((scores[i] > 0) & (scores[i] >= kth[i]))
            numbers, near = self.ids[held], scores[i][held]
            best = np.lexsort((numbers, -near))[:k]
            out.append((near[best], numbers[best]))
        return out

    @staticmethod
    def _kth(scores, k: int):
        width = scores.shape[1]
        return np.partition(scores, width - k, axis=1)[:, width - k] if width > k else np.zeros(len(scores))


def _example_rows(batches):
    """(doc, label, text) to (doc, label, terms, counts)."""
    powers = Powers()
    for batch in batches:
        for a, b in byte_slices(batch.column(2)):
            row, term, n = terms_of(batch.column(2)[a:b], powers)
            ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(term.view(np.int64)), pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *lists], names=["doc", "label", "terms", "counts"])


def _frequency_rows(handed):
    """(term, n): in how many texts of this task's share each term of the vocabulary stands; number -1 counts the texts."""

    def rows(batches):
        vocabulary, powers, texts = handed.value, Powers(), 0
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts += len(batch)
            for a, b in byte_slices(batch.column(0)):
                total += np.bincount(known_terms(batch.column(0)[a:b], vocabulary, powers)[1], minlength=len(vocabulary))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], texts))], names=["term", "n"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> dict:
    """Learn from the rows of ``labels``; frequencies are counted over all of ``docs``. Returns a dict of arrays."""
    spark = in_small_batches(docs).sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc", F.lit(4)), "doc").limit(max_examples)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc").select("doc", "label", "text")
    examples = texts.mapInArrow(_example_rows, "doc long, label int, terms array<long>, counts array<int>").toArrow().sort_by("doc").combine_chunks()
    label = examples.column("label").to_numpy().astype(np.int64)
    if not len(label):
        return {"vocabulary": np.zeros(0, np.uint64), "weight": np.zeros(0), "prior": THRESHOLD / 2, "k": k, "labels": label, "docs": label}
    lists = examples.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy(zero_copy_only=False))
    vocabulary, term = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
    count = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in examples.column("counts").chunks])
    handed = spark.sparkContext.broadcast(vocabulary)
    every = docs.select(text_col).mapInArrow(_frequency_rows(handed), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    handed.destroy()
    frequency, at = np.zeros(len(vocabulary) + 1, np.int64), every.column("term").to_numpy()
    frequency[at] = every.column("n").to_numpy()
    n_docs, frequency = frequency[-1], frequency[:-1]
    idf = np.log((1 + n_docs) / (1 + frequency)) + 0.1
    # Log likelihood ratio of a term's share of toxic examples against the overall one.
    rate = label.mean()
    n, p = (np.bincount(term, x, minlength=len(vocabulary)) for x in (None, label[row]))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(p > 0, p * np.log(p / (n * rate)), 0) + np.where(n > p, (n - p) * np.log((n - p) / (n * (1 - rate))), 0)
    ratio = np.where(p > n * rate, ratio, 0.0)
    weight = idf * (GENERAL + ratio / np.log(max((n > 1).sum(), 3)))
    index = BlockMaxIndex.build(row, term, unit_vectors(row, term, count, weight, len(label)), len(label), len(vocabulary))
    return {"vocabulary": vocabulary, "weight": weight, "prior": float(rate), "k": k, "labels": label, "docs": examples.column("doc").to_numpy(), "index": index.state()}


def _score_rows(handed, text_name: str, names: list[str]):
    def results(model, index, texts, powers):
        """Scores and evidence of some texts."""
        rows, prior = len(texts), model["prior"]
        row, term, n = known_terms(texts, model["vocabulary"], powers)
        scores, evidence = np.full(rows, min(prior, THRESHOLD / 2)), [[] for _ in range(rows)]
        weight = unit_vectors(row, term, n, model["weight"], rows)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        at = 0
        while at < rows:  # a bounded number of terms at once
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _TOGETHER, side="right")) - 1)
            part = slice(bounds[at], bounds[to])
            if bounds[to] > bounds[at]:
                for i, (near, numbers) in enumerate(index.search(row[part] - at, term[part], weight[part], to - at, model["k"])):
                    if not len(near):
                        continue
                    votes = (near * model["labels"][numbers]).sum()
                    scores[at + i] = (votes + SMOOTHING * prior) / (near.sum() + SMOOTHING)
                    evidence[at + i] = model["docs"][numbers].tolist()
            at = to
        return scores, evidence

    def rows(batches):
        model, powers = handed.value, Powers()
        index = BlockMaxIndex(model["index"]) if "index" in model else None
        for batch in batches:
            for a, b in byte_slices(batch.column(text_name)):
                scores, evidence = results(model, index, batch.column(text_name)[a:b], powers)
                scores = np.clip(scores, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[a:b] for c in names] + [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
                    names=[*names, *RESULTS],
                )

    return rows


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted (score >= 0.3) and evidence (ids of the voters, nearest first)."""
    docs = in_small_batches(docs).drop(*(c for c in RESULTS if c != text_col))
    schema = T.StructType([*docs.schema, *T._parse_datatype_string("score double, predicted int, evidence array<bigint>")])
    return docs.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(model), text_col, docs.columns), schema)
