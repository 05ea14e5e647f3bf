"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Both tokenizers read a text behind one space. Tokens are spans of bytes; tokens of A and B that share a byte are linked, and
the places where a token of each ends cut a text into groups. Groups are found by pointer jumping: every token points to the
token of the other side that covers its last byte, its farthest-right overlapping one, and the token of B that ends with one
of A points to itself; all successors of a slice of documents are doubled at once until they stay, and the token that one
arrives at is the label of its group.

How often two ids are linked is counted in documents over the whole corpus. A task cuts its documents into batches and sums
each batch's id pairs before anything is shuffled; counts go back as one row for each batch and pair, and meet the batch's
documents in a cogroup that is bounded by ``BATCH_BYTES`` (or one document). Best counts are broadcast: one row for each id of
A's vocabulary at most.

Words recur, so a task remembers what single words are encoded to, up to ``REMEMBERED`` of them. A text is cut before a space
that stands alone between two other characters, and only where the vocabularies allow: A must split texts at such spaces before
merging, and no piece of B may have a space after something else. Otherwise texts are encoded whole.

Defined results: a text that is null or empty, or whose tokens of either side don't join to its bytes (a literal U+2581, a
character that a vocabulary lacks), has no tokens: its numbers are 0 and its groups empty. Rows with null or equal ids are
documents of their own. Strings of special tokens are plain text. Extra columns aren't carried.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dijkstone.llm.common import in_small_batches, materialize, ranges, splittable_join

SPACE = "▁"
#: Bytes of text whose pairs are summed together, and that are aligned at once; words that a task remembers.
BATCH_BYTES, SLICE_BYTES, REMEMBERED = 8_000_000, 400_000, 1_000_000
#: Words that are encoded as one text.
_TOGETHER = 500
_ALONE = re.compile(r"(?<=\S) (?=\S)")


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """The files of both tokenizers, as they are broadcast (a few MB)."""

    def __init__(self, a: str, b: bytes):
        self.plain = (a, b)
        sizes = (max(json.loads(a)["model"]["vocab"].values()) + 1, _pieces(b).get_piece_size())
        self.a_size = max(sizes[0], max((t["id"] + 1 for t in json.loads(a).get("added_tokens") or ()), default=0))
        self.b_size = sizes[1]

    @staticmethod
    def load(a_path: str, b_path: str) -> Vocabularies:
        """Read a byte-level BPE (tokenizers JSON) and a SentencePiece model, on the driver."""
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Vocabularies(a.read(), b.read())


def _pieces(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class _Bytes:
    """The bytes of ids."""

    def __init__(self, each: list[bytes]):
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.at, self.blob = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(each), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        at, _ = ranges(self.at[ids], self.at[ids] + self.size[ids])
        return self.blob[at].tobytes()


class _Grown:
    """An array to which values are added."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]

    def add(self, values: np.ndarray):
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros(self.n + len(values), self.held.dtype)))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Pair:
    """Both tokenizers with a memory of words. Words are numbered; the ids of all lie one after the other."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.a, self.b, known = Tokenizer.from_str(a), _pieces(b), _byte_level()
        self.a.encode_special_tokens = True
        spec = json.loads(a)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for s, i in names.items():
            self.a_bytes[i] = bytes(known[c] for c in s) if all(c in known for c in s) else s.encode()
        n = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in n]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [_Bytes(x) for x in (self.a_bytes, self.b_bytes)]
        self.a_len, self.b_len = (x.size for x in self.bytes)
        # What follows an id in the text of groups: the next of its side, the other side, the next group.
        self.a_said = np.array([f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|;"], object)
        self.b_said = np.array([f"{i}{end}" for i in n for end in ",|;"], object)
        split = spec.get("pre_tokenizer") or {}
        alike = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.cuts = alike and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._forget()

    def _forget(self):
        self.known, self.sound = {}, _Grown(bool)
        self.flat, self.ends = (_Grown(np.int32), _Grown(np.int32)), (_Grown(np.int64), _Grown(np.int64))
        for e in self.ends:
            e.add(np.zeros(1, np.int64))

    def words(self, text: str) -> list[str]:
        """A text as parts of which each stands behind one space."""
        if not self.cuts:
            return [text]
        words = text.split()
        return words if " ".join(words) == text else _ALONE.split(text)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words; new ones are encoded. Only the numbers of the last call hold."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(dict.fromkeys(filterfalse(self.known.__contains__, words)))
        # Words that begin or end with a space of some kind stand at the ends of texts; all others may follow each other.
        single = [w for w in new if not self.cuts or not w or w[0].isspace() or w[-1].isspace()]
        joined = [w for w in new if self.cuts and w and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(joined), _TOGETHER):
            if not self._learn(joined[at : at + _TOGETHER]):
                single += joined[at : at + _TOGETHER]
        for w in single:
            if not self._learn([w]):
                self._keep([w], [False], [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _learn(self, words: list[str]) -> bool:
        """Encode words, one behind the other as in a text; no, if the tokens of a side don't join to their bytes, word by word."""
        text = " ".join(words)
        data = (" " + text).encode()
        edges = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        ids = [np.array(x, np.int32) for x in (self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text))]
        cuts = []
        for table, side in zip(self.bytes, ids):
            ends = np.cumsum(table.size[side])
            cut = np.searchsorted(ends, edges)
            if table.join(side) != data or not np.array_equal(ends[np.minimum(cut, len(ends) - 1)], edges):
                return False
            cuts.append(cut + 1)
        self._keep(words, [True] * len(words), ids, cuts)
        return True

    def _keep(self, words, sound, ids, cuts):
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.sound.add(np.array(sound))
        for flat, ends, side, cut in zip(self.flat, self.ends, ids, cuts):
            ends.add(cut + flat.n)
            flat.add(side)

    def tokens(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and for each the place of its word."""
        flat, ends = self.flat[side].values, self.ends[side].values
        at, of = ranges(ends[numbers], ends[numbers + 1])
        return flat[at].astype(np.int64), of


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the token of B that ends its group. The ends of both reach equally far."""
    over_a = np.searchsorted(b_ends, a_ends)  # the token of B that covers the last byte
    over_b = np.searchsorted(a_ends, b_ends)
    n, own = len(a_ends), np.arange(len(b_ends)) + len(a_ends)
    successor = np.concatenate((over_a + n, np.where(a_ends[over_b] > b_ends, over_b, own) if len(own) else own))
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor[:n] - n, successor[n:] - n
        successor = doubled


def _aligned(pair: Pair, texts: list):
    """Of a slice of texts: n_a, n_b, n_groups and n_links of each, the digests of groups, the sorted distinct links as
    (text, pair code) in one number, how often each is there, and the number of codes."""
    n, codes = len(texts), len(pair.a_bytes) * len(pair.b_bytes)
    parts = [pair.words(t) if t and SPACE not in t else [] for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    numbers = pair.numbers(list(chain.from_iterable(parts)))
    doc = np.repeat(np.arange(n), sizes)
    good = np.ones(n, bool)
    good[doc[~pair.sound.values[numbers]]] = False
    numbers, doc = numbers[good[doc]], doc[good[doc]]
    (a, of_a), (b, of_b) = pair.tokens(numbers, 0), pair.tokens(numbers, 1)
    doc_a, doc_b = doc[of_a], doc[of_b]
    ends_a, ends_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    label_a, label_b = jump(ends_a, ends_b)

    first = np.searchsorted(ends_b, ends_a - pair.a_len[a], side="right")
    linked, of = ranges(first, np.searchsorted(ends_b, ends_a) + 1)
    count = lambda x: np.bincount(x, minlength=n)
    last = label_b == np.arange(len(b))
    links, times = np.unique(doc_a[of] * codes + a[of] * len(pair.b_bytes) + b[linked], return_counts=True)

    # The groups as text: the tokens of both sides by group, those of A first.
    end_a = np.append(label_a[1:] != label_a[:-1], True) if len(a) else np.zeros(0, bool)
    said = np.concatenate((pair.a_said[a * 3 + end_a], pair.b_said[b * 3 + 2 * last]))
    order = np.argsort(np.concatenate((2 * label_a, 2 * label_b + 1)), kind="stable")
    said = said[order].tolist()
    edges = np.concatenate(([0], np.cumsum(count(doc_a) + count(doc_b)))).tolist()
    digests = [hashlib.sha256("".join(said[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:])]
    return (count(doc_a), count(doc_b), count(doc_b[last]), count(doc_a[of])), digests, links, times, codes


def _slices(texts: pa.Array):
    """(from, to, texts, bytes) of about SLICE_BYTES."""
    values = texts.to_pylist()
    at = held = 0
    for i, t in enumerate(values):
        held += len(t or "")
        if held >= SLICE_BYTES or i + 1 == len(values):
            yield at, i + 1, values[at : i + 1], held
            at, held = i + 1, 0


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encoded(handed, kind: str):
    """(batch, row, id, numbers, groups_sha256, pairs, times) of documents; a row without a number has the pairs of a batch and the documents of each."""
    lists = pa.list_(pa.int32() if kind == "int" else pa.int64())

    def batch_of(batch, rows, ids, numbers, digests, ends, pairs, times):
        values = pa.array(pairs).cast(lists.value_type), pa.array(times.astype(np.int32))
        made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), v) for v in values]
        return pa.RecordBatch.from_arrays([pa.array([batch] * len(ids), pa.int64()), rows, ids, *map(pa.array, numbers), digests, *made], names=["batch", "row", "id", *_NUMBERS, "groups_sha256", "pairs", "times"])

    def summary(batch, held, id_type):
        pairs, docs = np.unique(np.concatenate(held), return_counts=True)
        none = [np.zeros(1, np.int64)] * len(_NUMBERS)
        return batch_of(batch, pa.nulls(1, pa.int64()), pa.nulls(1, id_type), none, pa.array([""]), np.array([0, len(pairs)]), pairs, docs)

    def run(batches):
        value = handed.value  # stays in the worker for the tasks to come
        pair = value.get("pair") or value.setdefault("pair", Pair(*value["files"]))
        batch, row, size, held, id_type = TaskContext.get().partitionId() << 33, 0, 0, [], None
        for rows in batches:
            ids = rows.column(0)
            id_type = ids.type
            for at, to, texts, n_bytes in _slices(rows.column(1)):
                numbers, digests, links, times, codes = _aligned(pair, texts)
                ends = np.searchsorted(links, np.arange(to - at + 1) * codes)
                yield batch_of(batch, pa.array(np.arange(row, row + to - at)), ids[at:to], numbers, pa.array(digests), ends, links % codes, times)
                held.append(links % codes)
                row, size = row + to - at, size + n_bytes
                if size >= BATCH_BYTES:
                    yield summary(batch, held, id_type)
                    batch, row, size, held = batch + 1, 0, 0, []
        if held:
            yield summary(batch, held, id_type)

    return run


def _valued(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a batch with n_best and count_sum, from the counts of all its pairs."""
    code, n, best = (counts.column(c).to_numpy() for c in ("pair", "n", "is_best"))
    order = np.argsort(code)
    code, n, best = code[order], n[order], best[order]
    lists = docs.column("pairs").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    at = np.searchsorted(code, lists.flatten().to_numpy())
    times = docs.column("times").combine_chunks()
    times = (times.combine_chunks() if isinstance(times, pa.ChunkedArray) else times).flatten().to_numpy().astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
    zero = np.zeros(0, np.int64)
    some = len(at) > 0
    return docs.drop_columns(["batch", "row", "pairs", "times"]).append_column("n_best", pa.array(total(times * best[at] if some else zero))).append_column("count_sum", pa.array(total(times * n[at] if some else zero)))


def align(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(the id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row for each document."""
    spark, codes = docs.sparkSession, vocabularies.a_size * vocabularies.b_size
    kind, id_type = "int" if codes < 1 << 31 else "long", docs.schema[id_col].dataType.simpleString()
    handed = spark.sparkContext.broadcast({"files": vocabularies.plain})
    result = f"id {id_type}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string"
    given = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = materialize(given.mapInArrow(_encoded(handed, kind), f"batch long, row long, {result}, pairs array<{kind}>, times array<int>"), "aligned")

    summed = coded.where("row is null").select("batch", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("batch", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = materialize(summed.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {vocabularies.b_size}")), "pairs")
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best")))  # no more rows than A has ids
    judged = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    wanted = splittable_join(summed.select("batch", "pair"), judged, "pair").select(F.col("batch").alias("of"), "pair", "n", "is_best")
    met = coded.where("row is not null").groupBy("batch").cogroup(wanted.groupBy("of"))
    return met.applyInArrow(_valued, f"{result}, n_best long, count_sum long").withColumnRenamed("id", id_col)


def _grouped(handed):
    def run(batches):
        value = handed.value
        pair = value.get("pair") or value.setdefault("pair", Pair(*value["files"]))
        for rows in batches:
            for at, to, texts, _ in _slices(rows.column(1)):
                out = []
                for t in texts:
                    numbers = pair.numbers(pair.words(t) if t and SPACE not in t else [])
                    sound = bool(pair.sound.values[numbers].all())
                    (a, _), (b, _) = (pair.tokens(numbers if sound else numbers[:0], side) for side in (0, 1))
                    label_a, label_b = jump(np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b]))
                    ends = np.flatnonzero(label_b == np.arange(len(b)))
                    cut_a, cut_b = np.searchsorted(label_a, ends, side="right"), ends + 1
                    out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(a, cut_a)[: len(ends)], np.split(b, cut_b)[: len(ends)])])
                yield pa.RecordBatch.from_arrays([rows.column(0)[at:to], pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], names=["id", "groups"])

    return run


def groups(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(the id, groups): the ids of both sides for each group of a document, in its order."""
    handed = docs.sparkSession.sparkContext.broadcast({"files": vocabularies.plain})
    given = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(_grouped(handed), f"id {kind}, groups array<struct<a:array<int>,b:array<int>>>").withColumnRenamed("id", id_col)
