"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text (after one prefixed space) is cut into the pieces of greatest summed score. The search keeps best scores and
backpointers of a window only: a piece has at most ``longest`` characters, so just the last ``longest`` boundaries can
still be left from. Whenever the window is full, the boundary where the backpointer paths from all of those meet is found, and
the pieces up to it are committed and forgotten. Of equal sums the path whose last piece is longest wins. A character without a piece costs the least score
less ``UNKNOWN_COST`` and becomes its UTF-8 bytes.

A boundary that no piece crosses (before a space after something else, around a character that only stands alone) is such
a meeting point for certain. Texts are fed to the search from one such point to the next, and a task remembers the ids of the
stretches that it has fed lately.

Spaces are written as U+2581. A literal U+2581 becomes bytes, so decoding gives back every text exactly.

Defined results: a null text has null ids, n_ids 0 and decodes to null; an empty text has no ids. Repeated rows and null ids
of rows are nothing special. Extra columns pass through; one that has the name of a result column is replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dijkstone.llm.common import in_small_batches

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Stretches that a task remembers, twice, and the most characters of each; ids that are handed on together.
_REMEMBERED, _LONG, _IDS = 100_000, 64, 200_000


class Vocabulary:
    """Pieces with ids and scores; what is broadcast, bounded by the size of the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """pieces: (text, score) by id, a text of "" for one that never stands in a text. byte_ids: the ids of the 256 bytes."""
        self.plain = (pieces, byte_ids)  # what is broadcast: executors need no class for it
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.score = [s for _, s in pieces]
        self.surface = [p.replace(SPACE, " ") for p, _ in pieces]
        self.byte_ids = byte_ids
        self.bytes = {i: b for b, i in enumerate(byte_ids)}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_COST
        self._tree = None
        long = [p for p in self.ids if len(p) > 1]
        multi = set(chain.from_iterable(long))
        alone = "".join(map(re.escape, [c for c in "\n\t\r" if c not in multi] + [SPACE]))
        # Without a piece that has a space after something else, no piece crosses the place before such a space; likewise
        # the place between a letter and a mark that no piece has after a letter.
        if any(SPACE in p.lstrip(SPACE) for p in long):
            self.cut = self.fine = re.compile(f"[{alone}]|[^{alone}]+")
        else:
            met = {m for p in long for before, m in zip(p, p[1:]) if before.isalpha()}
            marks = "".join(map(re.escape, (m for m in ".,;:!?" if m not in met)))
            inner = f"(?:[^ {alone}{marks}]|(?<![^\\W\\d_])[{marks}])" if marks else f"[^ {alone}]"
            self.cut = re.compile(f"[{alone}]| *[^ {alone}]+| +")
            self.fine = re.compile(f"[{alone}]| *{inner}+" + (f"|[{marks}]{inner}*" if marks else "") + "| +")
        # For decoding: the bytes of each id, one after the other.
        parts = [b"" if i not in self.bytes else bytes([self.bytes[i]]) for i in range(len(pieces))]
        parts = [x or s.encode() for x, s in zip(parts, self.surface)]
        self.blob = np.frombuffer(b"".join(parts) + b" ", np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def tree(self) -> dict:
        """Pieces by their characters: each leads to (what follows, the id in a tuple if a piece ends there, its score)."""
        if self._tree is None:
            self._tree = {}
            for p, i in self.ids.items():
                node = self._tree
                for c in p[:-1]:
                    node = node.setdefault(c, [{}, None, 0.0])[0]
                node.setdefault(p[-1], [{}, None, 0.0])[1:] = (i,), self.score[i]
        return self._tree

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read the vocabulary of a SentencePiece model file (on the driver)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        dead = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return Vocabulary([("" if dead(i) else sp.id_to_piece(i), sp.get_score(i)) for i in n], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class StreamingViterbi:
    """Feed characters, take committed ids. ``text``, ``best``, ``back`` hold what lies after the last commit."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.root, self.widest = vocabulary, vocabulary.tree(), 0
        self._reset()

    def _reset(self):
        self.text, self.best, self.back, self.left = "", [0.0], [(0, ())], 0

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        longest = self.v.longest
        for at in range(0, len(text), longest):
            self._take(text[at : at + longest])
            if len(self.text) > 4 * longest:  # what the window holds, so that a commit pays
                self._leave(len(self.text) - longest + 1)  # the longest piece from before there lies within the text
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        self._leave(len(self.text))
        ids = self._path(len(self.text))
        self._reset()
        return ids

    def _take(self, more: str):
        self.text += more
        self.best += [-math.inf] * len(more)
        self.back += [(0, ())] * len(more)

    def _leave(self, end: int):
        """Go from every boundary before ``end`` to all that a piece reaches, walking the tree of pieces."""
        text, best, back, root, known, unknown = self.text, self.best, self.back, self.root, self.v.ids, self.v.unknown
        n = len(text)
        for a in range(self.left, end):
            base, node = best[a], root
            for b in range(a + 1, n + 1):
                hit = node.get(text[b - 1])
                if hit is None:
                    break
                node, ids, score = hit
                if ids is not None and base + score > best[b]:
                    best[b], back[b] = base + score, (a, ids)
                if not node:
                    break
            if base + unknown > best[a + 1] and text[a] not in known:
                best[a + 1], back[a + 1] = base + unknown, (a, None)
        self.left = max(self.left, end)

    def _commit(self) -> list[int]:
        """Ids up to the boundary where all surviving paths meet: those of the boundaries that aren't left yet."""
        self.widest = max(self.widest, len(self.text))
        open_ = {e for e in range(self.left, len(self.text) + 1) if self.best[e] > -math.inf}
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(self.back[last][0])
        meet = open_.pop()
        ids, base = self._path(meet), self.best[meet]
        self.text, self.left = self.text[meet:], self.left - meet
        self.best = [s - base for s in self.best[meet:]]
        self.back = [(max(0, a - meet), i) for a, i in self.back[meet:]]
        return ids

    def _path(self, end: int) -> list[int]:
        out, back = [], self.back
        while end > 0:
            start, ids = back[end]
            out += ids if ids is not None else [self.v.byte_ids[b] for b in reversed(self.text[start:end].encode())]
            end = start
        out.reverse()
        return out


def best_ids(v: Vocabulary, text: str) -> tuple[int, ...]:
    """Ids of a text that is fed at once."""
    stream = StreamingViterbi(v)
    return tuple(stream.feed(text) + stream.finish())


class Encoder:
    """Encodes texts, remembering the ids of short stretches between sure boundaries in two generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.stream, self.young, self.old = vocabulary, StreamingViterbi(vocabulary), {}, {}

    def encode(self, text: str) -> array:
        """The ids of one text."""
        if not text:
            return array("i")
        find = self.young.get
        return array("i", chain.from_iterable([find(s) or self._stretch(s) for s in self.v.cut.findall(" " + text)]))

    def _stretch(self, s: str):
        """Ids of what is cut at spaces, from the parts between the other sure boundaries."""
        ids = self.old.get(s)
        if ids is None:
            parts = self.v.fine.findall(s)
            ids = self._part(s) if len(parts) == 1 else tuple(chain.from_iterable([self.young.get(p) or self._part(p) for p in parts]))
        return self._remember(s, ids)

    def _part(self, s: str):
        ids = self.old.get(s)
        if ids is None:
            if s == SPACE:
                ids = tuple(self.v.byte_ids[b] for b in s.encode())
            else:
                ids = tuple(self.stream.feed(s.replace(" ", SPACE)) + self.stream.finish())
        return self._remember(s, ids)

    def _remember(self, s: str, ids):
        if len(s) <= _LONG:
            if len(self.young) >= _REMEMBERED:
                self.old = dict(self.young)
                self.young.clear()
            self.young[s] = ids
        return ids


def decode(v: Vocabulary, ids) -> str:
    """The text that ``ids`` stand for."""
    out = bytearray()
    surface, as_byte = v.surface, v.bytes
    for i in ids:
        b = as_byte.get(i)
        if b is None:
            out += surface[i].encode()
        else:
            out.append(b)
    return out.decode("utf-8", "replace")[1:]


def decode_flat(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of several id lists, given as one array and the places where each begins and the last ends."""
    size, at = v.size[ids], v.at[ids]
    filled = ends[:-1][ends[1:] > ends[:-1]]
    begins_spaced = size[filled] > 0
    size[filled[begins_spaced]] -= 1  # the prefixed space
    at[filled[begins_spaced]] += 1
    total = np.concatenate(([0], np.cumsum(size)))
    data = v.blob[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
    edges = total[ends]
    starts = edges[:-1][edges[1:] > edges[:-1]]
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        sound = not ((data[starts] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        sound = False
    if not sound:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])], pa.string())
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])


def _encode_rows(handed, text_name: str, names: list[str], check: bool):
    """The columns ``names`` with ids and n_ids, and with ``check`` whether decoding gives the text back."""

    def batch_of(v, batch, at, to, flat, ends, missing):
        flat, ends = np.frombuffer(flat, np.int32), np.array(ends, np.int64)
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(missing))
        more = [ids, pa.array(np.diff(ends))]
        if check:
            same = pc.equal(decode_flat(v, flat.astype(np.int64), ends), batch.column(text_name)[at:to])
            more.append(pc.fill_null(same, True))  # null ids stand for a null text
        return pa.RecordBatch.from_arrays([batch.column(c)[at:to] for c in names] + more, names=[*names, "ids", "n_ids", *["exact"][: check]])

    def rows(batches):
        v = Vocabulary(*handed.value)
        encoder = Encoder(v)
        for batch in batches:
            at, flat, ends, missing = 0, array("i"), [0], []
            for i, t in enumerate(batch.column(text_name)):
                t = t.as_py()
                flat.extend(encoder.encode(t or ""))
                ends.append(len(flat))
                missing.append(t is None)
                if len(flat) >= _IDS:
                    yield batch_of(v, batch, at, i + 1, flat, ends, missing)
                    at, flat, ends, missing = i + 1, array("i"), [0], []
            if missing:
                yield batch_of(v, batch, at, batch.num_rows, flat, ends, missing)

    return rows


def _decode_rows(handed, ids_name: str, result: str, names: list[str]):
    def rows(batches):
        v = Vocabulary(*handed.value)
        for batch in batches:
            lists = batch.column(ids_name)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = 0
            while at < batch.num_rows:  # a bounded number of ids at once
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _IDS, side="right")) - 1)
                part = lists[at:to]
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                got = decode_flat(v, flat, ends[at : to + 1] - ends[at])
                got = pc.if_else(part.is_valid(), got, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in names), got], names=[*names, result])
                at = to

    return rows


def _encoded(docs: DataFrame, vocabulary: Vocabulary, text_col: str, check: bool) -> DataFrame:
    results = ("ids", "n_ids", "exact") if check else ("ids", "n_ids")
    docs = in_small_batches(docs).drop(*(c for c in results if c != text_col))
    schema = T.StructType([*docs.schema, *T._parse_datatype_string("ids array<int>, n_ids long, exact boolean")][: len(docs.columns) + len(results)])
    return docs.mapInArrow(_encode_rows(docs.sparkSession.sparkContext.broadcast(vocabulary.plain), text_col, docs.columns, check), schema)


def encode_column(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) and n_ids."""
    return _encoded(docs, vocabulary, text_col, check=False)


def decode_column(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", result: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column."""
    rows = in_small_batches(rows).drop(*(c for c in (result,) if c != ids_col))
    schema = T.StructType([*rows.schema, T.StructField(result, T.StringType())])
    return rows.mapInArrow(_decode_rows(rows.sparkSession.sparkContext.broadcast(vocabulary.plain), ids_col, result, rows.columns), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ids, n_ids and exact: whether decoding, in the same task, gives the text back."""
    return _encoded(docs, vocabulary, text_col, check=True)
