import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from dijkstone.llm import alignment
from dijkstone.llm.queries import BYTE_BPE, PIECE_BPE


@pytest.fixture(scope="module")
def files():
    return alignment.Vocabularies.load(BYTE_BPE, PIECE_BPE)


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers over whole texts, and the bytes of each id."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a.encode_special_tokens = True
    table, names = alignment._byte_level(), {i: s for s, i in a.get_vocab().items()}
    bytes_a = lambda i: bytes(table[c] for c in names[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, bytes_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, bytes_b(i)) for i in b.encode(t)]


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def brute(docs, plain):
    rows, counts = [], Counter()
    for d, t in docs:
        a, b = (f(t) for f in plain) if t else ([], [])
        data = (" " + t).encode() if t else b""
        if not t or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            rows.append((d, 0, 0, 0, "", []))
            continue
        a, b = spans(a), spans(b)
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        said = []
        for low, high in zip([0, *cuts], cuts):
            said.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in (a, b)))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(set(links))
        rows.append((d, len(a), len(b), len(cuts), hashlib.sha256(";".join(said).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((d, a, b, g, len(links), s, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)) for d, a, b, g, s, links in rows), key=str)


ODD = [(None, None), (None, "x"), (-2, ""), (-3, "a▁b"), (-4, " "), (-5, "  lead and trail  "), (-6, "x\n y\t\tz <|endoftext|> </s><unk> <0x41>"), (-7, "国語 naïve é   b \x1c c 😀"), (-8, "z" * 4000), (-9, "same"), (-9, "same"), (-9, "other")]


def test_equals_brute_force(spark, files, plain, monkeypatch):
    r = random.Random(2)
    bits = ["the ", "word", "ing", " é", "😀", "ß", "-", "aaaa", "\n", "xq", "  ", " 12", "can't", " ", "國", ". ", "<s>"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(150)] + ODD
    want = brute(docs, plain)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(rows, files).collect()), key=str) == want
    assert any(x[1] > 20 for x in want)


def test_batches_and_memory_change_nothing(spark, files, plain, monkeypatch):
    for name, value in (("BATCH_BYTES", 300), ("SLICE_BYTES", 50), ("REMEMBERED", 5)):
        monkeypatch.setattr(alignment, name, value)
    docs = [(i, f"some words of text number {i} " * (i % 5)) for i in range(40)] + ODD
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(rows, files).collect()), key=str) == brute(docs, plain)


def test_empty_table_and_extra_columns(spark, files):
    rows = spark.createDataFrame([("k", "a b", 1, [2])], "name string, body string, row int, pairs array<int>")
    assert alignment.align(rows.limit(0), files, "name", "body").collect() == []
    assert alignment.align(rows, files, "name", "body").first().n_groups == 2
    got = alignment.groups(rows, files, "name", "body").first()
    assert [len(x.a) for x in got.groups] == [1, 1]


def test_jumping_over_long_chains():
    """Tokens that overlap in one long staircase are one group."""
    a, b = np.arange(2, 2002, 2), np.append(np.arange(1, 2000, 2), 2000)
    of_a, of_b = alignment.jump(a, b)
    assert set(of_a) == set(of_b) == {len(b) - 1}
    of_a, of_b = alignment.jump(np.array([1, 2, 3]), np.array([1, 3]))
    assert of_a.tolist() == [0, 1, 1] and of_b.tolist() == [0, 1]
