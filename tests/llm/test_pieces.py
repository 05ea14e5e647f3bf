import random

import pytest

from dijkstone.llm import pieces
from dijkstone.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def real():
    return pieces.Vocabulary.load(VOCABULARY)


def whole(v, text):
    """Best segmentation of a whole text by plain dynamic programming."""
    best, back = [0.0], [None]
    for e in range(1, len(text) + 1):
        options = [(best[s] + v.score[v.ids[text[s:e]]], -s, v.ids[text[s:e]]) for s in range(max(0, e - v.longest), e) if text[s:e] in v.ids]
        if text[e - 1] not in v.ids:
            options.append((best[e - 1] + v.unknown, -(e - 1), -1))
        s = max(options, key=lambda o: (o[0], o[1]))
        best.append(s[0])
        back.append((-s[1], s[2]))
    out, e = [], len(text)
    while e:
        s, i = back[e]
        out = ([i] if i >= 0 else [v.byte_ids[b] for b in text[s:e].encode()]) + out
        e = s
    return out


def test_streaming_equals_whole(real):
    r = random.Random(1)
    small = pieces.Vocabulary([("", 0.0)] * 256 + [("a", -3), ("b", -3), ("ab", -4), ("ba", -4), ("aba", -5), ("▁", -2), ("▁a", -4), ("a▁b", -3), ("bb", -6)], list(range(256)))
    for _ in range(300):
        t = "".join(r.choice("aab▁bé") for _ in range(r.randint(1, 60)))
        stream = pieces.StreamingViterbi(small)
        got = []
        for at in range(0, len(t), 7):
            got += stream.feed(t[at : at + 7])
        assert got + stream.finish() == whole(small, t) == list(pieces.best_ids(small, t))
    text = "".join(r.choice(["the ", "word", "ing", " é", "😀", "ß", "-", "aaaa", "\n", "xq", "  "]) for _ in range(4000))
    flat = text.replace(" ", pieces.SPACE)
    stream = pieces.StreamingViterbi(real)
    assert stream.feed(flat) + stream.finish() == whole(real, flat)
    assert stream.widest < 8 * real.longest  # the window stays small


def test_cuts_change_nothing(real):
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice(["the ", "Wörter", " ", "   ", "\n", "\t", "▁", "naïve", "x" * 90, "国語", "a b", "é", ".com", "x.y,", "?!", "a. ", "..."]) for _ in range(r.randint(0, 40)))
        ids = list(pieces.Encoder(real).encode(text))
        assert pieces.decode(real, ids) == text
        if pieces.SPACE not in text and text:
            assert ids == whole(real, (" " + text).replace(" ", pieces.SPACE))


def test_columns(spark, real):
    rows = [(1, "Hello  world\n", "x"), (2, "", None), (3, None, "y"), (3, None, "y"), (None, "▁ \t" + "ab" * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.round_trip(df, real).collect()
    assert len(out) == 5 and all(x.exact for x in out)
    assert sorted((x.doc_id or 0, x.n_ids == 0, x.ids is None) for x in out) == [(0, False, False), (1, False, False), (2, True, False), (3, True, True), (3, True, True)]
    assert pieces.round_trip(df.limit(0), real).collect() == []


def test_decoding_of_any_ids(real):
    import numpy as np

    lists = [[], real.byte_ids[0xE2:0xE3], [5, 6, 7], [real.byte_ids[0xFF], real.ids["a"]], list(pieces.Encoder(real).encode("é 国.com a.b"))]
    ends = np.cumsum([0, *map(len, lists)])
    got = pieces.decode_flat(real, np.array(sum(lists, []), np.int64), ends).to_pylist()
    assert got[0] == "" and got[4] == "é 国.com a.b" and len(got) == 5
    assert pieces.decode_flat(real, np.array(lists[4], np.int64), np.array([0, len(lists[4])])).to_pylist() == [got[4]]
