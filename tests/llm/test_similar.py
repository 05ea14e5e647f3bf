import random

import corpus_pipeline
from dijkstone.llm import similar
from tests.llm.test_simhash import brute_print


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def kept_by(rows):
    prints = {i: brute_print(t) for i, t in rows}
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for i in up:
        for j in up:
            if i < j and (alike(sets[i], sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i for i in up if find(i) == i}


def edited(r, word):
    """Texts of 60 to 200 words and copies with one to three words changed, one large family of them, and texts with one common line."""
    text = lambda n: [word() for _ in range(n)]
    line, rows = text(40), []
    for k in range(60):
        base = text(r.randint(60, 200))
        for _ in range(40 if k == 0 else 3):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(text(r.randint(15, 60)) + line) for _ in range(40)] + ["", " ", "one two", "ONE  two", "one two three"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_edited_copies_go(spark, tmp_path):
    r = random.Random(17)
    rows = edited(r, lambda: "".join(r.choice("abcdefgh") for _ in range(5)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(900, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    want = kept_by([*rows, (900, None)])
    got = [x.doc_id for x in corpus_pipeline.keep_one_near_copy(spark, df, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) < len(rows) - 100


def test_recall_of_bands():
    """Pairs at 0.8 share a band; unlike ones hardly ever do."""
    import numpy as np

    r = np.random.default_rng(2)
    at = lambda s, n=180: (lambda x, k: set(similar.bands_of(x[:n])) & set(similar.bands_of(x[n - k : 2 * n - k])))(r.integers(0, 1 << 63, 2 * n, np.uint64), round(2 * n * s / (1 + s)))
    assert sum(bool(at(0.8)) for _ in range(500)) >= 497
    assert sum(bool(at(0.2)) for _ in range(500)) <= 15


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (8, "A b  c d")], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in similar.keep_one_of_each(df).collect()) == ["7", "7", "None", "None"]
    assert similar.keep_one_of_each(df.where("false")).collect() == []


def test_no_pair_of_a_bucket_is_left_out(spark, monkeypatch):
    """All sets are in one bucket; pairs of which no member is a hub, or each is like another hub, are joined as well."""
    r, held = random.Random(3), {}
    new = lambda n: [r.getrandbits(60) for _ in range(n)]
    for k in range(14):
        held[k] = new(90)
    common = new(70)
    for k in range(14, 20):
        held[k] = common + new(17)  # 0.67 among each other
    for k in (9, 12, 17):
        held[20 + k] = held[k][:-r.randint(0, 8)] + new(8)
    held[50], held[51] = held[0][:82] + new(8), held[0][6:] + new(3)
    held[52], held[53] = held[51][9:] + new(9), held[51][18:] + new(3)
    held[54] = held[52][9:]

    def sets(docs, id_col, text_col, shingle, whole=False):
        rows = docs.select(id_col).collect()
        return spark.createDataFrame([(i, i, sorted(held[i]) if whole else [1]) for (i,) in rows], "id long, key long, values array<long>")

    monkeypatch.setattr(similar, "sets", sets)
    want = {(a, b) for a in held for b in held if a > b and alike(set(held[a]), set(held[b]))}
    parts = similar.connected_components(similar.edges(spark.createDataFrame([(i, "") for i in held], "doc_id long, text string")))
    part = dict(map(tuple, parts.collect()))
    assert len(want) > 6 and all(part.get(a) is not None and part.get(a) == part.get(b) for a, b in want)
    assert set(part) == {i for p in want for i in p} and len(set(part.values())) == len(set(map(tuple, _closed(want))))


def _closed(pairs):
    groups = []
    for p in map(set, pairs):
        met = [g for g in groups if g & p]
        groups = [g for g in groups if not g & p] + [p.union(*met)]
    return [sorted(g) for g in groups]
