import random

import xxhash
from pyspark.sql import functions as F

from dijkstone.llm import simhash


def brute_print(t):
    w = ("" if t is None else t).encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    p = {i: brute_print(t) for i, t in rows}
    comp = {i: i for i in p}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in p:
        for j in p:
            if i < j and bin(p[i] ^ p[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (format(p[i], "016x"), find(i)) for i in p}


def test_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcDEé") for _ in range(3))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "É x y z"), (7, "é x y z")]
    for i in range(8, 200):
        if i > 20 and r.random() < 0.6:
            w = r.choice(rows[8:])[1].split()
            for _ in range(r.choice([0, 1, 2])):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(word() for _ in range(r.randint(3, 400)))))
    rows.append((900, " ".join(word() for _ in range(70_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 50
    kept = {x.doc_id for x in simhash.keep_one_of_each(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_links_by_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = list({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(20)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    got = {(x.a, x.b) for x in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 3}
    assert got == want and want


def test_odd_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d", 1), (None, None, 2), (7, "a b c d", 3), (7, "a b c d", 3)], "doc_id long, text string, component_id int")
    got = sorted(((str(x.id), x.component_id) for x in simhash.near_duplicates(df).collect()), key=str)
    assert got == [("7", 7), ("7", 7), ("None", 7), ("None", None)]
    assert simhash.keep_one_of_each(df).count() == 4


def test_components_of_a_path_and_a_star(spark):
    from dijkstone.llm.common import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
