import hashlib
import random
import re

import pytest

from dijkstone.llm.decontaminate import RESULTS, judge

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [] if t is None else WORD.findall(t.encode().lower())


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            k = min(window, len(w))
            for s in range(len(w) - k + 1):
                wins.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                x = wins.get(tuple(w[s : s + k]))
                if x:
                    hit.update(range(s, s + k))
                    got |= x
        got = sorted(str(x) for x in got)
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_equals_brute_force(spark, limit):
    r = random.Random(7)
    word = lambda: r.choice(["the", "of", "a", "É", "x1", "ß", "Kö", "naïve"]) if r.random() < 0.6 else "".join(r.choice("abcXYé9") for _ in range(3))
    text = lambda n: "".join(word() + r.choice([" ", ", ", "-", "\n", "\x7f"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 12, 13, 14, 30, 60]))) for i in range(20)]
    items += [(20, None), (21, "..."), (22, items[3][1]), (23, items[7][1].upper()), (24, "the the the the the the the the the the the the the the the")]
    docs = [(0, None), (1, ""), (2, "!!")]
    for i in range(3, 150):
        t = text(r.randint(0, 80))
        if r.random() < 0.5:
            x = r.choice([x[1] for x in items if x[1]])
            w = x.split()
            t += " " + (x if r.random() < 0.5 else " ".join(w[r.randint(0, 5) :])) + " " + text(r.randint(0, 300))
        docs.append((i, t))
    docs += [(200, "the " * 400), (201, "THE " * 13), (202, text(40_000) + items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x[c] for c in RESULTS) for x in judge(d, b, broadcast_windows=limit).collect()}
    want = brute(docs, items)
    assert got == want
    assert sum(x[4] for x in want.values()) > 20


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(15))
    d = spark.createDataFrame([(None, item, "p"), (None, None, "q"), (1, item, "r"), (1, item, "r"), (1, "clean", None)], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    rows = judge(d, b).collect()
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.contaminated) for x in rows)
    assert got == [("1", 1, 0, 0, False), ("1", 15, 15, 1, True), ("1", 15, 15, 1, True), ("None", 0, 0, 0, False), ("None", 15, 15, 1, True)]
    assert judge(d.limit(0), b).collect() == []
    assert judge(d, b.limit(0)).where("contaminated").collect() == []
