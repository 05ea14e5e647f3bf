import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dijkstone.llm import merkle
from dijkstone.llm.common import in_fold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, f):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + f])) for i in range(0, len(levels[-1]), f)])
    return levels


def path(levels, i, f):
    out = []
    for level in levels[:-1]:
        b = i // f * f
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + f])))
        i //= f
    return out


def brute(rows, f):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([x[0] for x in groups[s]], f)
    top, out = tree([trees[s][-1][0] for s in order], f), []
    for k, s in enumerate(order):
        for i, (digest, r) in enumerate(groups[s]):
            p, got = path(trees[s], i, f) + path(top, k, f), digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[2] is not None:
                got = leaf((r[0], r[1], r[2].translate(str.maketrans(UPPER, LOWER))))
            for a, b in p:
                got = h(a + got + b)
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in p)), got, got == top[-1][0]))
    return sorted(out, key=str)


def run(rows, f):
    text = F.when(in_fold("doc_id", 5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    out = merkle.manifest(rows, "doc_id", "source", FIELDS, {"text": text}, f)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("f", [2, 3, 16])
def test_equals_brute_force(spark, f):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", f"Text É {i}" if i % 4 else f"low {i}") for i in range(700)]
    rows += [(None, "hot", "x"), (None, "hot", "x"), (3, "hot", "Twice"), (3, "hot", "Twice"), (7, None, None), (8, "", ""), (9, "ü", "A"), (-4, "alone", None), (5, "s1", "A" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute(rows, f)
    assert run(df, f) == want
    assert any(not x[-1] for x in want) and any(x[-1] for x in want)


def test_small_trees(spark):
    for rows in ([(1, "a", "B")], [(1, None, "B"), (2, "x", "C")], [(i, "a", "t") for i in range(17)]):
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        assert run(df, 16) == brute(rows, 16)
        assert run(df.limit(0), 16) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", "B", "x", 2)], "doc_id long, source string, text string, leaf string, idx int")
    out = merkle.manifest(df, "doc_id", "source", FIELDS).first()
    assert out.verified and out.leaf == leaf((1, "a", "B")) == out.root
