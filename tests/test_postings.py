import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from dijkstone.functions.stems import dutch_stem
from dijkstone.operators.postings import Postings
from dijkstone.operators.scoring import text_fallback

#: Words and stems from the published sample vocabulary.
PAIRS = """lichaam licham  lichaamziek lichaamziek  lichamelijk licham  lichamelijke licham  lichamelijkheden licham  lichamen licham
lichere licher  licht licht  lichtdoorlatende lichtdoorlat  lichten licht  lichtende lichtend  lichters lichter
lichtgevoeligheid lichtgevoel  lichtgrijs lichtgrijs  lichthoeveelheid lichthoevel  lichtkringen lichtkring  lichtten licht
lichtverontreinigde lichtverontreinigd  lichtzinnige lichtzinn  lidstaten lidstat  opglanzingen opglanz  opglimpende opglimp
opgrijnzen opgrijnz  opgroeiende opgroei  opgroeiplaats opgroeiplat  ophaal ophal  ophaalt ophaalt  ophalers ophaler
opheffen opheff  opheldering ophelder  ophieven ophiev  ophoog ophog  ophouden ophoud""".split()


def by_position(word):
    """The published rules, letter by letter."""
    w = [dict(zip("äëïöüáéíóú", "aeiouaeiou")).get(c, c) for c in word.lower()]
    v = lambda c: c in "aeiouyè"
    if w[:1] == ["y"]:
        w[0] = "Y"
    i = 0
    while i < len(w) - 1:
        if v(w[i]) and w[i + 1] == "i" and i + 2 < len(w) and v(w[i + 2]):
            w[i + 1], i = "I", i + 3
        elif v(w[i]) and w[i + 1] == "y":
            w[i + 1], i = "Y", i + 2
        else:
            i += 1
    w = "".join(w)

    def past(start):
        i = start
        while i < len(w) and not v(w[i]):
            i += 1
        while i < len(w) and v(w[i]):
            i += 1
        return i + 1 if i < len(w) else None

    p1 = past(0)
    p2 = past(p1) if p1 else None
    p1, p2 = max(p1, 3) if p1 else len(w), p2 or len(w)
    undouble = lambda x: x[:-1] if x[-2:] in ("kk", "dd", "tt") else x
    held = lambda x, n, p: len(x) - n >= p
    con = lambda x: x != "" and not v(x[-1])

    def en(x, n):
        y = x[:-n]
        return undouble(y) if held(x, n, p1) and con(y) and not y.endswith("gem") else x

    def e(x):
        return undouble(x[:-1]) if x.endswith("e") and held(x, 1, p1) and con(x[:-1]) else x

    for s in ("heden", "ene", "en", "se", "s"):
        if w.endswith(s):
            if s == "heden":
                w = w[:-5] + "heid" if held(w, 5, p1) else w
            elif s in ("en", "ene"):
                w = en(w, len(s))
            else:
                y = w[: -len(s)]
                w = y if held(w, len(s), p1) and con(y) and y[-1] != "j" else w
            break
    before = w
    w = e(w)
    lost = w != before
    if w.endswith("heid") and held(w, 4, p2) and not w[:-4].endswith("c"):
        w = w[:-4]
        w = en(w, 2) if w.endswith("en") else w
    for s in ("lijk", "baar", "end", "ing", "bar", "ig"):
        if w.endswith(s):
            if held(w, len(s), p2):
                y = w[: -len(s)]
                if s in ("end", "ing"):
                    w = y[:-2] if y.endswith("ig") and held(y, 2, p2) and not y[:-2].endswith("e") else undouble(y)
                elif s == "ig":
                    w = w if y.endswith("e") else y
                elif s == "lijk":
                    w = e(y)
                elif s == "baar" or lost:
                    w = y
            break
    if len(w) >= 4 and w[-3:-1] in ("aa", "ee", "oo", "uu") and not v(w[-1]) and w[-1] != "I" and not v(w[-4]):
        w = w[:-2] + w[-1]
    return w.replace("I", "i").replace("Y", "y")


def stems(spark, words):
    return [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").repartition(1).orderBy("i").select(dutch_stem(F.col("w"))).collect()]


def test_published_pairs(spark):
    assert stems(spark, PAIRS[::2]) == PAIRS[1::2] == [by_position(w) for w in PAIRS[::2]]


def test_equals_the_rules_letter_by_letter(spark):
    r = random.Random(3)
    ends = ["heden", "heid", "en", "ene", "s", "se", "e", "end", "ing", "ig", "igend", "lijk", "elijk", "baar", "bare", "bar", "gemen", "cheid", ""]
    words = ["".join(r.choice(["a", "e", "i", "o", "u", "y", "è", "ë", "é", "j", "k", "d", "t", "gem", "b", "ll", "s", "aa", "oo"]) for _ in range(r.randint(0, 6))) + r.choice(ends) + r.choice(ends) for _ in range(4000)]
    got = stems(spark, [*words, None])
    assert got[-1] is None
    assert [(w, g) for w, g in zip(words, got) if g != by_position(w)] == []


def words_of(text):
    return [by_position(w) for w in re.split(r"\s+", re.sub(r"[^\w\s\-&]", " ", (text or "").lower()).strip()) if len(w) > 1]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    bits = ["de", "bomen", "boom", "kappen", "kap", "gekapt", "vergunning", "vergunningen", "Gemeente.", "é", "lichamelijke", "lichaam", "-", "&", "in", "bo"]
    return [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(900, None), (901, ""), (902, "x"), (903, "bomen " * 5000 + "kappen")]


def test_searches_equal_brute_force(spark, texts, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), heads=7).write(spark.createDataFrame(texts, "doc long, body string"), "doc", "body", slices=3)
    held = {k: words_of(t) for k, t in texts}
    query = ["Bomen", "vergunning", "lichaam", "nergens"]
    asked = {by_position(w.lower()) for w in query}
    assert {tuple(x) for x in index.any_of(query + ["boom"]).collect()} == {(k, len(asked & set(w))) for k, w in held.items() if asked & set(w)}
    for prefixes in (["bo", "vergunningen"], ["b"], ["bo", "nergens"], ["k", "lich"], [""], []):
        want = [by_position(p) for p in prefixes if p]
        expected = {k for k, w in held.items() if want and all(any(x.startswith(p) for x in w) for p in want)}
        assert {x[0] for x in index.all_prefixes(prefixes).collect()} == expected
    for phrase in (["bomen", "kappen"], ["bomen", "boom", "bomen"], ["nergens"], []):
        s = [by_position(w) for w in phrase]
        expected = {(k, i) for k, w in held.items() for i in range(len(w)) if s and w[i : i + len(s)] == s}
        assert {tuple(x) for x in index.phrase(phrase).collect()} == expected
    mean = sum(len(w) for (k, t), w in zip(texts, held.values()) if t is not None) / sum(t is not None for _, t in texts)
    score = {}
    for t in asked:
        df = sum(t in w for w in held.values())
        for k, w in held.items():
            if t in w:
                tf = w.count(t)
                score[k] = score.get(k, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {x["id"]: x["score"] for x in index.ranked(query).collect()}
    assert got == pytest.approx(score)


def test_a_search_lists_only_its_partitions(spark, texts, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), heads=16).write(spark.createDataFrame(texts, "doc long, body string"), "doc", "body")
    heads = {h for _, h in index.asked(["bomen"])}
    read = {os.path.basename(os.path.dirname(f)) for f in index.of_terms(index.asked(["bomen"])).inputFiles()}
    plan = index.any_of(["bomen"])._jdf.queryExecution().executedPlan().toString()
    assert len(heads) == 1 and "PartitionFilters: [" in plan and "head" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan
    assert read  # the table has files


def test_index_without_words(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i")).write(spark.createDataFrame([("a", None), ("b", "x")], "doc string, body string"), "doc", "body")
    assert index.corpus().first()["docs"] == 2
    for found in (index.any_of(["bomen"]), index.all_prefixes(["b"]), index.phrase(["de", "bomen"]), index.ranked(["bomen"])):
        assert found.collect() == [] and dict(found.dtypes)["id"] == "string"


def test_fallback_takes_words_from_their_start(spark):
    rows = [(1, "Domesticatie van vee", None, 1), (1, "de mestopslag<br>", None, 2), (2, "niets", "Mestopslag", 3), (3, "de mestopslag", None, 4), (4, None, None, 5)]
    t = spark.createDataFrame(rows, "wid int, body string, heading string, ord int")
    scopes = [spark.createDataFrame([(1,), (2,), (2,)], "wid int"), spark.createDataFrame([(4,), (1,)], "wid int")]
    found = lambda terms: [tuple(r) for r in text_fallback(t, scopes, terms, "wid", ["body", "heading"], ["ord"]).select("wid", "ord").orderBy("wid").collect()]
    assert found([" MESTopslag", "vee"]) == [(1, 2), (2, 3)]
    assert found(["vee", "van "]) == [] == found([])
    assert found(["(mest", "niets"]) == [(2, 3)]


def test_stems_keep_the_letters_of_their_partition(spark):
    from dijkstone.operators.postings import HEAD, _spelled

    r = random.Random(8)
    parts = ["a", "ä", "e", "ë", "è", "é", "i", "ï", "o", "ó", "y", "j", "k", "kk", "d", "t", "s", "en", "heden", "lijk", "ß", "中", "&", "-", "7", "aa", "oo"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(5000)]
    words = [w for w in words if len(w) > 1]
    assert [(w, s) for w, s in zip(words, stems(spark, words)) if not any(w.startswith(x) for x in _spelled(s[:HEAD])) or len(s) < HEAD] == []


def test_words_are_shuffled_as_texts_only(spark, tmp_path, monkeypatch):
    """One exchange, of documents, before the postings are written."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *a, **k))[1])
    Postings(spark, str(tmp_path / "i")).write(spark.createDataFrame([(1, "bomen kappen"), (2, None)], "doc long, body string"), "doc", "body", slices=3)
    plan = next(p for path, p in plans if path.endswith("/postings"))
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(id" in plan and plan.index("Generate") < plan.index("Exchange ")
