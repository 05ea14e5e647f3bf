"""Queries and operators over all of their input, against brute force."""

import hashlib
import math
import random
from statistics import median

import __spark_entry__ as entry
from dijkstone.operators import aggregates as A
from dijkstone.operators import joins as J


def stem(w):
    return None if len(w) < 6 else w[:-2] if w.endswith("en") else w[:-1] if w.endswith("s") else None


def grams(words):
    out = []
    for n in range(min(3, len(words)), 0, -1):
        for i in range(len(words) - n + 1):
            part = words[i : i + n]
            out += [" ".join(part), " ".join([*part[:-1], stem(part[-1])]) if stem(part[-1]) else None]
    for parts in ([p for p in w.split("-") if len(p) > 1] for w in words):
        if len(parts) >= 2:
            out += [" ".join(parts), *(g for p in parts for g in (p, stem(p)))]
    return list(dict.fromkeys(g for g in out if g))


def test_ngrams_of_all_words(spark, tmp_path):
    r = random.Random(8)
    word = lambda: r.choice(["woningen", "antenne-installaties", "huis", "dakkapellen", "a-bc-regels", "brug"]) + r.choice(["", "s", "en", "x"])
    texts = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 30, 31, 59, 400])]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.item_id: x.grams for x in entry.queries()["txt13_ngrams"](spark, str(tmp_path)).collect()}
    assert got == {i: grams(t.split()) for i, t in texts}


def test_names_in_all_documents(spark, tmp_path):
    docs = [(1, "Some THING here"), (2, "a thing."), (3, "things"), (5, "NATION_10 and nation_1x"), (10, "in Nation_1, yes"), (15, "nat nation")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "NATION_1", 0), (5, "NATION_10", 0), (1, "OTHER", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    of = lambda q: sorted(tuple(x) for x in entry.queries()[q](spark, str(tmp_path)).select("doc_id", "name").collect())
    assert of("txt08_all_name_matches") == [(1, "thing"), (2, "thing")]
    assert of("jn13_whole_name_in_text") == [(5, "nation_10"), (10, "nation_1")]


def test_set_classes_of_all_owners(spark):
    sets = {1: "ab", 2: "ab", 3: "abc", 5: "ba", 6: "c", 8: "abc"}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s + s[0]] + [(9, "a,1:b"), (10, "a"), (10, "b")], "o int, m string")
    got = {x.id: (x.class_id, x.n_members) for x in J.set_classes(df, "o", "m").collect()}
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 5, 10], [3, 8], [6], [9]]
    assert got[3][1] == 3 and got[9][1] == 1


def test_candidates_of_an_object(spark, tmp_path):
    """All candidates count, however late in order, and the nearest to the median wins, area or not."""
    r, n = random.Random(4), 40
    orders = [(k, r.randrange(n)) for k in r.sample(range(100_000), 300)]
    spark.createDataFrame([(i, i % 3) for i in range(n)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {x.c_custkey: x.chosen for x in entry.queries()["geo13_candidates"](spark, str(tmp_path)).collect()}
    at = lambda k: (k * 7919 % 10007, k * 104729 % 10009)
    kind = lambda k: "Adres" if k % 13 == 0 else "Vlak" if k % 2 == 0 else "Punt"
    middle = {c: tuple(median(at(i)[a] for i in range(n) if i % 3 == c) for a in (0, 1)) for c in range(3)}

    def want(i):
        ks = sorted(k for k, c in orders if c == i)
        if max((math.dist(at(a), at(b)) for a in ks for b in ks)) < 1000:
            return ks[0]
        address = [k for k in ks if kind(k) == "Adres"]
        return address[0] if address else min(ks, key=lambda k: (math.dist(at(k), middle[i % 3]), kind(k) != "Vlak"))

    assert got == {i: want(i) for i in {c for _, c in orders}}
    assert any(kind(k) == "Punt" and any(kind(o) == "Vlak" for o, c in orders if c == i) for i, k in got.items())
    assert any(sorted(k for k, c in orders if c == i).index(k_) >= 6 for i, k_ in got.items())


def test_content_hash_streams_a_hot_scope(spark):
    """One scope of 20,000 rows over many chunks and partitions; no aggregate gathers it in one row."""
    rows = [("hot", i, f"t{i}") for i in range(20_000)] + [(f"s{i % 7}", i, None if i % 5 else "x") for i in range(100)] + [(None, 3, "c"), (None, None, "lost"), ("z", 2, "b"), ("z", 2, "a"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "scope string, k long, t string").repartition(7)
    out = A.content_hash(df, ["scope"], "k", "t")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    parts = {}
    for s, k, t in rows:
        parts.setdefault(s, []).append((k, t or ""))
    digest = lambda s: hashlib.md5("|".join(f"{k}:{t}" for k, t in sorted(p for p in s if p[0] is not None)).encode()).hexdigest()
    assert {x.scope: (x.hash, x.n) for x in out.collect()} == {s: (digest(p), len(p)) for s, p in parts.items()}
    assert A.content_hash(df.where("false"), ["scope"], "k", "t").collect() == []


def test_pairs_within_days_and_tiers(spark):
    """Buckets lose no pair and repeat none; a case number claims its rows before nearness does."""
    import datetime

    r, day = random.Random(3), lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=d % 5)
    rows = [(i, r.randrange(3), r.choice([None, None, 1, 2, 3]), day(r.randrange(-40, 40))) for i in range(300)]
    made = lambda x: spark.createDataFrame(x, "id long, s int, number int, ts timestamp")
    a, b = rows[:150], rows[150:]
    gap = lambda p, q: (q[3].date() - p[3].date()).days
    near = lambda a, b: [(p, q) for p in a for q in b if p[1] == q[1] and p[3] <= q[3] and gap(p, q) <= 4]
    left, right = made(a).selectExpr("id as a", "s", "ts as t"), made(b).selectExpr("id as b", "s", "ts as u")
    got = sorted((x.a, x.b, x.gap_days) for x in J.as_of_pairs(left, right, ["s"], "t", "u", 4).collect())
    assert got == sorted((p[0], q[0], gap(p, q)) for p, q in near(a, b)) and got

    first = lambda x: {k: min(p[3] for p in x if (p[1], p[2]) == k) for k in {(p[1], p[2]) for p in x if p[2]}}
    f, g = first(a), first(b)
    want = [(k[0], f[k], g[k], "number") for k in f.keys() & g.keys() if f[k] <= g[k]]
    rest = lambda x: [p for p in x if (p[1], p[2]) not in f.keys() & g.keys()]
    best = {}
    for p, q in near(rest(a), rest(b)):
        best[q] = min(best.get(q, (99, 0, p)), (gap(p, q), p[0], p))
    back = {}
    for q, (n, _, p) in best.items():
        back[p] = min(back.get(p, (99, 0, q)), (n, q[0], q))
    want += [(p[1], p[3], q[3], "nearest") for p, (_, _, q) in back.items()]
    assert sorted(map(tuple, J.cases_in_tiers(made(a), made(b), "s", "number", "ts", "id", 4).collect())) == sorted(want)


def test_walks_from_a_few_nodes(spark):
    """Subtrees and paths of some nodes are those of the whole closure, also in cycles, of orphans and of unknown nodes."""
    from dijkstone.operators import trees as T

    r = random.Random(6)
    rows = [(i, None if i == 0 else r.randrange(i)) for i in range(60)] + [(100, 999), (200, 201), (201, 200)]
    df = spark.createDataFrame(rows, "id long, parent_id long")
    closure = {tuple(x) for x in T.ancestors(df, max_depth=12).collect()}
    ids = [0, 7, 30, 59, 100, 200, 555, 999]
    some = spark.createDataFrame([(i,) for i in ids + [7]], "id long")
    assert sorted(map(tuple, T.climb(df, some, max_depth=12).collect())) == sorted(x for x in closure if x[0] in ids)
    below = sorted(map(tuple, T.subtree(df, some.withColumnRenamed("id", "root"), max_depth=12).collect()))
    assert below == sorted([(a, i, d) for i, a, d in closure if a in ids] + [(i, i, 0) for i in ids if i in dict(rows)])


def test_word_overlap_of_all_pairs(spark):
    from dijkstone.operators.scoring import word_overlap

    r = random.Random(2)
    text = lambda n: r.choices([f"word{i}" for i in range(40)], [40 - i for i in range(40)], k=n) + ["of"]
    a, b = [(i, text(r.randint(0, 30))) for i in range(40)], [(i, text(r.randint(0, 60))) for i in range(40)] + [(99, [])]
    got = sorted(map(tuple, word_overlap(spark.createDataFrame(a, "a int, w array<string>"), spark.createDataFrame(b, "b int, w array<string>"), "a", "b", "w").collect()))
    long = lambda w: {x for x in w if len(x) >= 4}
    assert got == sorted((i, j, len(long(x) & long(y))) for i, x in a for j, y in b if len(long(x) & long(y)) > max(5, 0.3 * len(long(x)))) and got


def test_degrees_of_known_places(spark):
    from pyspark.sql import functions as F

    from dijkstone.operators.geo import to_degrees

    row = spark.range(1).select(to_degrees(F.lit(155000.0), F.lit(463000.0)).alias("o"), to_degrees(F.lit(120700.723), F.lit(487525.502)).alias("w")).first()
    assert (row.o.lon, row.o.lat) == (5.38720621, 52.1551744)
    assert abs(row.w.lon - 4.88352559) < 1e-6 and abs(row.w.lat - 52.37453253) < 1e-6


def test_vocabulary_match_makes_no_rows_of_common_words(spark):
    import math
    import random

    from dijkstone.operators import scoring as S

    r = random.Random(3)
    texts = [(i, ["nation", *(str(r.randrange(12)) for _ in range(r.randrange(5))), None][: r.randrange(8)]) for i in range(60)]
    entries = [(f"e{i}", ["nation", *(str(r.randrange(12)) for _ in range(r.randrange(4)))]) for i in range(20)] + [("null", [None, "3"]), ("e0", ["7"])]
    t, v = spark.createDataFrame(texts, "id long, w array<string>"), spark.createDataFrame(entries, "entry string, entry_words array<string>")
    of = {}
    for e, w in entries:
        of.setdefault(e, set()).update(w)
    for least in (0.0, 0.34, 0.5, 0.51, 1.0):
        want = {(i, e): s for i, w in texts for e, ws in of.items() for s in [len(set(w) & ws - {None}) / len(ws)] if s and s >= least}
        out = S.match_vocabulary(t, v, "id", "w", least)
        got = out.collect()
        assert len(got) == len(want) and all(math.isclose(x.score, want[x.id, x.entry]) for x in got)
        assert "Aggregate [id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_topics_of_whole_texts(spark, tmp_path):
    """Texts that begin alike are all clustered, however late they differ; only equal ones count once."""
    heads = [f"begin{k} lang{k % 5} " * n for k, n in enumerate([1, 2, 30, 300, 3000] * 6)]
    texts = [h + end for h in heads for end in ("brug over water", "water over brug", "kap van een boom", "x")]
    docs = [(10 * i + copy, x) for i, x in enumerate(texts) for copy in (3, 1, 2)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["txt36_topics"](spark, str(tmp_path)).collect()
    got = {x.doc_id: x.topic for x in rows}
    assert sorted(x.doc_id for x in rows) == [10 * i + 1 for i in range(len(texts))]
    assert all(got[40 * k + 1] == got[40 * k + 11] for k in range(len(heads)))  # same words in another order
