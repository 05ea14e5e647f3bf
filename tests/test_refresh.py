import random

import pytest
from pyspark.sql import functions as F

from dijkstone.operators import patches as P
from dijkstone.sources.versions import Versions

TREE, PATCH = "id string, parent_id string, t string", "id string, parent_id string, t string, op string, version int"


def steps(spark, fail=(), log=None):
    def step(name, make):
        def run(read):
            (log if log is not None else []).append(name)
            if name in fail:
                raise RuntimeError(name)
            return make(read)

        return name, run

    return [
        step("base", lambda read: spark.range(10)),
        step("doubled", lambda read: read("base").withColumn("d", F.col("id") * 2)),
        step("total", lambda read: read("doubled").agg(F.sum("d").alias("s"))),
    ]


@pytest.mark.parametrize("broken", ["base", "doubled", "total"])
def test_a_run_resumes_where_it_stopped(spark, tmp_path, broken):
    v, first, second = Versions(spark, f"file://{tmp_path}"), [], []
    with pytest.raises(RuntimeError):
        v.refresh("r1", steps(spark, [broken], first))
    assert v.manifest()["version"] == 0  # nothing is to be seen of half a version
    made = v.refresh("r1", steps(spark, log=second))
    assert first[:-1] + second == ["base", "doubled", "total"] and made["version"] == 1
    assert v.read("total").first().s == 90
    assert {k: x["rows"] for k, x in v.ledger("r1").items()} == {"base": 10, "doubled": 10, "total": 1}
    assert v.refresh("r1", steps(spark))["version"] == 1  # it is done


def test_readers_keep_their_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    old = v.refresh("r1", steps(spark))
    other = [("base", lambda read: spark.range(3)), *steps(spark)[1:]]
    with pytest.raises(RuntimeError):
        v.refresh("r2", [other[0], *steps(spark, ["doubled"])[1:]])
    assert v.read("base").count() == 10
    new = v.refresh("r2", other)
    assert v.read("total").first().s == 6 and v.read("total", old).first().s == 90 and new["version"] == 2
    log = []
    v.refresh("r2", steps(spark, log=log), start="doubled")
    assert log == ["doubled", "total"] and v.manifest()["version"] == 3 and v.read("total").first().s == 6
    with pytest.raises(ValueError):
        v.refresh("r2", steps(spark), start="none")


def replay(tree, patches):
    rank = {P.REMOVE: 3, P.CHANGE: 2, P.ADD: 1}
    for v in sorted({p[4] for p in patches}):
        best = {}
        for i, up, t, op, w in patches:
            if w == v and op in rank and i is not None:
                best[i] = max(best.get(i, (0, "", "")), (rank[op], up or "", t or ""))
        put = {i: (up or None, t or None) for i, (r, up, t) in best.items() if r < 3}
        kept = {i: x for i, x in tree.items() if i not in put}
        dead = {i for i, b in best.items() if b[0] == 3}
        while more := {i for i, x in kept.items() if x[0] in dead} - dead:
            dead |= more
        after = {i: x for i, x in kept.items() if i not in dead} | put
        lost = {i for i in put if after[i][0] is not None and after[i][0] not in after}
        while more := {i for i, x in after.items() if x[0] in lost} - lost:
            lost |= more
        tree = {i: x for i, x in after.items() if i not in lost}
    return {(i, *x) for i, x in tree.items()}


def test_patches_equal_a_plain_replay_in_any_order(spark):
    r = random.Random(1)
    tree = {str(i): (str(i // 3) if i else None, "t") for i in range(60)}
    patches = []
    for _ in range(60):
        op, v = r.choice([P.ADD, P.CHANGE, P.REMOVE, None]), r.choice([1, 2])
        i = str(r.randrange(100, 120)) if op == P.ADD else str(r.randrange(1, 70))
        up = str(r.randrange(100, 125)) if r.random() < 0.3 else str(r.randrange(int(i) if int(i) < 100 else 60))  # no cycles
        patches.append((i, up if not (op == P.CHANGE and int(up) >= 100) else "0", f"n{r.randrange(3)}", op, v))
    want = replay(tree, patches)
    base = spark.createDataFrame([(i, *x) for i, x in tree.items()] + [(None, "0", "x")], TREE)
    for _ in range(2):
        got = P.replay(base, spark.createDataFrame([*patches, (None, "0", "n", P.ADD, 1)], PATCH)).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
        r.shuffle(patches)
    assert len(want) > 10


def test_defaults_inheritance_and_scopes(spark):
    items = spark.createDataFrame([("annotatie", 1, None), ("regel", 2, None), ("regel", 3, P.REMOVE), ("locatie", 4, P.CHANGE), (None, 5, None)], "kind string, id int, op string")
    rules = P.with_defaults(items, "kind", "op")
    assert {(x.id, x.op) for x in rules.collect()} == {(1, P.ADD), (3, P.REMOVE), (4, P.CHANGE)}
    bound = spark.createDataFrame([(2, "a"), (3, "b"), (3, "c")], "id int, b string").withColumn("op", F.lit("x"))
    assert {(x.b, x.op) for x in P.inherited(bound, rules, "id", "op").collect()} == {("b", P.REMOVE), ("c", P.REMOVE)}
    stored, new = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "d string, v int"), spark.createDataFrame([("d1", 9), ("d9", 9)], "d string, v int")
    out = P.replaced(stored, new, spark.createDataFrame([("d1",), ("d2",)], "d string"), ["d"])
    assert sorted(map(tuple, out.collect())) == [("d1", 9), ("d3", 3)]
    acts = spark.createDataFrame([("voegtoe",), ("verwijderContainer",), ("anders",), (None,)], "a string").select(P.operation(F.col("a")).alias("o"))
    assert [x.o for x in acts.collect()] == [P.ADD, P.REMOVE, P.CHANGE, None]
