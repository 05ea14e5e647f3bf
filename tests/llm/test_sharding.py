import hashlib

import pytest

from dijkstone.llm import sharding


def brute(names, size):
    n = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    prefs = [[(n(f"{s}/offset") + j * (n(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)] for s in names]
    owner = {}
    while len(owner) < size:
        for i in range(len(names)):
            if len(owner) < size:
                owner[next(p for p in prefs[i] if p not in owner)] = i
    return [owner[k] for k in range(size)]


def test_table(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 211)
    assert table == brute(names, 211)
    counts = [table.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 211 * 0.3
    heavy = sharding.fill_table(names, 211, {"s0": 3})
    assert heavy.count(0) > 2 * heavy.count(1)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 210)


def test_assign(spark, tmp_path):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 211)
    df = spark.createDataFrame([(i, "k", None) for i in range(500)] + [(3, "k", "x"), (None, "z", "q")], "id long, slot string, x string")
    out = sharding.assign(df, "id", names, 211)
    assert out.columns == ["id", "x", "slot", "shard"] and out.count() == 502
    for x in out.collect():
        slot = int(hashlib.md5(("" if x.id is None else str(x.id)).encode()).hexdigest()[:15], 16) % 211
        assert (x.slot, x.shard) == (slot, names[table[slot]])
    assert sharding.assign(df.limit(0), "id", names, 211).collect() == []
    sharding.write_shards(out, str(tmp_path / "out"), within=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 502 and back.select("shard").distinct().count() == 7
