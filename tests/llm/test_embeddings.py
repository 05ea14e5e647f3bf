import numpy as np

from dijkstone.llm.embeddings import near_duplicates


def brute(rows):
    sound = {}
    for i, (v, label) in rows.items():
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            sound[i] = np.array(np.float32(v), np.float64)
    links = {i: set() for i in rows}
    for i in sound:
        for j in sound:
            if i < j and rows[i][1] == rows[j][1] and len(sound[i]) == len(sound[j]):
                a, b = sound[i], sound[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    comp = {}
    for i in sorted(rows):
        if i not in comp:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in comp:
                    comp[k] = i
                    stack += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in rows}


def test_equals_brute_force(spark):
    r = np.random.default_rng(2)
    rows, base = {}, [r.normal(size=16) for _ in range(25)]
    for i in range(900):
        kind, label = r.random(), int(r.integers(0, 3))
        b = base[r.integers(0, len(base))]
        v = r.normal(size=16) if kind < 0.3 else b * r.uniform(0.1, 9) if kind < 0.4 else b if kind < 0.5 else b + r.normal(size=16) * r.choice([0.05, 0.15, 0.2])
        rows[i] = (np.float32(v).tolist(), label)
    rows[900] = (None, 1)
    rows[901] = ([0.0] * 16, 1)
    rows[902] = ([float("nan")] + [1.0] * 15, 1)
    rows[903] = ([float("inf")] + [1.0] * 15, 1)
    rows[904] = ([None] + [1.0] * 15, 1)
    rows[905] = (rows[0][0], None)
    rows[906] = ([], 1)
    rows[907] = ([1.0, 2.0], 1)
    rows[908] = ([2.0, 4.0], 1)
    df = spark.createDataFrame([(i, v, label, "x") for i, (v, label) in rows.items()], "vec_id long, embedding array<float>, label int, kept string")
    want = brute(rows)
    for block_rows in (40, 2000):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_duplicates(df, block_rows=block_rows).collect()}
        assert got == want
    assert sum(a for a, _, _ in want.values()) > 1000


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.01], 3)], "vec_id long, embedding array<float>, label int")
    assert near_duplicates(df.limit(0)).collect() == []
    assert sorted((x.vec_id or 0, x.n_links, x.component_id) for x in near_duplicates(df).collect()) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_labels_of_any_type(spark):
    """Text labels work, and fractions with one whole part stay apart."""
    from dijkstone.llm.embeddings import near_duplicates

    v = [1.0, 2.0, 3.0]
    for labels, kind in ((["a", "a", "b", None], "string"), ([1.2, 1.2, 1.5, None], "double")):
        df = spark.createDataFrame([(i, v, x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
        got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in near_duplicates(df).collect())
        assert got == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (3, 0, 3, True)]
