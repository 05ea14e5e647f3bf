import random
import re
import time

import pytest
from pyspark.sql import functions as F

from dijkstone.operators import names as N


def brute(texts, names, least):
    edge = lambda s, i: 0 <= i < len(s) and N._in_word(s[i])
    out = set()
    for k, t in texts:
        low = (t or "").lower()
        for n in names:
            if n and len(n) >= least:
                for m in re.finditer(f"(?={re.escape(n.lower())})", low):
                    if not edge(low, m.start() - 1) and not edge(low, m.start() + len(n)):
                        out.add((k, n))
    return out


@pytest.mark.parametrize("chars", [2_000_000, 0])
def test_both_ways_equal_brute_force(spark, chars):
    r = random.Random(1)
    bits = ["de", "Bos", "bossen", "é", "_", "-", " ", ".", "3", "in", "\n", "(x)", "Ü", r"\E"]
    names = sorted({"".join(r.choice(bits) for _ in range(r.randint(1, 4))).strip() for _ in range(120)} | {"bos", "BOS", "de bos", "bos-bos"})
    names = [n for n in names if re.match(r"\w", n) or chars]  # the first word is the key of the join
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "de bos, de BOS")]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in names] + [(None,), ("",)], "name string")
    got = N.found(t, n, ["id"], least=2, automaton_chars=chars)
    assert {tuple(x) for x in got.collect()} == brute(texts, names, 2)


def test_scopes_repeated_rows_and_clashing_columns(spark):
    texts = spark.createDataFrame([(1, 7, "the Green door"), (1, 7, "the Green door"), (None, 8, "a green, green hill"), (2, 9, "greenish")], "id long, of int, text string")
    names = spark.createDataFrame([(7, "green", 1), (8, "GREEN", 2), (9, "green", 3)], "scope int, name string, text int")
    out = N.found(texts.withColumnRenamed("text", "body"), names, ["id", "of"], text="body", on=F.col("of") == F.col("scope"))
    assert sorted((str(x.id), x.of, x.name, x.text) for x in out.collect()) == [("1", 7, "green", 1), ("None", 8, "GREEN", 2)]
    assert N.found(texts.limit(0), names.select("name"), ["id"]).collect() == [] == N.found(texts, names.select("name").limit(0), ["id"]).collect()


def test_many_names_take_linear_time():
    r = random.Random(2)
    names = {f"{r.randrange(16**6):06x} {r.randrange(16**4):04x}" for _ in range(100_000)}
    search, some = N.automaton(names), sorted(names)[:50]
    took = []
    for size in (20_000, 80_000):
        text = " ".join(r.choice(some) if i % 100 == 0 else f"{r.randrange(16**6):06x}" for i in range(size))
        began = time.process_time()
        found = N.words_in(search, text)
        took.append(time.process_time() - began)
        assert set(found) <= set(some) and len(found) == 50
    assert took[1] < 16 * took[0] + 0.5
