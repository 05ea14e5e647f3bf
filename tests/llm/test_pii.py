import hashlib
import random
import re

from pyspark.sql import functions as F

from dijkstone.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def stands(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if stands(name, m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))


def told(spark, texts):
    rows = pii.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {x.doc_id: x for x in rows}


def card(r, n, sep):
    d = [str(r.randrange(10)) for _ in range(n - 1)]
    last = next(c for c in "0123456789" if luhn("".join(d) + c))
    return "".join(c + (r.choice(sep) if i < n - 1 else "") for i, c in enumerate([*d, last]))


def test_base_equals_patterns(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "..", "+", "-", " ", "  ", "é", "😀", "1", "12", "255", "256", "1.2.3.4", "10.0.0.256", "001.02.3.04", "+1 (017) 555-7713", "+31", "()", "\n", "a", "B9", "_", "%", "0" * 13, "4111 1111 1111 1111", "+4", "1-2", "#"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(600)]
    texts += [" ".join([card(r, r.randint(10, 21), ["", " ", "-"]), "w", card(r, 16, [""])]) for _ in range(100)]
    texts += ["a@b.c.@d.e", "a@b.c+d@e.f", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "1.2.3.4+5@x.y", "+12345678", "+1234567890123456", "5 " * 20, "4111-1111--1111-1111-4111-1111-1111-1111"]
    got = told(spark, texts)
    for i, t in enumerate(texts):
        base = ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in BASE)
        assert base == brute(t), t
        assert got[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [brute(t).count(k + ":") for k in BASE]


def test_long_texts_and_many_matches(spark):
    r = random.Random(5)
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "a@" * 50_000, "1." * 50_000, " ".join(f"u{i}@h{i}.org é {card(r, 16, [''])}" for i in range(3_000))]
    got = told(spark, texts)
    for i, t in enumerate(texts):
        if i not in (0, 1, 4, 5):  # the plain patterns take square time for these
            assert got[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest()
    assert [got[i].spans for i in (0, 1, 4, 5)] == [""] * 2 + [got[4].spans] + [got[5].spans]
    assert got[6].n_email == got[6].n_card == 3_000


def test_checksums_and_context(spark):
    texts = [
        "konto DE89 3704 0044 0532 0130 00 danke", "GB82WEST12345698765432", "GB83WEST12345698765432", "XDE89370400440532013000",
        "ssn 078-05-1120", "row 078-05-1120", "ssn 000-12-3456 ssn 123-45-0000", "tel 030 1234 5678", "030 1234 5678", "phone +1 030 1234 5678",
    ]
    got = told(spark, texts)
    assert [got[i].spans for i in range(10)] == ["iban:6:33", "iban:0:22", "", "", "ssn:4:15", "", "", "local_phone:4:17", "", "phone:6:22"]
    rows = spark.createDataFrame([(1, "mail: me@x.org", "s"), (1, "me@x.org", "s")], "id long, body string, spans string")
    spans = [x.spans[0] for x in pii.find(rows, "body").collect()]
    assert [(s.kind, s.text, round(s.score, 6), s.evidence) for s in spans] == [("email", "me@x.org", 0.9, "mail"), ("email", "me@x.org", 0.6, "")]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, "a"), (None, "x@y.z", "b"), (1, "", None), (1, "", None)], "doc_id long, text string, spans string")
    got = sorted((str(x.doc_id), x.n_email, x.spans) for x in pii.counted(rows).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("None", 0, ""), ("None", 1, "email:0:5")]
    assert pii.counted(rows.limit(0)).collect() == []
    assert pii.find(rows, "text", "text").columns == ["doc_id", "spans", "text"]


def test_no_python_in_the_plan(spark):
    plan = pii.counted(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_running_sums(spark):
    n = [0, 1, 127, 128, 129, 1000]
    rows = spark.createDataFrame([(i,) for i in n], "n int").select("n", pii.running_sums(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")).cast("array<bigint>")).alias("s"))
    assert {x.n: x.s for x in rows.collect()} == {i: [k * (k + 1) // 2 for k in range(1, i + 1)] for i in n}
