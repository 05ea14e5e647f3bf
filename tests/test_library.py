"""Small fixtures for what the tables don't hold: nulls, holes, cycles, ties, streams, archives."""

import datetime

import zipfile

import pytest
from pyspark.sql import functions as F

from dijkstone.functions import text as X
from dijkstone.operators import aggregates as A
from dijkstone.operators import classify as C
from dijkstone.operators import consistency as K
from dijkstone.operators import geo as G
from dijkstone.operators import joins as J
from dijkstone.operators import polygons
from dijkstone.operators import predicates as P
from dijkstone.operators import ranking as R
from dijkstone.operators import scoring as S
from dijkstone.operators import trees as T
from dijkstone.sources import incremental as I
from dijkstone.sources import tables as SRC
from dijkstone.streaming import pipelines as ST


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Abc 5%", True), (2, None, None), (3, "xyz", False)], "id int, t string, off boolean")
    assert values(df.where(P.contains_any("t", ["5%"])), "id") == [(1,)]
    assert df.where(P.contains_any("t", [])).count() == 3 and df.where(P.like_any("t", None)).count() == 3 and df.where(P.like_any("t", [])).count() == 0
    assert values(df.where(P.active("off", True)), "id") == [(2,), (3,)] and values(df.where(P.active("off", False)), "id") == [(3,)]
    for bad in ("1,2,3", "5,0,1,2", "0,0,999,1"):
        with pytest.raises(ValueError):
            P.Box.parse(bad)
    f = P.Filters(differs={"t": "xyz"})
    assert values(f.apply(df), "id") == [(1,), (2,)]
    d = spark.createDataFrame([("gmb-2024-12", "x"), ("other", "dakkapel plaatsen")], "id string, t string")
    assert values(d.where(P.search_predicate("gmb-2024-12", ["id"], "t")), "t") == [("x",)]
    assert values(d.where(P.search_predicate("dak pla", ["id"], "t")), "id") == [("other",)] and d.where(P.search_predicate(" ", ["id"], "t")).count() == 2


def test_joins_with_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, scope string")
    right = spark.createDataFrame([(1, "a", 10), (1, None, 20), (2, "x", 30)], "k int, scope string, v int")
    assert sorted((r.k, str(r.scope), r.v) for r in J.scoped_or_null(left, right, "k", "scope").collect()) == [(1, "None", 20), (1, "a", 10), (1, "a", 20)]
    some, none = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([], "x int")
    df = spark.createDataFrame([(1,), (2,), (None,)], "y int")
    assert J.not_in(df, "y", some, "x").count() == 0 and J.not_in(df, "y", none, "x").count() == 3 and values(J.not_in(df, "y", some.where("x = 1"), "x"), "y") == [(2,)]
    got = J.ordered_lookup(spark, [3, 1, 3], spark.createDataFrame([(1, "one")], "k int, n string"), "k").collect()
    assert [(r.k, r.n) for r in got] == [(3, None), (1, "one"), (3, None)]
    gaps = spark.createDataFrame([(1, 10, 5), (2, 10, 3), (1, 11, 1), (3, 12, 7)], "a int, b int, gap int")
    assert values(J.mutual_nearest(gaps, "a", "b", "gap"), "a", "b") == [(1, 11), (2, 10), (3, 12)]


def test_trees(spark):
    nodes = [(1, None, "Hoofdstuk", "H1"), (2, 1, "Artikel", "A1"), (3, 2, "Lid", None), (4, 1, "Artikel", "A2"), (5, 99, "Lid", "wees"), (6, 3, "Lid", "diep"), (8, 9, "x", None), (9, 8, "x", None)]
    df = spark.createDataFrame(nodes, "id int, parent_id int, kind string, heading string")
    up = {(r.id, r.ancestor): r.depth for r in T.ancestors(df.where("id < 8")).collect()}
    assert up[6, 1] == 3 and up[3, 1] == 2 and (1, 1) not in up
    assert T.ancestors(df, max_depth=6).count() < 60  # a cycle ends
    near = {r.id: r for r in T.nearest_of_kind(df, ["Artikel", "Hoofdstuk"], ["heading"]).collect()}
    assert near[6].artikel.id == 2 and near[6].hoofdstuk.heading == "H1" and near[2].artikel.id == 2 and near[1].artikel is None and 5 not in near
    hits = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "point string, id int")
    assert values(T.most_specific(hits, df, ["point"]), "point", "id") == [("p", 2), ("q", 1)]
    assert {r.id: r.path for r in T.heading_paths(df.where("id < 8"), "heading").collect()}[6] == "H1 > A1 > diep"
    assert {r.id: r.root for r in T.roots_of(df.where("id < 8")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}


def test_geometry(spark):
    hole = F.array(G.ring([(0, 0), (10, 0), (10, 10), (0, 10)]), G.ring([(4, 4), (6, 4), (6, 6), (4, 6)]))
    ell = F.array(G.ring([(20, 0), (30, 0), (30, 4), (24, 4), (24, 10), (20, 10)]))
    areas = spark.range(1).select(F.explode(F.array(F.struct(F.lit("hole").alias("n"), hole.alias("rings")), F.struct(F.lit("ell").alias("n"), ell.alias("rings")))).alias("a")).select("a.*")
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 10.0, 10.0), (5, 4.0, 5.0), (6, 25.0, 5.0), (7, 22.0, 9.0), (8, 24.0, 7.0), (9, 50.0, 50.0)]
    points = spark.createDataFrame(pts, "id int, x double, y double")
    assert values(polygons.holders(points, areas), "id") == [(1,), (3,), (4,), (5,), (7,), (8,)]
    assert values(polygons.holders(points, areas, boundary=False), "id") == [(1,), (7,)]
    one = spark.range(1)
    assert one.select(G.area(G.ring([(0, 0), (4, 0), (4, 3), (0, 3)]))).first()[0] == 12.0
    p = one.select(G.parse_wkt(F.lit("POINT (3 4)")), G.parse_wkt(F.lit("LINE")), G.simplify(G.ring([(0, 0), (1, 0), (2, 0), (9, 0)]), 2.0)).first()
    assert p[0][0].x == 3.0 and p[1] is None and [q.x for q in p[2]] == [0.0, 2.0, 9.0]
    z = one.select(G.tile_envelope(F.lit(0), F.lit(0), F.lit(0)), G.tile_envelope(F.lit(3), F.lit(2), F.lit(1)), G.tile_envelope(F.lit(3), F.lit(3), F.lit(1))).first()
    assert abs(z[0].max_x - z[0].min_x - 880803.84) < 1e-6 and abs(z[1].max_x - z[2].min_x) < 1e-9 and z[0].max_y == G.TILE_MAX_Y


def test_text(spark):
    one = spark.range(1)
    got = one.select(
        X.tokens(F.lit("Welke regels gelden voor een Dakkapel & antenne-installatie?")).alias("t"), X.article_label(F.lit(""), F.lit("x")).alias("l"), X.normal_hash(F.lit(None).cast("string")).alias("h"),
        X.ngrams(F.array(F.lit("nieuwe"), F.lit("recreatiewoningen"))).alias("g"), X.only_action(F.lit("brug bouwen"), ["bouwen"]).alias("a"), X.match_strength(F.lit("Een (dakkapel)."), F.lit("dakkapel")).alias("m"), X.confidence(F.lit("Confidence: 80%")).alias("c"),
    ).first()
    assert got.t == ["dakkapel", "antenne-installatie"] and got.l is None and got.h is None and got.a is False and got.m == 1.0 and got.c == 0.8
    assert got.g[:2] == ["nieuwe recreatiewoningen", "nieuwe recreatiewoning"] and "recreatiewoning" in got.g
    assert S.parse_weighted("dak:0.5, hoog:9, x:-1, :, y") == {"dak": 0.5, "hoog": 1.0, "y": 1.0}


BODIES = [
    ("Betreft de molen\nBesluit: vergunning toegekend\nDe vergunning is geweigerd.", "verleend"), ("Na overleg is het zover: de vergunning is toegekend.", "verleend"), ("Het college en de raad heeft een vergunning verleend.", "verleend"),
    ("Molenpad 7, verleend op 3 mei", "verleend"), ("Stukken compleet\n  Ontvangstdatum: onbekend", "aanvraag"), ("Het plan is buiten behandeling gesteld.", "buiten_behandeling"), ("De aanvraag wordt ingetrokken. De vergunning is verleend.", "ingetrokken"),
    ("U kunt pas beginnen wanneer de vergunning is verleend.", None), ("Wanneer u wilt. De vergunning is verleend.", "verleend"), ("Indien de vergunning is geweigerd, hoort u dat. Wel: de vergunning is verleend.", "verleend"),
    ("Besluit: nog niet bekend\nDe vergunning is verleend.", None), ("Besluit: _afgebroken", None), ("x" * 600 + " de vergunning is verleend", None), ("Besloten de vergunning te weigeren.", "geweigerd"), ("Besloten de vergunning te verlenen.", "verleend"),
    ("De melding voor het slopen van\neen loods is geaccepteerd.", "melding_geaccepteerd"), ("", None), (None, None),
]
NUMBERS = [
    ("Zaaknummer: K/77-a2.", "K/77-a2"), ("dossiernr: QR.9.8.7, bijlage", "QR.9.8.7"), ("zie OV2031/4455 hierna", "OV2031/4455"), ("AB-Z2031-12345 en 2031XYZ99", "AB-Z2031-12345"), ("referentie 555-000111", "555-000111"),
    ("kenmerk zonder cijfers", None), ("Zaaknr: 12", None), (None, None),
]
RECEIVED = [
    ("Gekregen, ontvangen op 7 maart 2031. Datum ontvangst: 09-04-2031", "2031-03-07"), ("Datum ontvangst: 9/4/2031, ontvangen op 7 maart 2031", "2031-04-09"), ("Ontvangen op 40-01-2031; aangevraagd op 2 sept 2031", "2031-09-02"),
    ("Ontvangen op 1 foo 2031", None), ("7 maart 2031", None), (None, None),
]


def test_rules(spark):
    d = spark.createDataFrame(BODIES, "t string, want string").withColumn("got", C.decision_from_body(F.col("t")))
    assert [r.got for r in d.collect()] == [w for _, w in BODIES]
    d = spark.createDataFrame(NUMBERS, "t string, want string").withColumn("got", C.case_number(F.col("t")))
    assert [r.got for r in d.collect()] == [w for _, w in NUMBERS]
    d = spark.createDataFrame(RECEIVED, "t string, want string").withColumn("got", C.received_date(F.col("t")))
    assert [r.got for r in d.collect()] == [w for _, w in RECEIVED]
    one = spark.range(1)
    assert one.select(C.decision_from_title(F.lit("")), C.decision_from_title(F.lit("Iets"))).first()[:] == (None, "overig")
    v = spark.createDataFrame([("x@9-0",), ("x@10-0",), ("x@2067",), ("x@1050",)], "e string")
    assert [r.e for r in v.orderBy(R.version_key(F.col("e"))).collect()] == ["x@9-0", "x@10-0", "x@1050", "x@2067"]


def test_consistency_matrix(spark):
    flags, maybe = [True, False], [True, False, None]
    rows = [(a, r, n, m, s) for a in flags for r in maybe for n in flags for m in maybe for s in flags]
    df = spark.createDataFrame(rows, "a boolean, r boolean, n boolean, m boolean, s boolean").withColumn("c", K.consistency_class(*map(F.col, "arnms")))

    def want(a, r, n, m, s):
        if s:
            return "niet_annoteerbaar"
        if a and r and m is False:
            return "tegenstrijdige_doelen"
        if a and n and r is not False:
            return "consistent_aanwezig"
        if not a:
            return "vermoedelijk_vergeten_annotatie" if n else "intioref_zonder_annotatie_of_naam" if r else "overig_inconsistent"
        return "annotatie_zonder_naam_match" if not r and not n else "consistent_aanwezig"

    assert all(x.c == want(x.a, x.r, x.n, x.m, x.s) for x in df.collect())


def test_incremental(spark):
    rows = [("a", 5, 1), ("a", 9, 2), ("b", 1, 3), ("c", None, 4), ("a", 9, 5)]
    df = spark.createDataFrame(rows, "k string, ts int, o int")
    assert values(I.delta_sweep(df, "k", "ts", "o", 5), "k", "o") == [("a", 2), ("c", 4)]
    assert I.delta_sweep(df, "k", "ts", "o").count() == 3
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    ch = spark.createDataFrame([(1, "z", "wijzigen", 1), (2, None, "verwijderen", 2), (3, "n", None, 3)], "id int, v string, op string, o int")
    assert values(I.apply_changes(base, ch, "id", "op", "o"), "id", "v") == [(1, "z")]
    assert values(I.apply_changes(base, ch, "id", "op", "o", "toevoegen"), "id", "v") == [(1, "z"), (3, "n")]
    signals = {r.d: (r.dropped, r.stagnant) for r in R.stagnation(spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 20, 20, 20, 19, 5])], "s string, d int, n int"), ["s"], "d", "n").collect()}
    assert signals[5] == (True, True) and signals[2] == (False, False) and signals[4] == (False, True)
    assert A.threshold_ladder(df, "k", "ts", 10).first().threshold == 1


def test_sources(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x/one.xml", "<a>é</a>")
        z.writestr("two.txt", "no")
    assert values(SRC.zip_members(spark, str(path)), "member", "text") == [("x/one.xml", "<a>é</a>")]
    (tmp_path / "f.xml").write_text("<r><item><id>1</id><t>één</t></item><item><id>2</id></item></r>", encoding="utf-8")
    assert values(SRC.xml_rows(spark, str(tmp_path / "f.xml"), "item", "id int, t string").fillna(""), "id", "t") == [(1, "één"), (2, "")]
    tree = spark.createDataFrame([("k", '{"id":"1","title":"a","children":[{"id":"2","title":"b"},{"id":"3","children":[{"id":"4"}]}]}')], "k string, p string")
    flat = SRC.component_tree(tree, "k", "p").orderBy("place").collect()
    assert [(r.id, r.parent_id, r.depth) for r in flat] == [("1", None, 0), ("2", "1", 1), ("3", "1", 1), ("4", "3", 2)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, s string")
    SRC.replace_scope(df, str(tmp_path / "t"), ["s"])
    SRC.replace_scope(spark.createDataFrame([(9, "b")], "v int, s string"), str(tmp_path / "t"), ["s"])
    assert values(spark.read.parquet(str(tmp_path / "t")), "v", "s") == [(1, "a"), (9, "b")]


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "id long, user string, ts timestamp, kind string"
    spark.createDataFrame([(1, "a", at(1), "open"), (2, "a", at(5), "close"), (3, "b", at(2), "close")], schema).coalesce(1).write.parquet(src)
    q = ST.sweep_into(ST.read_stream(spark, src, schema), spark, out, "user", "ts", "id", ck)
    q.awaitTermination()
    assert values(ST.current(spark, out), "user", "id") == [("a", 2), ("b", 3)]
    spark.createDataFrame([(4, "b", at(1), "late"), (5, "c", at(9), "open")], schema).coalesce(1).write.mode("append").parquet(src)
    q = ST.sweep_into(ST.read_stream(spark, src, schema), spark, out, "user", "ts", "id", ck)
    q.awaitTermination()
    assert values(ST.current(spark, out), "user", "id") == [("a", 2), ("b", 3), ("c", 5)]
    pairs = ST.pair_life_cycles(ST.read_stream(spark, src, schema), "user", "ts", "kind", "open", "close", "1 hour")
    q = pairs.writeStream.format("memory").queryName("pairs").trigger(availableNow=True).option("checkpointLocation", ck + "2").start()
    q.awaitTermination()
    assert [(r.user, r.opened.minute, r.closed.minute) for r in spark.table("pairs").collect()] == [("a", 1, 5)]
    counts = ST.windowed_counts(spark.read.parquet(src), "ts", ["kind"], "5 minutes", "1 hour")
    assert counts.agg(F.sum("n")).first()[0] == 5
