"""Derived tables and reports that put several operators together."""

import uuid

from pyspark.sql import functions as F

from dijkstone.operators import aggregates as A
from dijkstone.operators import consistency as K
from dijkstone.operators import joins as J
from dijkstone.operators import names as N
from dijkstone.operators import ranking as R
from dijkstone.operators import scoring as S
from dijkstone.plans.registry import query
from dijkstone.sources.storage import shared_dir
from dijkstone.sources.versions import Versions

NAMES_SQL = "names AS (SELECT DISTINCT n_regionkey AS scope, CASE n_nationkey % 5 WHEN 0 THEN 'thing' WHEN 1 THEN 'erble' WHEN 2 THEN 'attion' WHEN 3 THEN 'nicht' ELSE 'ontion' END AS name FROM nation)"
MATCH = "regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || name || '($|[^\\p{L}\\p{N}_])')"


def _names(t):
    words = F.get(F.array(*map(F.lit, ["thing", "erble", "attion", "nicht", "ontion"])), F.col("n_nationkey") % 5)
    return t.nation.select(F.col("n_regionkey").alias("scope"), words.alias("name")).distinct()


def _named(t):
    """(doc_id, scope, name): the names of a document's scope that stand in its text."""
    d = t.documents.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("of"), "text")
    return N.found(d, _names(t), ["doc_id", "of"], on=F.col("of") == F.col("scope")).select("doc_id", "scope", "name")


@query("txt07_name_matches", f"WITH {NAMES_SQL} SELECT doc_id, scope, name FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH}")
def _(t):
    return _named(t)


@query("txt08_scoped_name_matches", f"WITH {NAMES_SQL} SELECT DISTINCT doc_id, name FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH}")
def _(t):
    return _named(t).select("doc_id", "name").distinct()


@query("txt08_all_name_matches", f"WITH {NAMES_SQL} SELECT DISTINCT doc_id, name FROM documents JOIN (SELECT DISTINCT name FROM names) ON {MATCH}")
def _(t):
    return N.found(t.documents.select("doc_id", "text"), _names(t).select("name").distinct(), ["doc_id"])


CONSISTENCY_SQL = f"""WITH {NAMES_SQL}, named AS (SELECT doc_id, name FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH}),
  annotated AS (SELECT doc_id, name FROM labels JOIN names ON doc_id % 5 = scope WHERE quality = 1 AND (doc_id + length(name)) % 2 = 0), referenced AS (SELECT doc_id, name FROM documents JOIN names ON doc_id % 5 = scope WHERE (doc_id + length(name)) % 3 = 0),
  k AS (SELECT * FROM named UNION SELECT * FROM annotated UNION SELECT * FROM referenced),
  s AS (SELECT k.doc_id, k.name, a.name IS NOT NULL AS annotated, CASE WHEN k.doc_id % 7 = 0 THEN NULL ELSE r.name IS NOT NULL END AS referenced, n.name IS NOT NULL AS named, CASE WHEN k.doc_id % 4 = 0 THEN k.doc_id % 8 = 0 END AS match, k.doc_id % 11 = 0 AS shut
    FROM k LEFT JOIN annotated a USING (doc_id, name) LEFT JOIN referenced r USING (doc_id, name) LEFT JOIN named n USING (doc_id, name))
  SELECT doc_id, name, CASE WHEN shut THEN 'niet_annoteerbaar' WHEN annotated AND coalesce(referenced, false) AND match = false THEN 'tegenstrijdige_doelen' WHEN annotated AND coalesce(referenced, true) AND named THEN 'consistent_aanwezig'
    WHEN NOT annotated AND named THEN 'vermoedelijk_vergeten_annotatie' WHEN NOT annotated AND coalesce(referenced, false) THEN 'intioref_zonder_annotatie_of_naam' WHEN annotated AND NOT coalesce(referenced, false) AND NOT named THEN 'annotatie_zonder_naam_match'
    WHEN annotated THEN 'consistent_aanwezig' ELSE 'overig_inconsistent' END AS class FROM s"""


@query("txt09_consistency", CONSISTENCY_SQL)
def _(t):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % 5).cast("int").alias("scope"))
    scoped = d.select("doc_id", "scope").join(_names(t), "scope")
    n = F.col("doc_id") + F.length("name")
    good = t.labels.where("quality = 1").select("doc_id")
    signals = {
        "named": _named(t),
        "annotated": good.withColumn("scope", (F.col("doc_id") % 5).cast("int")).join(_names(t), "scope").where(n % 2 == 0),
        "referenced": scoped.where(n % 3 == 0),
    }
    k = K.candidates_with_signals(signals, ["doc_id", "name"])
    referenced = F.when(F.col("doc_id") % 7 != 0, F.col("referenced"))
    match = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 8 == 0)
    return k.select("doc_id", "name", K.consistency_class(F.col("annotated"), referenced, F.col("named"), match, F.col("doc_id") % 11 == 0).alias("class"))


@query("txt10_named_not_referenced", f"WITH {NAMES_SQL} SELECT doc_id, name FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH} AND (doc_id + length(name)) % 3 <> 0")
def _(t):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % 5).cast("int").alias("scope"))
    named = _named(t).select("doc_id", "name")
    refs = d.select("doc_id", "scope").join(_names(t), "scope").where((F.col("doc_id") + F.length("name")) % 3 == 0).select("doc_id", "name")
    return named.join(refs, ["doc_id", "name"], "left_anti")


@query(
    "txt24_unified_objects",
    """WITH k(term, weight) AS (VALUES ('red', 1.0), ('ring', 0.5)), o AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'type', min(p_partkey), p_type FROM part GROUP BY p_type UNION ALL SELECT 'brand', min(p_partkey), p_brand || ' ring' FROM part GROUP BY p_brand),
       x AS (SELECT kind, id, weight * CASE WHEN regexp_matches(name, '(?i)(^|\\W)' || term || '($|\\W)') THEN 1.0 WHEN contains(lower(name), term) THEN 0.7 ELSE 0 END AS part FROM o, k)
       SELECT kind, id, round(sum(part), 6)::DOUBLE AS score FROM x WHERE part > 0 GROUP BY ALL ORDER BY score DESC, id, kind LIMIT 100""",
)
def _(t):
    p = t.part
    objects = p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    objects = objects.unionByName(p.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("kind", F.lit("type")))
    objects = objects.unionByName(p.groupBy(F.concat("p_brand", F.lit(" ring")).alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("kind", F.lit("brand")))
    words = S.keyword_table(t.spark, S.parse_weighted("red:1,ring:0.5"))
    scored = S.field_score(objects.withColumn("key", F.struct("kind", "id")), words, {"name": 1.0}, "key")
    return scored.select("key.kind", "key.id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id", "kind").limit(100)


@query(
    "txt28_structural_retrieval",
    """SELECT DISTINCT o_orderkey, path FROM (SELECT o_orderkey, 'key' AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name LIKE 'red %' AND p_size < 5
       UNION ALL SELECT o_orderkey, 'name' FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building') WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)""",
)
def _(t):
    within = t.orders.where("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    red = t.lineitem.join(t.part.where("p_name like 'red %' and p_size < 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    build = t.customer.where("lower(c_mktsegment) = 'building'").select(F.col("c_custkey").alias("o_custkey"))
    return J.paths_union({"key": within.join(red, "o_orderkey", "left_semi"), "name": within.join(build, "o_custkey", "left_semi")}, ["o_orderkey"])


@query("txt29_text_fallback", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(shing|ontion)') GROUP BY 1")
def _(t):
    hits = t.documents.where(F.rlike("text", F.lit(r"(?iU)(?<!\w)(shing|ontion)"))).select("source", "doc_id")
    return R.first_per_key(hits, ["source"], [F.col("doc_id")])


@query("txt30_merged_tokens", "SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 4 OR (length(w) = 3 AND w IN ('the', 'and'))")
def _(t):
    words = t.benchmark.select("item_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    return words.where((F.length("w") >= 4) | ((F.length("w") == 3) & F.col("w").isin("the", "and"))).distinct()


@query("mv01_rules_at_places", "SELECT DISTINCT c_nationkey, o_orderkey, p_type FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def _(t):
    li = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    steps = [(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["o_orderkey"], "inner"), (t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"], "inner"), (t.part.select("p_partkey", "p_type"), ["p_partkey"], "inner")]
    return J.chain(li, *steps).select("c_nationkey", "o_orderkey", "p_type").distinct()


@query(
    "mv02_point_activities",
    """SELECT DISTINCT o.o_custkey, l.l_suppkey % 50 AS activity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND (nullif(l.l_suppkey % 5, 0) = o.o_custkey % 5 OR nullif(l.l_suppkey % 5, 0) IS NULL)""",
)
def _(t):
    left = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("scope"), "o_custkey")
    right = t.lineitem.select(F.col("l_orderkey").alias("k"), F.nullif(F.col("l_suppkey") % 5, F.lit(0)).alias("scope"), (F.col("l_suppkey") % 50).alias("activity"))
    return J.scoped_or_null(left, right, "k", "scope").select("o_custkey", "activity").distinct()


@query(
    "mv03_equal_places",
    """WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey % 4)) AS members FROM lineitem GROUP BY 1)
       SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n_owners, len(members)::INTEGER AS n_members FROM s WINDOW w AS (PARTITION BY members)""",
)
def _(t):
    return J.equal_sets(t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 4).alias("m")), "l_orderkey", "m")


@query(
    "mv03_place_classes",
    """WITH s AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT (l_partkey % 4)::VARCHAR)) AS members FROM lineitem WHERE l_quantity > 47 GROUP BY 1)
       SELECT id, md5(array_to_string(list_transform(members, lambda m: length(m) || ':' || m), ',')) AS class_id, len(members)::INTEGER AS n_members FROM s""",
)
def _(t):
    return J.set_classes(t.lineitem.where("l_quantity > 47").select(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 4).alias("m")), "id", "m")


@query(
    "mv05_health",
    """WITH o AS (SELECT c_nationkey AS n_nationkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
       SELECT n_name, coalesce(orders, 0) AS orders, coalesce(suppliers, 0) AS suppliers, round(100.0 * done / nullif(orders, 0), 1)::DOUBLE AS pct_done FROM nation LEFT JOIN o USING (n_nationkey) LEFT JOIN s USING (n_nationkey)""",
)
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    out = t.nation.join(o, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), A.percent(F.col("done"), F.col("orders")).alias("pct_done"))


HEALTH_SQL = """o AS (SELECT o_custkey AS c_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1),
  d AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal) AS balance FROM customer GROUP BY ALL HAVING count(*) > 1),
  h AS (SELECT c.c_custkey, coalesce(orders, 0) AS orders, regexp_matches(right(c_name, 2), '^0[0-9]$') AS is_code, d.balance IS NOT NULL AS is_repeated, round(100.0 * done / nullif(orders, 0), 1)::DOUBLE AS pct
    FROM customer c LEFT JOIN o USING (c_custkey) LEFT JOIN d ON d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment AND d.balance = round(c.c_acctbal))"""


def _owner_health(t):
    """Per customer: orders, whether the name is a mere code, whether its traits repeat, and the share that is done."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.round("c_acctbal").alias("balance"), F.rlike(F.right("c_name", F.lit(2)), F.lit("^0[0-9]$")).alias("is_code"))
    traits = ["c_nationkey", "c_mktsegment", "balance"]
    repeated = c.groupBy(*traits).agg(F.count("*").alias("n")).where("n > 1").select(*traits, F.lit(True).alias("is_repeated"))
    h = c.join(o, "c_custkey", "left").join(repeated, traits, "left")
    return h.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "is_code", F.coalesce("is_repeated", F.lit(False)).alias("is_repeated"), A.percent(F.col("done"), F.col("orders")).alias("pct"))


@query("mv05_owner_health", f"WITH {HEALTH_SQL} SELECT c_custkey, orders, is_code, is_repeated, pct FROM h")
def _(t):
    return _owner_health(t)


@query(
    "mv05_data_health",
    f"WITH {HEALTH_SQL} SELECT count(*) AS owners, count(*) FILTER (WHERE orders > 0) AS with_content, count(*) FILTER (WHERE is_code AND orders > 0) AS code_only, count(*) FILTER (WHERE is_repeated) AS repeated, round(avg(pct), 1) AS mean_pct FROM h",
)
def _(t):
    some = F.col("orders") > 0
    return _owner_health(t).agg(
        F.count("*").alias("owners"), F.count_if(some).alias("with_content"), F.count_if(F.col("is_code") & some).alias("code_only"), F.count_if("is_repeated").alias("repeated"), F.round(F.avg("pct"), 1).alias("mean_pct")
    )


@query(
    "mv05_link_health",
    """WITH f AS (SELECT DISTINCT p_partkey AS k FROM part), l AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT event_id FROM events WHERE event_type = 'error')
       SELECT count(*) AS n_found, count(*) FILTER (WHERE l.k IS NULL) AS n_dead FROM f LEFT JOIN l USING (k)""",
)
def _(t):
    links = [t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), t.events.where("event_type = 'error'").select(F.col("event_id").alias("k"))]
    return K.dead_ends(t.part.select(F.col("p_partkey").alias("k")), links, "k")


@query(
    "mv06_load_status",
    """WITH r AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE value < 1) AS n_failed FROM events GROUP BY ALL)
       SELECT source, day, n, n_failed, total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS k, sum(n) OVER (PARTITION BY source)::BIGINT AS total FROM r) WHERE k = 1""",
)
def _(t):
    r = t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("n_failed"))
    last = R.first_per_key(r, ["source"], [F.desc("day")])
    return last.join(t.events.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("total")), "source")


@query("mv07_permit_stats", "SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("mv09_hash_coupling", "WITH h AS (SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash, doc_id FROM documents), c AS (SELECT hash, min(doc_id) AS explained FROM h GROUP BY 1) SELECT doc_id, explained FROM h JOIN c USING (hash)")
def _(t):
    from dijkstone.functions.text import normal_hash

    h = t.documents.select("doc_id", normal_hash(F.col("text")).alias("hash"))
    return h.join(h.groupBy("hash").agg(F.min("doc_id").alias("explained")), "hash").select("doc_id", "explained")


@query(
    "mv10_chunk_annotations",
    """WITH a AS (SELECT DISTINCT doc_id, 'quality' AS tag, 'label' AS provenance FROM labels WHERE quality = 0 UNION SELECT doc_id, 'toxic', 'label' FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'long', 'size' FROM documents WHERE n_chars > 5000)
       SELECT * FROM a UNION ALL SELECT doc_id, lang, 'fallback' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
)
def _(t):
    tag = lambda d, v: d.select("doc_id", F.lit(v).alias("tag"))
    branches = [("label", tag(t.labels.where("quality = 0"), "quality").union(tag(t.labels.where("toxic = 1"), "toxic"))), ("size", tag(t.documents.where("n_chars > 5000"), "long"))]
    return K.first_branches(branches, ["doc_id", "tag"], ("fallback", t.documents.select("doc_id", F.col("lang").alias("tag"))), "doc_id")


@query("mv11_reference_consistency", f"WITH {NAMES_SQL} SELECT name, count(*) AS n, count(*) FILTER (WHERE (doc_id + length(name)) % 3 <> 0) AS unreferenced FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH} GROUP BY 1")
def _(t):
    return _named(t).groupBy("name").agg(F.count("*").alias("n"), F.count_if((F.col("doc_id") + F.length("name")) % 3 != 0).alias("unreferenced"))


@query(
    "mv12_refresh",
    f"""WITH {NAMES_SQL}, named AS (SELECT doc_id, name FROM documents JOIN names ON doc_id % 5 = scope WHERE {MATCH})
        SELECT 0::BIGINT AS place, 'unfit' AS step, count(*) AS n_rows FROM documents WHERE text IS NULL OR n_chars < 200
        UNION ALL SELECT 1, 'hashes', count(DISTINCT md5(coalesce(text, ''))) FROM documents UNION ALL SELECT 2, 'names', count(*) FROM named
        UNION ALL SELECT 3, 'consistency', count(DISTINCT name) FROM named WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE text IS NULL OR n_chars < 200)""",
)
def _(t):
    """Derived tables refreshed step by step and published as one version; the rows are the run's ledger."""
    steps = [
        ("unfit", lambda read: t.documents.where("text is null or n_chars < 200").select("doc_id")),
        ("hashes", lambda read: t.documents.select(F.md5(F.coalesce("text", F.lit(""))).alias("hash")).distinct()),
        ("names", lambda read: _named(t)),
        ("consistency", lambda read: read("names").join(read("unfit"), "doc_id", "left_anti").groupBy("name").agg(F.count("*").alias("n"))),
    ]
    versions = Versions(t.spark, f"{shared_dir(t.spark)}/refresh-{uuid.uuid4().hex}")
    versions.refresh("run", steps)
    lines = [(x["place"], x["step"], x["rows"]) for x in versions.ledger("run").values()]
    return t.spark.createDataFrame(lines, "place long, step string, n_rows long")
