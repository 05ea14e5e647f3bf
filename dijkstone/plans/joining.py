"""Joins over the tables."""

from pyspark.sql import functions as F

from dijkstone.operators import joins as J
from dijkstone.operators import names as N
from dijkstone.plans.registry import query


@query(
    "jn01_chain",
    """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(t):
    n = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", "n_name")
    chained = J.chain(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice"),
        (t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["o_orderkey"], "inner"),
        (t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"], "inner"),
        (n, ["c_nationkey"], "inner"),
    )
    return chained.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


SCOPED = """WITH r AS (SELECT l_orderkey AS k, nullif(l_suppkey % 5, 0) AS scope, l_quantity AS q FROM lineitem WHERE l_linenumber = 1), l AS (SELECT o_orderkey AS k, o_custkey % 5 AS scope FROM orders)
"""


def _scoped(t, scoped):
    r = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.nullif(F.col("l_suppkey") % 5, F.lit(0)).alias("scope"), F.col("l_quantity").alias("q"))
    return J.scoped_or_null(t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("scope")), r, "k", "scope", scoped)


@query("jn02_scoped_or_null", SCOPED + "SELECT l.k, l.scope, r.q FROM l JOIN r ON l.k = r.k AND (l.scope = r.scope OR r.scope IS NULL)")
def _(t):
    return _scoped(t, True)


@query("jn03_unscoped", SCOPED + "SELECT l.k, l.scope, r.q FROM l JOIN r ON l.k = r.k")
def _(t):
    return _scoped(t, False)


@query("jn04_optional_labels", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query(
    "jn05_any_column",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_custkey FROM lineitem JOIN customer ON c_custkey = l_partkey UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_custkey FROM lineitem JOIN customer ON c_custkey = l_suppkey",
)
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return J.any_column(li, ["l_partkey", "l_suppkey"], t.customer.select("c_custkey"), "c_custkey")


@query("jn06_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    rich = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(rich, "c_custkey", "left_semi")


@query("jn07_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn07_not_in", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    c = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nk"))
    return J.not_in(c, "nk", t.supplier.where("s_acctbal > 5000"), "s_nationkey")


@query(
    "jn08_lateral_first",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o ON true",
)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return J.lateral_first(t.customer.select("c_custkey"), o, "c_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("jn09_json_each", "SELECT event_id, j.key AS key, j.value::VARCHAR AS value FROM events, json_each(props) j")
def _(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query(
    "jn10_ordered_requests",
    "WITH a AS (SELECT doc_id * 3 AS c_custkey, doc_id AS ord FROM documents) SELECT ord, c_custkey, c_name FROM a LEFT JOIN customer USING (c_custkey)",
)
def _(t):
    asked = t.documents.select((F.col("doc_id") * 3).alias("c_custkey"), F.col("doc_id").alias("ord"))
    return J.ordered_requests(asked, t.customer.select("c_custkey", "c_name"), "c_custkey")


PAIRS = """a AS (SELECT event_id AS a_id, user_id, ts AS a_ts FROM events WHERE event_type = 'signup'), b AS (SELECT event_id AS b_id, user_id, ts AS b_ts FROM events WHERE event_type = 'purchase'),
  p AS (SELECT a_id, b_id, user_id, date_diff('day', a_ts::DATE, b_ts::DATE) AS gap_days FROM a JOIN b USING (user_id) WHERE a_ts <= b_ts AND date_diff('day', a_ts::DATE, b_ts::DATE) BETWEEN 0 AND 10)"""


def pairs(t):
    a = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("a_id"), "user_id", F.col("ts").alias("a_ts"))
    b = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), "user_id", F.col("ts").alias("b_ts"))
    return J.as_of_pairs(a, b, ["user_id"], "a_ts", "b_ts", 10).select("a_id", "b_id", "user_id", F.col("gap_days").cast("long").alias("gap_days"))


@query("jn11_range_self_join", f"WITH {PAIRS} SELECT * FROM p")
def _(t):
    return pairs(t)


MUTUAL = """one AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY gap_days, a_id) AS n FROM p),
  two AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY gap_days, b_id) AS m FROM one WHERE n = 1)"""


@query("jn12_mutual_nearest", f"WITH {PAIRS}, {MUTUAL} SELECT a_id, b_id, user_id, gap_days FROM two WHERE m = 1")
def _(t):
    return J.mutual_nearest(pairs(t), "a_id", "b_id", "gap_days")


@query(
    "jn11_as_of",
    """SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN LATERAL
       (SELECT value FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'view' AND e.ts <= a.ts ORDER BY ts DESC LIMIT 1) b ON true""",
)
def _(t):
    a = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return J.as_of(a, b, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")


#: Words that the texts hold, as names of a scope.
NAMED = ("thing", "erble", "attion", "nicht", "ontion")


@query(
    "jn13_name_in_text",
    f"""WITH n AS (SELECT DISTINCT n_regionkey AS scope, list_extract({list(NAMED)}, n_nationkey % 5 + 1) AS name FROM nation)
        SELECT doc_id, scope, name FROM documents JOIN n ON doc_id % 5 = scope WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || name || '($|[^\\p{{L}}\\p{{N}}_])')""",
)
def _(t):
    """Whole words of all documents, through the words of the texts; the scope is tested on what meets."""
    d = t.documents.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("of"), "text")
    name = F.get(F.array(*map(F.lit, NAMED)), F.col("n_nationkey") % 5)
    n = t.nation.select(F.col("n_regionkey").cast("int").alias("scope"), name.alias("name")).distinct()
    return N.found(d, n, ["doc_id", "of"], on=F.col("of") == F.col("scope")).select("doc_id", "scope", "name")


@query(
    "jn13_whole_name_in_text",
    r"""SELECT DISTINCT d.doc_id, n.n_regionkey AS scope, lower(n.n_name) AS name FROM documents d JOIN nation n ON d.doc_id % 5 = n.n_regionkey
        WHERE contains(lower(d.text), lower(n.n_name)) AND regexp_matches(d.text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(n.n_name) || '($|[^\p{L}\p{N}_])')""",
)
def _(t):
    """Names of nations between word boundaries, within the scope."""
    d = t.documents.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("of"), "text")
    n = t.nation.select(F.col("n_regionkey").alias("scope"), F.lower("n_name").alias("name"))
    return N.found(d, n, ["doc_id", "of"], least=0, on=F.col("of") == F.col("scope")).select("doc_id", "scope", "name").distinct()


@query(
    "jn13_many_names",
    r"""WITH n AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] AS name FROM part UNION SELECT DISTINCT regexp_extract(lower(text), '\pL{5,}') FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\pL\pM\pN_]+'))) AS name FROM documents) JOIN n USING (name) WHERE length(name) >= 5""",
)
def _(t):
    """Many names in whole texts: the first words of parts, and the first long word of each document."""
    words = t.documents.where("text is not null").select(F.regexp_extract(F.lower("text"), r"\pL{5,}", 0).alias("name"))
    n = t.part.select(F.split(F.lower("p_name"), " ")[0].alias("name")).union(words).distinct()
    return N.found(t.documents.select("doc_id", "text"), n, ["doc_id"]).select("doc_id", "name")


@query(
    "jn14_equal_sets",
    """WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey % 7)) AS members FROM lineitem GROUP BY 1)
       SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n_owners, len(members)::INTEGER AS n_members FROM s WINDOW w AS (PARTITION BY members)""",
)
def _(t):
    return J.equal_sets(t.lineitem.select("l_orderkey", (F.col("l_partkey") % 7).alias("m")), "l_orderkey", "m")


@query(
    "jn14_set_classes",
    """WITH s AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT (l_partkey % 7)::VARCHAR)) AS members FROM lineitem WHERE l_quantity > 44 GROUP BY 1)
       SELECT id, md5(array_to_string(list_transform(members, lambda m: length(m) || ':' || m), ',')) AS class_id, len(members)::INTEGER AS n_members FROM s""",
)
def _(t):
    return J.set_classes(t.lineitem.where("l_quantity > 44").select(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 7).alias("m")), "id", "m")


@query("jn15_junction", "SELECT DISTINCT o_custkey, l_suppkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return J.junction(c, t.orders.select("o_custkey", "o_orderkey"), li, "o_custkey", "o_orderkey", ["o_custkey", "l_suppkey"])


@query(
    "jn17_paths_union",
    """SELECT l_orderkey AS id, 'key' AS path FROM lineitem WHERE l_partkey = 7 UNION SELECT o_orderkey, 'name' FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_name) LIKE '%7'
       UNION SELECT o_orderkey, 'direct' FROM orders WHERE o_orderkey % 100 = 7""",
)
def _(t):
    named = t.orders.join(t.customer.where(F.lower("c_name").like("%7")), F.col("o_custkey") == F.col("c_custkey"))
    paths = {"key": t.lineitem.where("l_partkey = 7").select(F.col("l_orderkey").alias("id")), "name": named.select(F.col("o_orderkey").alias("id")), "direct": t.orders.where("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("id"))}
    return J.paths_union(paths, ["id"])


@query("jn18_using", "SELECT l_returnflag, o_orderstatus, count(*) AS n FROM orders JOIN (SELECT l_orderkey AS o_orderkey, l_returnflag FROM lineitem) USING (o_orderkey) GROUP BY ALL")
def _(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return t.orders.join(li, "o_orderkey").groupBy("l_returnflag", "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "jn19_coverage_difference",
    """(SELECT DISTINCT o_custkey AS k, 'missing' AS side FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
       UNION ALL (SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))""",
)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return J.set_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query(
    "jn20_reference_chain",
    """WITH refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, min(l_partkey) AS ref, min(l_orderkey * 10 + 1) AS hop FROM lineitem GROUP BY 1), targets AS (SELECT p_partkey AS k FROM part WHERE p_size < 25)
       SELECT r.ref_id, coalesce(CASE WHEN t1.k IS NOT NULL THEN r.ref END, CASE WHEN t2.k IS NOT NULL THEN v.ref END, -1) AS resolved
       FROM refs r LEFT JOIN targets t1 ON r.ref = t1.k LEFT JOIN refs v ON r.hop = v.ref_id AND v.ref_id IS NOT NULL LEFT JOIN targets t2 ON v.ref = t2.k""",
)
def _(t):
    key = F.col("l_orderkey") * 10
    refs = t.lineitem.groupBy((key + F.col("l_linenumber")).alias("ref_id")).agg(F.min("l_partkey").alias("ref"), F.min(key + 1).alias("hop")).withColumn("resolved", F.lit(None).cast("long"))
    targets = t.part.where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return J.resolve_references(refs, targets, "ref", "k", "hop", "resolved", F.lit(-1)).select("ref_id", "resolved")


@query(
    "jn21_version_regression",
    """SELECT DISTINCT d.doc_id FROM documents d WHERE length(text) <= 900 AND EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.lang = d.lang AND o.n_chars % 10 <> 0 AND length(o.text) > 900) AND n_chars % 10 = 0""",
)
def _(t):
    d = t.documents
    return J.regressed(d.where("n_chars % 10 = 0"), d.where("n_chars % 10 <> 0"), ["source", "lang"], "text", 900).select("doc_id")


@query(
    "jn22_shared_sets",
    """WITH s AS (SELECT l_returnflag AS scope, l_suppkey AS owner, list_sort(list(DISTINCT l_partkey % 5)) AS members FROM lineitem GROUP BY ALL)
       SELECT scope, members, count(*) AS n_owners FROM s GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 5).alias("m"))
    return J.shared_sets(li, "scope", "owner", "m")


@query("smp01_repeatable_sample")
def _(t):
    from dijkstone.operators.ranking import sample_per_group

    return sample_per_group(t.documents.select("doc_id", "lang"), "lang", "doc_id", 20)


@query("src27_guarded_edges", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.05)")
def _(t):
    return J.guarded_edges(t.orders.select("o_orderkey", "o_custkey"), {"o_custkey": (t.customer.where("c_acctbal > 0"), "c_custkey"), "o_orderkey": (t.lineitem.where("l_tax > 0.05"), "l_orderkey")})
