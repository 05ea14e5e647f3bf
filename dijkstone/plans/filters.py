"""Filters, projections and set operations over the tables."""

from pyspark.sql import functions as F

from dijkstone.operators import predicates as P
from dijkstone.plans.registry import query


@query("flt01_contains_any", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%' OR p_name ILIKE '%r_ng%'")
def _(t):
    return t.part.where(P.contains_any("p_name", ["red", "r_ng"])).select("p_partkey", "p_name")


@query("flt02_like_any", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%promo%' OR p_type ILIKE 'stand%'")
def _(t):
    return t.part.where(P.like_any("p_type", ["%promo%", "stand%"]) & P.like_any("p_name", None)).select("p_partkey", "p_type")


FORM = P.Filters(
    one_of={"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, between={"o_orderdate": (None, None), "o_totalprice": (1000.0, 300000.0)}, present=["o_custkey"], differs={"o_orderstatus": "P"}
)
FORM_SQL = "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice BETWEEN 1000 AND 300000 AND o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'P'"


@query("flt03_search_form", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {FORM_SQL}")
def _(t):
    return FORM.apply(t.orders).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt04_id_or_words", "SELECT page_id, url FROM pages WHERE len(list_filter(regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}_]+'), lambda w: starts_with(w, 'exam'))) > 0 AND len(list_filter(regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}_]+'), lambda w: starts_with(w, 'en'))) > 0")
def _(t):
    return t.pages.where(P.search_predicate("exam en", ["url"], "url")).select("page_id", "url")


@query(
    "flt05_exists_chains",
    """SELECT o_orderkey FROM orders o WHERE (EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
       OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45)) AND EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l_partkey = p_partkey WHERE l.l_orderkey = o.o_orderkey AND p_size < 10)""",
)
def _(t):
    li = t.lineitem
    small = li.join(t.part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return P.exists_chains(
        t.orders.select("o_orderkey"), "o_orderkey", [[(li.where("l_returnflag = 'R'"), "l_orderkey"), (li.where("l_quantity > 45"), "l_orderkey")], [(small, "l_orderkey")]]
    )


@query("flt06_array_overlap", "SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['and', 'und'])")
def _(t):
    return t.documents.where(F.arrays_overlap(F.split(F.lower("text"), " "), F.array(F.lit("and"), F.lit("und")))).select("doc_id")


@query(
    "flt07_active_or_unknown",
    """SELECT d.doc_id, coalesce(l.toxic = 1, NULL) AS flagged, (l.toxic = 1) IS NOT TRUE AS kept, coalesce(NOT (l.toxic = 1), false) AS kept_strict
       FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.toxic = 1) IS NOT TRUE""",
)
def _(t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("flagged")), "doc_id", "left")
    return d.withColumns({"kept": P.active("flagged", True), "kept_strict": P.active("flagged", False)}).where("kept")


@query("flt08_longer_than", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 50")
def _(t):
    return t.documents.where(P.longer_than("text", 50)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("flt09_box", "SELECT c_custkey FROM customer WHERE (c_custkey * 37 % 1000) / 10.0 BETWEEN 10 AND 40 AND (c_custkey * 91 % 1000) / 20.0 BETWEEN 5 AND 30")
def _(t):
    box = P.Box.parse("10,5,40,30")
    xy = t.customer.select("c_custkey", (F.col("c_custkey") * 37 % 1000 / 10.0).alias("x"), (F.col("c_custkey") * 91 % 1000 / 20.0).alias("y"))
    return xy.where(box.holds("x", "y")).select("c_custkey")


@query("prj01_bucket", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'detector' WHEN p_name ILIKE '%red%' THEN 'keyword' END AS bucket FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_type") == "PROMO", "detector").when(P.contains_any("p_name", ["red"]), "keyword").alias("bucket"))


@query("prj02_truncate", "SELECT doc_id, left(text, 300) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.left("text", F.lit(300)).alias("head"))


@query(
    "prj03_snippet",
    """WITH a AS (SELECT doc_id, text, strpos(lower(text), 'the ') AS pos FROM documents)
       SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN greatest(pos - 30, 1) > 1 THEN '…' ELSE '' END || substr(text, greatest(pos - 30, 1), 150)
              || CASE WHEN greatest(pos - 30, 1) + 150 <= length(text) THEN '…' ELSE '' END ELSE left(text, 120) END AS snippet FROM a""",
)
def _(t):
    return t.documents.select("doc_id", P.snippet(F.col("text"), "the ").alias("snippet"))


@query("prj04_camel_case", "SELECT o_orderkey AS oOrderkey, o_custkey AS oCustkey, strftime(o_orderdate, '%Y-%m-%d') AS oOrderdate FROM orders")
def _(t):
    return P.camel_case(t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate")))


@query("prj05_listed", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)")
def _(t):
    return t.nation.where(F.col("n_regionkey").isin(*map(int, P.parse_list(" 1, 2,, ")))).select("n_nationkey", "n_name")


@query(
    "set01_tagged_union",
    """(SELECT 'new' AS regime, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
       UNION ALL (SELECT 'old', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)""",
)
def _(t):
    o = t.orders
    part = lambda tag, s: o.where(F.col("o_orderstatus") == s).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.lit(tag).alias("regime"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return part("new", "O").unionByName(part("old", "F"))


@query("set02_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query(
    "set03_union_of_links",
    """SELECT l_orderkey AS id FROM lineitem WHERE l_tax > 0.07 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000
       UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 2
       UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""",
)
def _(t):
    li, o = t.lineitem, t.orders
    parts = [li.where("l_tax > 0.07"), li.where("l_discount > 0.09"), li.where("l_returnflag = 'A' and l_quantity < 2")]
    out = o.where("o_totalprice > 400000 or o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    for p in parts:
        out = out.union(p.select("l_orderkey"))
    return out.distinct()


@query("set04_difference_both_ways", "SELECT 0::BIGINT AS n_left, 0::BIGINT AS n_right")
def _(t):
    a = t.orders.where("o_orderstatus = 'O' and o_totalprice > 100000").select("o_orderkey")
    b = t.orders.where("not (o_orderstatus <> 'O' or o_totalprice <= 100000)").select("o_orderkey")
    return a.exceptAll(b).agg(F.count("*").alias("n_left")).crossJoin(F.broadcast(b.exceptAll(a).agg(F.count("*").alias("n_right"))))  # one row each


@query("set05_array_edit", "SELECT p_partkey, list_prepend('root', list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS words FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat(F.array(F.lit("root")), F.array_remove(F.split("p_name", " "), "")).alias("words"))
