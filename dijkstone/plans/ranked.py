"""Windows, rankings and paging over the tables."""

from pyspark.sql import functions as F

from dijkstone.operators import ranking as R
from dijkstone.plans.registry import query

ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "win01_top_per_bucket",
    """SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem)
       WHERE rank <= CASE WHEN l_returnflag = 'R' THEN 15 ELSE 5 END""",
)
def _(t):
    out = R.top_per_bucket(t.lineitem, "l_returnflag", [F.col("l_extendedprice").desc_nulls_last(), *map(F.col, ITEM[:4])], {"R": 15})
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(
    "win02_distinct_then_rank",
    """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1)
       SELECT l_returnflag, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM d) WHERE rank <= 10""",
)
def _(t):
    tie = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    out = R.distinct_then_rank(t.lineitem, ["l_returnflag", "l_partkey"], tie, "l_returnflag", [F.desc("l_extendedprice"), F.col("l_partkey")], 10)
    return out.select("l_returnflag", "l_partkey", "l_extendedprice", "rank")


@query("win03_latest_per_key", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _(t):
    return R.first_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "win04_two_rankings",
    """WITH g AS (SELECT * FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS group_rank FROM documents) WHERE group_rank <= 3),
       o AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS overall_rank FROM g)
       SELECT doc_id, source, n_chars, group_rank, overall_rank FROM o ORDER BY CASE WHEN overall_rank <= 10 THEN overall_rank ELSE 11 END, CASE WHEN overall_rank > 10 THEN group_rank ELSE 0 END, overall_rank LIMIT 20""",
)
def _(t):
    return R.two_rankings(t.documents.select("doc_id", "source", "n_chars"), "source", F.col("n_chars"), [F.col("doc_id")], 3, 20)


@query(
    "win05_remove_duplicates",
    "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2",
)
def _(t):
    return R.remove_duplicates(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])


@query(
    "win06_run_signals",
    """WITH r AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT *, n - lag(n) OVER w AS growth, lag(n) OVER w AS prev FROM r WINDOW w AS (PARTITION BY event_type ORDER BY day))
       SELECT event_type, day, n, growth, coalesce(growth < -0.1 * prev, false) AS dropped, sum(CASE WHEN coalesce(growth, 1) <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS stagnant FROM g""",
)
def _(t):
    runs = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return R.stagnation(runs, ["event_type"], "day", "n")


@query(
    "win07_ranks_of_two_lists",
    """SELECT * FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS by_price, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS by_size FROM part) WHERE by_price <= 10 OR by_size <= 10""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand")
    ranked = t.part.select("p_partkey", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("by_price"), F.row_number().over(w.orderBy("p_size", "p_partkey")).alias("by_size"))
    return ranked.where("by_price <= 10 or by_size <= 10")


@query("top01_sorted", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40")
def _(t):
    return R.page(R.sort_by(t.customer.select("c_custkey", "c_acctbal"), {"balance": ("c_acctbal", False), "name": ("c_name", True)}, "balance", "c_custkey"), 40)


@query(
    "top02_order_page",
    """SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000
       ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50""",
)
def _(t):
    from dijkstone.plans.counting import FORM

    rows = FORM.apply(t.orders).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return R.page(R.sort_by(rows, {"date": ("o_orderdate", False)}, "date", "o_orderkey"), 25, 50).select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", "c_name")


@query(
    "top03_case_rank",
    "SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END, event_id LIMIT 3000",
)
def _(t):
    return t.events.select("event_id", "event_type").orderBy(R.case_rank("event_type", ["error", "purchase", "signup"]), "event_id").limit(3000)


@query(
    "top04_preference",
    "SELECT o_custkey, arg_min(o_orderkey, (coalesce(list_position(['5-LOW', '1-URGENT'], o_orderpriority), 3), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
)
def _(t):
    return R.first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [R.prefer("o_orderpriority", ["5-LOW", "1-URGENT"]), F.col("o_orderkey")]).drop("o_orderpriority")


@query("top05_by_hits", "SELECT doc_id, (length(text) - length(replace(lower(text), 'the ', ''))) // 4 AS hits FROM documents ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    hits = F.expr("(length(text) - length(replace(lower(text), 'the ', ''))) div 4")
    return t.documents.select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(50)


@query("top06_capped_rows", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) > 2000 AS truncated FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 2000")
def _(t):
    rows, more = R.capped(t.orders.where("o_totalprice > 1000"), [F.desc("o_orderdate"), F.col("o_orderkey")], 2000)
    return rows.select("o_orderkey", F.lit(more).alias("truncated"))


@query("top07_total_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' ORDER BY 1, 2, 3 LIMIT 200")
def _(t):
    return t.lineitem.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(200)


@query(
    "top08_version_order",
    """WITH v AS (SELECT doc_id % 50 AS work, 'w' || (doc_id % 50)::VARCHAR || '@' || (doc_id % 13)::VARCHAR || '-' || (doc_id % 7)::VARCHAR AS expression, doc_id FROM documents)
       SELECT work, arg_max(expression, (doc_id % 13, doc_id % 7)) AS newest FROM v GROUP BY 1""",
)
def _(t):
    d = F.col("doc_id")
    v = t.documents.select((d % 50).alias("work"), F.concat(F.lit("w"), (d % 50).cast("string"), F.lit("@"), (d % 13).cast("string"), F.lit("-"), (d % 7).cast("string")).alias("newest"))
    return R.first_per_key(v.distinct(), ["work"], [R.version_key(F.col("newest")).desc()]).select("work", "newest")
