"""Aggregations, facets and reports over the tables."""

from pyspark.sql import functions as F

from dijkstone.operators import aggregates as A
from dijkstone.operators.predicates import Filters
from dijkstone.plans.joining import MUTUAL, PAIRS, pairs
from dijkstone.plans.registry import query


@query("agg01_counts", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT (o_custkey, o_orderpriority)) AS n_pairs FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), A.count_tuples("o_custkey", "o_orderpriority").alias("n_pairs"))


@query("agg02_filtered_counts", "SELECT l_returnflag, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, sum(l_quantity) FILTER (WHERE l_discount = 0) AS plain FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.sum(F.when(F.col("l_discount") == 0, F.col("l_quantity"))).alias("plain"))


@query("agg03_text_list", "SELECT n_regionkey, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) FILTER (WHERE n_nationkey > 4) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(A.text_list("n_name", where=F.col("n_nationkey") > 4).alias("names"))


@query(
    "agg04_ordered_arrays",
    "SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) AS sizes, list_sort(list(DISTINCT role)) AS kinds FROM conversations GROUP BY 1",
)
def _(t):
    c = t.conversations.withColumn("size", F.length("text").cast("long"))
    lists = A.ordered_lists("turn", "role", "size")
    return c.groupBy("conv_id").agg(lists["role"].alias("roles"), lists["size"].alias("sizes"), F.array_sort(F.collect_set("role")).alias("kinds"))


@query("agg05_bool", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS some_open, bool_and(o_totalprice > 50000) AS all_large FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("some_open"), F.bool_and(F.col("o_totalprice") > 50000).alias("all_large"))


@query(
    "agg06_percentiles",
    "SELECT event_type, quantile_disc(value, 0.25) AS p25, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1",
)
def _(t):
    return t.events.groupBy("event_type").agg(*A.quartiles("value"))


@query(
    "agg07_ratios",
    "SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 1)::DOUBLE AS pct, round(avg(o_totalprice), 1) AS mean FROM orders GROUP BY 1",
)
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(A.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("pct"), F.round(F.avg("o_totalprice"), 1).alias("mean"))


@query("agg08_histogram", f"WITH {PAIRS}, h AS (SELECT least(gap_days // 2, 26)::INTEGER AS bin, count(*) AS n FROM p GROUP BY 1) SELECT b::INTEGER AS bin, coalesce(n, 0) AS n FROM range(27) r(b) LEFT JOIN h ON bin = b")
def _(t):
    return A.histogram(pairs(t), "gap_days", 2, 26)


@query("agg09_having", "SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'signup') >= 5 AND count(*) FILTER (WHERE event_type = 'error') <= 15")
def _(t):
    return A.having(t.events, ["user_id"], {"signups": F.col("event_type") == "signup", "errors": F.col("event_type") == "error"}, "signups >= 5 and errors <= 15")


@query(
    "agg10_threshold_ladder",
    f"""WITH {PAIRS}, c AS (SELECT user_id, count(*) AS n, quantile_cont(gap_days, 0.5) AS median FROM p GROUP BY 1), m AS (SELECT max(n) AS most FROM c),
        r AS (SELECT CASE WHEN most >= 500 THEN 500 WHEN most >= 30 THEN 30 WHEN most >= 10 THEN 10 WHEN most >= 5 THEN 5 WHEN most >= 1 THEN 1 END AS threshold FROM m)
        SELECT user_id, n, median, threshold FROM c, r WHERE n >= threshold""",
)
def _(t):
    return A.threshold_ladder(pairs(t), "user_id", "gap_days", 500)


FORM = Filters(one_of={"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, between={"o_totalprice": (50000.0, None)})


@query(
    "agg11_facets",
    """WITH f AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000)
       SELECT 'o_orderstatus' AS dim, o_orderstatus AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM f GROUP BY 2""",
)
def _(t):
    oc = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return A.facets(oc, ["o_orderstatus", "o_orderpriority", "c_mktsegment"], FORM)


@query(
    "agg12_facets_without_own",
    """SELECT 'o_orderstatus' AS dim, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000 GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 50000 GROUP BY 2""",
)
def _(t):
    return A.facets(t.orders, ["o_orderstatus", "o_orderpriority"], FORM, exclude_own=True)


@query("agg13_two_facets", "SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def _(t):
    return A.facets(t.documents, ["lang", "source"], Filters())


@query("agg14_capped_count", "SELECT least(count(*), 10000) AS total, count(*) > 10000 AS total_capped FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 10001)")
def _(t):
    from dijkstone.operators.ranking import capped_count

    return capped_count(t.lineitem.where("l_quantity > 10"), 10000)


@query(
    "agg15_regional_rollup",
    """SELECT r_name, count(c_custkey) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS in_debt, round(100.0 * sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) / nullif(count(c_custkey), 0), 1)::DOUBLE AS pct
       FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _(t):
    c = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    debt = F.count_if(F.col("c_acctbal") < 0)
    return c.groupBy("r_name").agg(F.count("c_custkey").alias("n"), debt.alias("in_debt"), A.percent(debt, F.count("c_custkey")).alias("pct")).orderBy(F.desc_nulls_last("pct"))


@query(
    "agg16_scalar_per_group",
    "SELECT n_nationkey, n_name, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS segments, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
)
def _(t):
    facts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_mktsegment").alias("segments"))
    out = A.rollup_with_parent(facts, "n_nationkey", t.nation.select("n_nationkey", "n_name"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), "suppliers")
    return out.withColumn("segments", F.coalesce("segments", F.lit(0)))


@query("agg17_content_hash", "SELECT source, md5(string_agg(doc_id::VARCHAR || ':' || md5(text), '|' ORDER BY doc_id)) AS hash, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return A.content_hash(t.documents.select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("h")), ["source"], "doc_id", "h")


@query(
    "agg18_notable",
    """(SELECT 'longest' AS fact, doc_id::VARCHAR AS name, n_chars::DOUBLE AS value FROM documents ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 1)
       UNION ALL (SELECT 'shortest', doc_id::VARCHAR, -n_chars::DOUBLE FROM documents ORDER BY n_chars, doc_id::VARCHAR LIMIT 1)""",
)
def _(t):
    return A.notable(t.documents, {"longest": (F.col("doc_id"), F.col("n_chars")), "shortest": (F.col("doc_id"), -F.col("n_chars"))})


@query(
    "agg19_dominant",
    """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
       SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f, lang) AS k FROM c) WHERE k = 1""",
)
def _(t):
    return A.dominant(t.documents, "source", "lang", "doc_id")


@query("agg20_row_counts", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'absent', NULL")
def _(t):
    return A.table_totals(t.spark, ["orders", "lineitem", "absent"], t.base)


@query(
    "agg21_merge_hits",
    """WITH w AS (SELECT l_orderkey, l_returnflag, l_linestatus, max(l_discount) AS part FROM lineitem GROUP BY ALL)
       SELECT l_orderkey, max(l_extendedprice) AS score, list_sort(list(DISTINCT l_partkey)) AS articles, (SELECT string_agg(l_returnflag || l_linestatus || part::DECIMAL(4,2)::VARCHAR, ' ' ORDER BY l_returnflag, l_linestatus) FROM w WHERE w.l_orderkey = l.l_orderkey) AS words
       FROM lineitem l GROUP BY l_orderkey""",
)
def _(t):
    out = A.merge_hits(t.lineitem, ["l_orderkey"], "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "l_partkey")
    return out.withColumn("words", F.array_join(F.transform("words", lambda x: F.concat(x["l_returnflag"], x["l_linestatus"], x["part"].cast("decimal(4,2)").cast("string"))), " "))


@query("agg22_source_totals", "SELECT table_name, n FROM (SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'nowhere', NULL UNION ALL SELECT 'part', count(*) FROM part)")
def _(t):
    return A.table_totals(t.spark, ["customer", "nowhere", "part"], t.base)


@query(
    "mv04_lead_times",
    f"""WITH {PAIRS}, {MUTUAL}, d AS (SELECT t.*, date_trunc('week', b_ts) AS week FROM two t JOIN b USING (b_id) WHERE m = 1)
        SELECT week::TIMESTAMP AS week, count(*) AS n, quantile_disc(gap_days, 0.5) AS p50, quantile_cont(gap_days, 0.5) AS median, round(avg(gap_days), 1) AS mean FROM d GROUP BY 1""",
)
def _(t):
    from dijkstone.operators.joins import mutual_nearest

    b = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), F.date_trunc("week", "ts").alias("week"))
    d = mutual_nearest(pairs(t), "a_id", "b_id", "gap_days").join(b, "b_id")
    half = F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap_days) as bigint)")
    return d.groupBy("week").agg(F.count("*").alias("n"), half.alias("p50"), F.percentile("gap_days", 0.5).alias("median"), F.round(F.avg("gap_days"), 1).alias("mean"))


@query(
    "mv04_two_tiers",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS number FROM events WHERE event_type IN ('signup', 'purchase')),
         cases AS (SELECT user_id, number, min(ts) FILTER (WHERE event_type = 'signup') AS s, min(ts) FILTER (WHERE event_type = 'purchase') AS f FROM e WHERE number IS NOT NULL GROUP BY ALL HAVING s IS NOT NULL AND f IS NOT NULL),
         rest AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM cases WHERE cases.user_id = e.user_id AND cases.number = e.number)),
         p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a.ts AS s, b.ts AS f, date_diff('day', a.ts::DATE, b.ts::DATE) AS gap FROM rest a JOIN rest b USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND a.ts <= b.ts AND gap <= 10),
         one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY gap, a_id) = 1), two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY gap, b_id) = 1),
         c AS (SELECT 'number' AS tier, s, f FROM cases WHERE s <= f UNION ALL SELECT 'nearest', s, f FROM two)
       SELECT tier, date_trunc('quarter', f)::TIMESTAMP AS quarter, count(*) AS n, quantile_cont(date_diff('day', s::DATE, f::DATE), 0.5)::DOUBLE AS median, max(date_diff('day', s::DATE, f::DATE))::INTEGER AS longest FROM c GROUP BY ALL""",
)
def _(t):
    """Cases by their number first, the rest by nearness, by quarter of the decision."""
    from dijkstone.operators.joins import cases_in_tiers

    e = t.events.select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("number"))
    kind = lambda v: e.where(F.col("event_type") == v).drop("event_type")
    c = cases_in_tiers(kind("signup"), kind("purchase"), "user_id", "number", "ts", "event_id", 10).withColumn("gap", F.date_diff("end", "start"))
    return c.groupBy("tier", F.date_trunc("quarter", "end").alias("quarter")).agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("median"), F.max("gap").alias("longest"))
