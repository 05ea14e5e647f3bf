"""Incremental loads over the tables: sweeps, upserts, change sets, dirty sets."""

from pyspark.sql import functions as F

from dijkstone.sources import incremental as I
from dijkstone.sources import tables as T
from dijkstone.plans.registry import query


@query(
    "src02_delta_sweep",
    "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('view', 'click')) WHERE n = 1",
)
def _(t):
    out = I.delta_sweep(t.events, "user_id", "ts", "event_id", F.lit("2024-01-10").cast("timestamp_ntz") if dict(t.events.dtypes)["ts"] == "timestamp_ntz" else F.lit("2024-01-10").cast("timestamp"), F.col("event_type").isin("view", "click"))
    return out.select("user_id", "event_id", "ts")


@query(
    "src03_load_status",
    "SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars <= 600) AS n_failed, CASE WHEN count(*) FILTER (WHERE n_chars <= 600) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE n_chars <= 600) = count(*) THEN 'gefaald' ELSE 'deels' END AS status FROM documents GROUP BY 1",
)
def _(t):
    return I.load_status(t.documents.withColumn("ok", F.col("n_chars") > 600), "source", "ok")


@query("src12_gap_fill", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN -1.0 END) AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    c = t.customer
    now = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    past = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(-1.0).alias("v"))
    return I.gap_fill(c.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", [(now, "v"), (past, "v")])


@query("src20_late_dimension", "SELECT c_custkey, c_mktsegment AS kind FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'Onbekend' FROM orders WHERE o_custkey % 10 = 0")
def _(t):
    known = t.customer.where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_mktsegment").alias("kind"))
    return T.late_dimension(known, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("src21_fallback_rows", "SELECT doc_id, value, len(a) = 0 AS from_fallback FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [lang, source] END AS a, [source] AS b FROM documents), unnest(CASE WHEN len(a) = 0 THEN b ELSE a END) u(value)")
def _(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("a"), F.array("source").alias("b"))
    return T.fallback_rows(d, "a", "b").select("doc_id", "value", "from_fallback")


@query("src22_first_reference", "SELECT conv_id, list(role ORDER BY turn)[1] AS first_role FROM conversations GROUP BY 1")
def _(t):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return lists.select("conv_id", T.first_reference(F.col("r.role")).alias("first_role"))


@query("src24_skip_known", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return I.skip_known(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


CHANGES = "ch AS (SELECT event_id % 1500 AS c_custkey, CASE event_type WHEN 'signup' THEN 'toevoegen' WHEN 'error' THEN 'verwijderen' WHEN 'view' THEN NULL ELSE 'wijzigen' END AS op, value AS c_acctbal, event_id FROM events)"


@query(
    "src25_change_set",
    f"""WITH {CHANGES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY event_id DESC) AS n FROM ch WHERE op IS NOT NULL) WHERE n = 1)
        SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l) UNION ALL SELECT c_custkey, c_acctbal FROM l WHERE op <> 'verwijderen'""",
)
def _(t):
    e = t.events
    op = F.when(F.col("event_type") == "signup", "toevoegen").when(F.col("event_type") == "error", "verwijderen").when(F.col("event_type") != "view", "wijzigen")
    changes = e.select((F.col("event_id") % 1500).alias("c_custkey"), op.alias("op"), F.col("value").alias("c_acctbal"), "event_id")
    return I.apply_changes(t.customer.select("c_custkey", "c_acctbal"), changes, "c_custkey", "op", "event_id")


def _halves(t):
    c = t.customer
    return c.where("c_custkey < 1000").select("c_custkey", "c_acctbal"), c.where("c_custkey >= 500").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))


@query("snk01_insert_or_keep", "SELECT c_custkey, CASE WHEN c_custkey < 1000 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer")
def _(t):
    return I.upsert(*_halves(t), ["c_custkey"], "nothing")


@query("snk01_insert_or_replace", "SELECT c_custkey, CASE WHEN c_custkey < 500 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer")
def _(t):
    return I.upsert(*_halves(t), ["c_custkey"], "update")


@query("snk01_insert_or_fill", "SELECT c_custkey, CASE WHEN c_custkey >= 500 AND c_custkey % 2 = 0 THEN c_acctbal + 1 WHEN c_custkey < 1000 THEN c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return I.upsert(*_halves(t), ["c_custkey"], "fill")


@query("snk04_features", "SELECT c_custkey, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || c_custkey || ',' || c_nationkey || ']},\"properties\":{\"c_mktsegment\":\"' || c_mktsegment || '\"}}' AS feature FROM customer")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_custkey").alias("x"), F.col("c_nationkey").cast("long").alias("y"), "c_mktsegment")
    return c.select("c_custkey", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct("c_mktsegment").alias("properties"))).alias("feature"))


@query(
    "inc01_dirty_set",
    """WITH cur AS (SELECT source || lang AS scope, md5(string_agg(doc_id::VARCHAR || ':' || md5(text), '|' ORDER BY doc_id)) AS hash FROM documents WHERE lang <> 'es' GROUP BY 1),
       old AS (SELECT source || lang AS scope, md5(string_agg(doc_id::VARCHAR || ':' || md5(CASE WHEN doc_id % 50 = 7 THEN 'x' ELSE text END), '|' ORDER BY doc_id)) AS hash FROM documents WHERE lang <> 'fr' GROUP BY 1)
       SELECT scope, CASE WHEN o.hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN 'orphan' ELSE 'changed' END AS state FROM cur c FULL JOIN old o USING (scope) WHERE c.hash IS DISTINCT FROM o.hash""",
)
def _(t):
    from dijkstone.operators.aggregates import content_hash

    d = t.documents.select(F.concat("source", "lang").alias("scope"), "doc_id", "lang", "text")
    digest = lambda c: F.md5(c.cast("binary"))
    now = content_hash(d.where("lang <> 'es'").withColumn("h", digest(F.col("text"))), ["scope"], "doc_id", "h")
    then = content_hash(d.where("lang <> 'fr'").withColumn("h", digest(F.when(F.col("doc_id") % 50 == 7, "x").otherwise(F.col("text")))), ["scope"], "doc_id", "h")
    return I.dirty_set(now, then, ["scope"])


@query("inc02_pending_days", "SELECT DISTINCT ts::DATE AS day FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events GROUP BY 1 HAVING count(*) > 330)")
def _(t):
    per_day = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return I.pending_days(per_day.select("day"), per_day.where("n > 330").withColumn("status", F.lit("ok")))


@query(
    "inc03_presence",
    "WITH u AS (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY 1) SELECT user_id, d::DATE AS axis, d::DATE BETWEEN a AND b AS present FROM u, generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 2 MONTH) g(d)",
)
def _(t):
    u = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return I.presence(u, "user_id", "a", "b", "2023-11-01", "2024-03-01")


@query("inc04_window_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
