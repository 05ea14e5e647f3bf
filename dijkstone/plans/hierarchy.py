"""Trees over the tables: regions, nations, customers and orders as one hierarchy, and conversations as ordered trees."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dijkstone.operators import patches as P
from dijkstone.operators import trees as T
from dijkstone.plans.registry import query

NODES_SQL = """nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 'region' AS kind, r_name AS heading, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', n_name, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, c_custkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order', NULL, o_orderkey FROM orders)"""


def nodes(t) -> DataFrame:
    def part(df, p, key, up, kind, heading):
        parent = F.concat(F.lit(up[0]), F.col(up[1]).cast("string")) if up else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), heading.cast("string").alias("heading"), F.col(key).cast("long").alias("ord"))

    blank = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    parts = [
        part(t.region, "r", "r_regionkey", None, "region", F.col("r_name")),
        part(t.nation, "n", "n_nationkey", ("r", "n_regionkey"), "nation", F.col("n_name")),
        part(t.customer, "c", "c_custkey", ("n", "c_nationkey"), "customer", blank),
        part(t.orders, "o", "o_orderkey", ("c", "o_custkey"), "order", F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, parts)


UP_SQL = f"""WITH RECURSIVE {NODES_SQL}, up AS (
  SELECT id, parent_id AS ancestor, 1 AS depth FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT up.id, n.parent_id, depth + 1 FROM up JOIN nodes n ON up.ancestor = n.id WHERE n.parent_id IS NOT NULL AND depth < 25)"""


@query("tree00_ancestors", UP_SQL + " SELECT id, ancestor, depth::INTEGER AS depth FROM up")
def _(t):
    return T.ancestors(nodes(t))


@query(
    "tree01_nearest_kinds",
    UP_SQL + """, own AS (SELECT id, id AS ancestor FROM nodes UNION ALL SELECT id, ancestor FROM up)
    SELECT o.id, max(CASE WHEN n.kind = 'nation' THEN n.id END) AS nation, max(CASE WHEN n.kind = 'customer' THEN n.id END) AS customer FROM own o JOIN nodes n ON o.ancestor = n.id GROUP BY 1
    HAVING max(CASE WHEN n.kind IN ('nation', 'customer') THEN 1 END) = 1""",
)
def _(t):
    return T.nearest_of_kind(nodes(t), ["nation", "customer"], ["heading"]).select("id", F.col("nation.id").alias("nation"), F.col("customer.id").alias("customer"))


@query(
    "tree02_subtree_text",
    UP_SQL + """, rows AS (SELECT ancestor AS root, id, depth FROM up WHERE ancestor LIKE 'n%' UNION ALL SELECT id, id, 0 FROM nodes WHERE kind = 'nation')
    SELECT root, md5(string_agg(heading, ' ' ORDER BY r.depth, ord, n.id)) AS text_hash FROM rows r JOIN nodes n USING (id) WHERE heading IS NOT NULL GROUP BY 1""",
)
def _(t):
    n = nodes(t)
    return T.subtree_text(n, n.where("kind = 'nation'").select(F.col("id").alias("root")), "heading", "ord").select("root", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@query(
    "tree03_descendants_or",
    UP_SQL + """, found AS (SELECT ancestor AS root, id FROM up WHERE ancestor LIKE 'c%' AND id LIKE 'o%'), c AS (SELECT id AS root FROM nodes WHERE kind = 'customer')
    SELECT * FROM found UNION ALL SELECT root, root FROM c WHERE root NOT IN (SELECT root FROM found)""",
)
def _(t):
    n = nodes(t)
    roots = n.where("kind = 'customer'").select(F.col("id").alias("root"))
    return T.descendants_or(n, roots, "order", roots.withColumn("id", F.col("root")))


@query(
    "tree04_most_specific",
    UP_SQL + """, hits AS (SELECT c_custkey % 40 AS point, 'c' || c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey % 40, 'n' || c_nationkey FROM customer WHERE c_custkey % 9 = 0),
    h AS (SELECT DISTINCT * FROM hits) SELECT point, id FROM h WHERE NOT EXISTS (SELECT 1 FROM h o JOIN up ON up.id = o.id WHERE o.point = h.point AND up.ancestor = h.id)""",
)
def _(t):
    c = t.customer
    one = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") % 40).alias("point"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    two = c.where("c_custkey % 9 = 0").select((F.col("c_custkey") % 40).alias("point"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"))
    return T.most_specific(one.unionByName(two).distinct(), nodes(t), ["point"])


@query(
    "tree05_heading_paths",
    UP_SQL + """, own AS (SELECT id, id AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT id, ancestor, depth FROM up)
    SELECT o.id, coalesce(string_agg(n.heading, ' > ' ORDER BY o.depth DESC) FILTER (WHERE coalesce(n.heading, '') <> ''), '') AS path, max(o.depth)::INTEGER AS depth FROM own o JOIN nodes n ON o.ancestor = n.id GROUP BY 1""",
)
def _(t):
    return T.heading_paths(nodes(t), "heading")


@query("tree06_flagged_subtrees", UP_SQL + " SELECT id, id IN ('n3', 'n7') OR id IN (SELECT id FROM up WHERE ancestor IN ('n3', 'n7')) AS flagged FROM nodes")
def _(t):
    return T.flag_subtrees(nodes(t), F.col("id").isin("n3", "n7"), "flagged").select("id", "flagged")


@query("tree07_changed_nodes", UP_SQL + ", c AS (SELECT id FROM nodes WHERE kind = 'order' AND ord % 997 = 0) SELECT id FROM c UNION SELECT ancestor FROM up WHERE id IN (SELECT id FROM c)")
def _(t):
    return T.changed_with_ancestors(nodes(t), (F.col("kind") == "order") & (F.col("ord") % 997 == 0)).select("id")


@query("tree08_article_of_change", UP_SQL + " SELECT u.id, n.id AS article FROM up u JOIN nodes n ON u.ancestor = n.id WHERE n.kind = 'customer' AND u.id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    n = nodes(t)
    changed = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return T.climb(n, changed).join(n.where("kind = 'customer'").select(F.col("id").alias("ancestor")), "ancestor").select("id", F.col("ancestor").alias("article"))


@query(
    "tree09_print_order",
    UP_SQL + """, own AS (SELECT id, id AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT id, ancestor, depth FROM up)
    SELECT o.id, max(o.depth)::INTEGER AS depth, string_agg(lpad(n.ord::VARCHAR, 12, '0'), '/' ORDER BY o.depth DESC) AS place FROM own o JOIN nodes n ON o.ancestor = n.id GROUP BY 1""",
)
def _(t):
    return T.nested_order(nodes(t), "ord")


@query(
    "tree10_annotation_paths",
    """SELECT DISTINCT * FROM (SELECT l_orderkey AS annotation, 'c' || o_custkey AS article, 'existing' AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       UNION ALL SELECT o_orderkey, 'c' || o_custkey, 'delta' FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t):
    n = nodes(t)
    articles = T.nearest_of_kind(n, ["customer"], []).select("id", F.col("customer.id").alias("article")).where("article is not null")
    element = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("element")
    bound = {
        "existing": t.lineitem.select(F.col("l_orderkey").alias("annotation"), element("l_orderkey")),
        "delta": t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("annotation"), element("o_orderkey")),
    }
    return T.annotation_articles(bound, articles)


@query(
    "tree11_roots_and_labels",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn - 1 END AS up FROM conversations),
       r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM c WHERE up IS NULL OR up NOT IN (SELECT turn FROM c c2 WHERE c2.conv_id = c.conv_id) UNION ALL SELECT c.conv_id, c.turn, r.root, depth + 1 FROM c JOIN r ON c.conv_id = r.conv_id AND c.up = r.turn)
       SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + root AS root, depth::INTEGER AS depth FROM r""",
)
def _(t):
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 != 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"))
    return T.roots_of(c)


@query(
    "tree11_unique_labels",
    "SELECT conv_id, turn, CASE WHEN n > 1 THEN role || '__' || n ELSE role END AS label_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)",
)
def _(t):
    return T.unique_labels(t.conversations, ["conv_id"], "role", "turn").select("conv_id", "turn", "label_id")


EDITS_SQL = """edits AS (SELECT id, parent_id, heading, op, rank, event_id % 2 + 1 AS version FROM (
  SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'signup' THEN 1 END AS rank, event_type AS op,
         CASE WHEN event_type = 'signup' THEN 'x' || event_id WHEN event_id % 10 = 0 THEN 'n' || user_id % 25 ELSE 'c' || (event_id % 1500 + 1) END AS id,
         CASE WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'r' || event_id % 5 WHEN event_type = 'click' THEN 'n' || user_id % 25 ELSE 'n' || user_id % 30 END AS parent_id, 'h' || event_id % 7 AS heading
  FROM events WHERE event_id % 3 = 0 OR event_type = 'signup') WHERE rank IS NOT NULL AND (rank < 3 OR id LIKE 'c%'))"""


def _version_sql(k, before):
    """One version over the table ``before``: what is put, what dies below the removed, what is lost without a parent."""
    return f"""
  p{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, parent_id DESC, heading DESC) AS n FROM edits WHERE version = {k}) WHERE n = 1),
  kept{k} AS (SELECT * FROM {before} WHERE id NOT IN (SELECT id FROM p{k} WHERE rank < 3)),
  dead{k}(id) AS (SELECT id FROM p{k} WHERE rank = 3 UNION SELECT t.id FROM kept{k} t JOIN dead{k} d ON t.parent_id = d.id),
  after{k} AS (SELECT * FROM kept{k} WHERE id NOT IN (SELECT id FROM dead{k}) UNION ALL SELECT id, parent_id, heading FROM p{k} WHERE rank < 3),
  lost{k}(id) AS (SELECT a.id FROM after{k} a JOIN p{k} USING (id) WHERE a.parent_id NOT IN (SELECT id FROM after{k}) UNION SELECT c.id FROM after{k} c JOIN lost{k} l ON c.parent_id = l.id),
  tree{k} AS (SELECT * FROM after{k} WHERE id NOT IN (SELECT id FROM lost{k}))"""


@query("src17_patched_tree", f"WITH RECURSIVE {NODES_SQL}, tree0 AS (SELECT id, parent_id, heading FROM nodes), {EDITS_SQL}, {_version_sql(1, 'tree0')}, {_version_sql(2, 'tree1')} SELECT * FROM tree2")
def _(t):
    """The hierarchy after two versions of additions, changes and removals; views of an event are context and change nothing."""
    e, kind = t.events.where("event_id % 3 = 0 or event_type = 'signup'"), F.col("event_type")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    tenth, user = F.col("event_id") % 10 == 0, F.col("user_id")
    patches = e.select(
        F.when(kind == "signup", named("x", F.col("event_id"))).when(tenth, named("n", user % 25)).otherwise(named("c", F.col("event_id") % 1500 + 1)).alias("id"),
        F.when((kind == "click") & tenth, named("r", F.col("event_id") % 5)).when(kind == "click", named("n", user % 25)).otherwise(named("n", user % 30)).alias("parent_id"),
        named("h", F.col("event_id") % 7).alias("heading"),
        F.when(kind == "error", P.REMOVE).when(kind == "click", P.CHANGE).when(kind == "signup", P.ADD).alias("op"),
        (F.col("event_id") % 2 + 1).alias("version"),
    )
    patches = patches.where((F.col("op") != P.REMOVE) | F.startswith(F.col("id"), F.lit("c")))
    return P.replay(nodes(t).select("id", "parent_id", "heading"), patches)
