"""Text, search and scoring over documents, pages, benchmark and embeddings."""

from pyspark.sql import functions as F

from dijkstone.functions import text as X
from dijkstone.operators import scoring as S
from dijkstone.plans.registry import query
from dijkstone.sources.storage import materialize


@query("txt01_strip_tags", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain_hash FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("plain_hash"))


@query(
    "txt02_article_label",
    """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_name END AS heading, CASE WHEN p_partkey % 2 = 0 THEN 'gm01_art_' || p_size || '__lid' ELSE 'gm01_x' END AS wid FROM part)
       SELECT p_partkey, coalesce(nullif(trim(heading), ''), 'Artikel ' || nullif(regexp_extract(wid, 'art_([^_]+)', 1), '')) AS label FROM a""",
)
def _(t):
    k = F.col("p_partkey")
    a = t.part.select("p_partkey", F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_name")).alias("heading"), F.when(k % 2 == 0, F.concat(F.lit("gm01_art_"), F.col("p_size").cast("string"), F.lit("__lid"))).otherwise("gm01_x").alias("wid"))
    return a.select("p_partkey", X.article_label(F.col("heading"), F.col("wid")).alias("label"))


@query("txt03_normal_hash", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", X.normal_hash(F.col("text")).alias("hash"))


TOKENS_SQL = "list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s\\-&]', ' ', 'g')), '\\s+'), lambda w: length(w) > 1)"


@query(
    "txt04_prefix_and_or",
    f"WITH k AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) SELECT doc_id, list_has_any(w, ['und', 'que', 'with']) AS any_word, len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'on'))) > 0 AS all_prefixes FROM k",
)
def _(t):
    k = t.documents.select("doc_id", X.tokens(F.col("text"), []).alias("w"))
    words = lambda *x: F.array(*map(F.lit, x))
    return k.select("doc_id", X.matches_any(F.col("w"), words("und", "que", "with")).alias("any_word"), X.matches_prefixes(F.col("w"), words("the", "on")).alias("all_prefixes"))


@query(
    "txt05_bm25",
    f"""WITH k AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), c AS (SELECT count(*) AS docs, avg(len(w)) AS mean_n FROM k),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM k) WHERE term IN ('shing', 'oder', 'que', 'with', 'thening') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
        SELECT doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n))), 6) AS score FROM tf JOIN df USING (term), c GROUP BY 1""",
)
def _(t):
    k = t.documents.select("doc_id", X.tokens(F.col("text"), []).alias("words"))
    q = t.spark.range(1).select(F.explode(F.array(*map(F.lit, ["shing", "oder", "que", "with", "thening"]))).alias("term"))
    return X.bm25(k, q, "doc_id").withColumn("score", F.round("score", 6))


@query("txt06_or_query", "SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['anders', 'than', 'pour'])")
def _(t):
    return t.documents.where(X.matches_any(F.split(F.lower("text"), " "), F.array(*map(F.lit, ["anders", "than", "pour"])))).select("doc_id")


@query(
    "txt11_tokens",
    f"SELECT item_id, {TOKENS_SQL} AS words FROM benchmark",
)
def _(t):
    return t.benchmark.select("item_id", X.tokens(F.col("text"), []).alias("words"))


@query("txt12_stem_variants", f"SELECT item_id, list_filter(list_transform({TOKENS_SQL}, lambda w: CASE WHEN length(w) < 6 THEN NULL WHEN w LIKE '%en' THEN w[:-3] WHEN w LIKE '%s' THEN w[:-2] END), lambda x: x IS NOT NULL) AS stems FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_compact(F.transform(X.tokens(F.col("text"), []), X.stem_variant)).alias("stems"))


@query("txt13_ngrams")
def _(t):
    return t.benchmark.select("item_id", X.ngrams(X.tokens(F.col("text"), [])).alias("grams"))


@query("txt14_only_action", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'small', 'ring', 'widget'))) = 0 AS only_known FROM part")
def _(t):
    return t.part.select("p_partkey", X.only_action(F.col("p_name"), ["red", "small", "ring", "widget"]).alias("only_known"))


CONCEPTS_SQL = """concepts AS (SELECT p_partkey AS uri, lower(p_name) AS name, p_type AS scheme FROM part), synonyms AS (SELECT p_partkey AS uri, lower(p_brand) AS synonym FROM part WHERE p_size > 25),
  keywords AS (SELECT p_partkey AS uri, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part), terms AS (SELECT DISTINCT lower(p_name) AS term FROM part WHERE p_size < 3 UNION SELECT DISTINCT lower(p_brand) FROM part WHERE p_size = 40 UNION SELECT 'ring' UNION SELECT 'red'),
  every AS (SELECT uri, name AS term, 1 AS source_rank FROM concepts UNION ALL SELECT uri, synonym, 2 FROM synonyms UNION ALL SELECT uri, keyword, 3 FROM keywords),
  m AS (SELECT uri, term, min(source_rank) AS source_rank FROM every JOIN terms USING (term) GROUP BY ALL), freq AS (SELECT term, count(DISTINCT uri) AS freq FROM every GROUP BY 1),
  nk AS (SELECT uri, count(*) AS n_keywords FROM keywords GROUP BY 1),
  s AS (SELECT uri, sum(len(string_split(term, ' ')) * len(string_split(term, ' ')) / (1 + ln(freq)) * CASE source_rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 1 / (1 + ln(n_keywords)) END) AS score FROM m JOIN freq USING (term) LEFT JOIN nk USING (uri) GROUP BY 1),
  b AS (SELECT s.uri, score * CASE WHEN scheme = 'PROMO' THEN 1.5 ELSE 1.0 END AS score FROM s JOIN concepts c ON s.uri = c.uri)"""


def _concepts(t):
    p = t.part
    concepts = p.select(F.col("p_partkey").alias("uri"), F.lower("p_name").alias("name"), F.col("p_type").alias("scheme"))
    synonyms = p.where("p_size > 25").select(F.col("p_partkey").alias("uri"), F.lower("p_brand").alias("synonym"))
    keywords = p.select(F.col("p_partkey").alias("uri"), F.explode(F.split(F.lower("p_name"), " ")).alias("keyword"))
    terms = p.where("p_size < 3").select(F.lower("p_name").alias("term")).union(p.where("p_size = 40").select(F.lower("p_brand"))).union(t.spark.range(1).select(F.explode(F.array(F.lit("ring"), F.lit("red"))))).distinct()
    matches = S.concept_matches(terms, concepts, synonyms, keywords)
    freq = S.term_frequency(concepts, synonyms, keywords)
    n = keywords.groupBy("uri").agg(F.count("*").alias("n_keywords"))
    return matches, freq, S.concept_score(matches, freq, n, concepts.where("scheme = 'PROMO'"))


@query("txt15_concept_matches", f"WITH {CONCEPTS_SQL} SELECT uri, term, source_rank::INTEGER AS source_rank FROM m")
def _(t):
    return _concepts(t)[0]


@query(
    "txt15_preselected",
    f"""WITH {CONCEPTS_SQL} SELECT uri, list_sort(list(DISTINCT term)) AS terms, min(source_rank)::INTEGER AS source_rank, count(DISTINCT term)::INTEGER AS n_terms FROM m
        WHERE uri IN (SELECT uri FROM concepts WHERE scheme IN ('PROMO', 'ECONOMY')) GROUP BY 1 ORDER BY n_terms DESC, source_rank, uri LIMIT 160""",
)
def _(t):
    """At most four times the forty that are shown."""
    concepts = t.part.select(F.col("p_partkey").alias("uri"), F.col("p_type").alias("scheme"))
    return S.preselected(_concepts(t)[0], concepts, ["PROMO", "ECONOMY"], 160)


@query("txt16_concept_scores", f"WITH {CONCEPTS_SQL} SELECT uri, round(score, 6) AS score FROM b")
def _(t):
    return _concepts(t)[2].withColumn("score", F.round("score", 6))


@query("txt17_relative_cutoff", f"WITH {CONCEPTS_SQL} SELECT uri, round(score, 6) AS score FROM b WHERE score >= 0.35 * (SELECT max(score) FROM b)")
def _(t):
    return S.relative_cutoff(_concepts(t)[2], "score", S.CONCEPT_CUTOFF).withColumn("score", F.round("score", 6))


@query("txt18_term_frequency", f"WITH {CONCEPTS_SQL} SELECT * FROM freq")
def _(t):
    return _concepts(t)[1]


@query(
    "txt19_weighted_keywords",
    """WITH e AS (SELECT p_name AS term, 1.0 AS weight, 0 AS o FROM part WHERE p_size = 1 UNION SELECT p_brand, 0.8, 1 FROM part UNION SELECT p_name, 0.6, 2 FROM part WHERE p_size < 5)
       SELECT term, arg_min(weight, o)::DOUBLE AS weight FROM e GROUP BY 1""",
)
def _(t):
    p = t.part
    part = lambda d, c: d.select(F.col(c).alias("term"))
    return S.weighted_keywords([(part(p.where("p_size = 1"), "p_name"), 1.0), (part(p, "p_brand"), 0.8), (part(p.where("p_size < 5"), "p_name"), 0.6)])


@query("txt20_chips", f"WITH {CONCEPTS_SQL} SELECT term, freq FROM freq WHERE contains(term, ' ') OR freq <= 80")
def _(t):
    return S.chips(_concepts(t)[1].withColumn("action", F.lit(False)), 80).select("term", "freq")


@query("txt21_longest_definition", "SELECT source, text_hash FROM (SELECT source, md5(text) AS text_hash, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1")
def _(t):
    from dijkstone.operators.ranking import first_per_key

    first = first_per_key(t.documents, ["source"], [F.desc(F.length("text")), F.col("doc_id")])
    return first.select("source", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@query(
    "txt23_field_score",
    """WITH k(term, weight) AS (VALUES ('red', 1.0), ('ring', 0.5), ('rge', 0.8)), x AS (SELECT p_partkey, weight, term,
         greatest(1.0 * CASE WHEN regexp_matches(p_name, '(?i)(^|\\W)' || term || '($|\\W)') THEN 1.0 WHEN contains(lower(p_name), term) THEN 0.7 ELSE 0 END, 0.5 * CASE WHEN regexp_matches(p_type, '(?i)(^|\\W)' || term || '($|\\W)') THEN 1.0 WHEN contains(lower(p_type), term) THEN 0.7 ELSE 0 END) AS best FROM part, k)
       SELECT p_partkey, round(sum(weight * best), 6)::DOUBLE AS score, list_sort(list(DISTINCT term)) AS terms FROM x WHERE weight * best > 0 GROUP BY 1""",
)
def _(t):
    words = S.keyword_table(t.spark, S.parse_weighted("red, ring:0.5, rge:0.8, bad:x:y, zero:0"))
    return S.field_score(t.part, words, {"p_name": 1.0, "p_type": 0.5}, "p_partkey").withColumn("score", F.round("score", 6))


@query("txt25_composite_score", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(0.5 * l_discount + 0.5 * l_tax, 4) AS score FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.composite_score(F.col("l_discount"), F.col("l_tax")).alias("score"))


@query("txt26_term_weight", f"WITH {CONCEPTS_SQL} SELECT term, round(CASE WHEN length(term) > 6 THEN 1.0 ELSE 0.5 END / (1 + ln(freq)) * 0.8, 6)::DOUBLE AS weight FROM freq")
def _(t):
    return _concepts(t)[1].select("term", F.round(S.term_weight(F.length("term") > 6, F.col("freq"), F.lit(0.8)), 6).alias("weight"))


@query(
    "txt27_score_and_cut",
    "WITH g AS (SELECT p_partkey, p_retailprice AS score FROM part WHERE p_type = 'PROMO') SELECT p_partkey, score FROM g WHERE score >= 0.4 * (SELECT max(score) FROM g) ORDER BY score DESC, p_partkey LIMIT 20",
)
def _(t):
    rows = t.part.select("p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_type") == "PROMO").alias("hit"))
    return S.score_and_cut(rows, "score", "hit", 20, "p_partkey").drop("hit")


DENSE_SQL = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  dense AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 12) DESC, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 60),
  words AS (SELECT doc_id AS vec_id, len(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'and', 'of'))) AS hits FROM documents SEMI JOIN embeddings ON doc_id = vec_id),
  sparse AS (SELECT vec_id, row_number() OVER (ORDER BY hits DESC, vec_id) AS rank FROM words WHERE hits > 0 QUALIFY rank <= 60)"""


def _lists(t):
    from pyspark.sql import Window

    e = t.embeddings
    q = e.orderBy("vec_id").limit(1)
    scored = e.crossJoin(F.broadcast(q.select(F.col("embedding").alias("q")))).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 12).alias("c"))  # one row
    dense = scored.orderBy(F.desc("c"), "vec_id").limit(60).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "vec_id"))).select("vec_id", "rank")
    hits = F.size(F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "and", "of")))
    words = t.documents.select(F.col("doc_id").alias("vec_id"), hits.alias("hits")).join(e.select("vec_id"), "vec_id", "left_semi").where("hits > 0")
    sparse = words.orderBy(F.desc("hits"), "vec_id").limit(60).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "vec_id"))).select("vec_id", "rank")
    return dense, sparse


@query("txt31_dense_list", f"WITH {DENSE_SQL} SELECT vec_id, rank FROM dense")
def _(t):
    return _lists(t)[0]


@query(
    "txt31_hybrid",
    f"WITH {DENSE_SQL} SELECT vec_id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY 1",
)
def _(t):
    dense, sparse = _lists(t)
    return S.fuse_ranks({"dense": dense, "sparse": sparse}, "vec_id").withColumn("score", F.round("score", 9))


@query(
    "txt31_retrieval",
    f"""WITH {DENSE_SQL}, f AS (SELECT vec_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY 1),
        g AS (SELECT vec_id, source, round(s * CASE WHEN lang = 'en' THEN 0.55 ELSE 1.0 END, 9)::DOUBLE AS score FROM f JOIN documents ON doc_id = vec_id),
        w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS group_rank FROM g QUALIFY group_rank <= 8), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS overall_rank FROM w)
        SELECT vec_id, source, score FROM r ORDER BY CASE WHEN overall_rank <= 10 THEN overall_rank ELSE 11 END, CASE WHEN overall_rank > 10 THEN group_rank ELSE 0 END, overall_rank LIMIT 20""",
)
def _(t):
    """Dense and sparse ranks fused, one tier weighted less, at most eight of a source: the best ten, then ten by turns."""
    from dijkstone.operators.ranking import two_rankings

    dense, sparse = _lists(t)
    fused = S.fuse_ranks({"dense": dense, "sparse": sparse}, "vec_id").join(t.documents.select(F.col("doc_id").alias("vec_id"), "source", "lang"), "vec_id")
    weight = F.when(F.col("lang") == "en", S.CENTRAL_TIER_WEIGHT).otherwise(1.0)
    scored = fused.withColumn("score", F.round(F.col("score") * weight, 9))
    return two_rankings(scored, "source", F.col("score"), [F.col("vec_id")], 8, 20).select("vec_id", "source", "score")


@query("txt32_covered_or_definition", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) OR lang = 'es'")
def _(t):
    d = t.documents.select("doc_id", "lang")
    return d.join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id").union(d.where("lang = 'es'").select("doc_id")).distinct()


@query(
    "txt33_vocabulary_match",
    """WITH v AS (SELECT n_name AS entry, unnest(string_split(lower(n_name), '_')) AS w FROM nation), n AS (SELECT entry, count(DISTINCT w) AS n FROM v GROUP BY 1),
       k AS (SELECT DISTINCT p_partkey, unnest(list_concat(string_split(p_name, ' '), ['nation', (p_size)::VARCHAR])) AS w FROM part)
       SELECT p_partkey, entry, count(*) / n AS score FROM k JOIN (SELECT DISTINCT * FROM v) USING (w) JOIN n USING (entry) GROUP BY p_partkey, entry, n HAVING count(*) / n > 0.5""",
)
def _(t):
    texts = t.part.select("p_partkey", F.concat(F.split("p_name", " "), F.array(F.lit("nation"), F.col("p_size").cast("string"))).alias("w"))
    vocabulary = t.nation.select(F.col("n_name").alias("entry"), F.split(F.lower("n_name"), "_").alias("entry_words"))
    return S.match_vocabulary(texts, vocabulary, "p_partkey", "w", 0.51)


@query(
    "txt34_word_overlap",
    f"""WITH a AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), b AS (SELECT item_id, {TOKENS_SQL} AS w FROM benchmark),
        x AS (SELECT DISTINCT doc_id, unnest(w) AS t FROM a), y AS (SELECT DISTINCT item_id, unnest(w) AS t FROM b), n AS (SELECT item_id, count(*) AS n FROM y WHERE length(t) >= 4 GROUP BY 1)
        SELECT item_id, doc_id, count(*) AS shared FROM y JOIN x USING (t) JOIN n USING (item_id) WHERE length(t) >= 4 GROUP BY item_id, doc_id, n HAVING count(*) > greatest(5, 0.3 * n)""",
)
def _(t):
    a = t.documents.select("doc_id", X.tokens(F.col("text"), []).alias("w"))
    b = t.benchmark.select("item_id", X.tokens(F.col("text"), []).alias("w"))
    return S.word_overlap(b, a, "item_id", "doc_id", "w")


@query(
    "txt35_nearest_centroid",
    """WITH m AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL) GROUP BY 1)
       SELECT vec_id, arg_max(m.label, (round(list_cosine_similarity(embedding::DOUBLE[], c), 9), -m.label)) AS nearest FROM embeddings e, m GROUP BY 1""",
)
def _(t):
    return S.nearest_centroid(t.embeddings, "embedding", "vec_id", "label").select("vec_id", "nearest")


@query("txt36_topics")
def _(t):
    """Clusters of texts, equal ones once: hashed TF-IDF, reduced dimensions, k-means (density clustering has no built-in counterpart)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import HashingTF, IDF, Normalizer

    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    words = t.documents.select("doc_id", X.tokens(F.col("text"), []).alias("w"))
    # Counts of hashed words are shuffled and written once, instead of all words for each pass of the fit.
    once = materialize(HashingTF(inputCol="w", outputCol="tf", numFeatures=1024).transform(words).drop("w").join(first, "doc_id", "left_semi"), "topics")
    steps = [IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="unit"), KMeans(featuresCol="unit", predictionCol="topic", k=8, seed=1, maxIter=10)]
    return Pipeline(stages=steps).fit(once).transform(once).select("doc_id", "topic")


@query("txt37_greedy_context", "SELECT * FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id)::BIGINT AS used FROM documents) WHERE used <= 6000")
def _(t):
    return X.greedy_context(t.documents.select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"], "n_chars").select("source", "doc_id", "used")


@query("txt38_markdown_chunks", "SELECT doc_id, (i - 1)::INTEGER AS ord, length(trim(p)) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE length(trim(p)) >= 50 AND i = 1")
def _(t):
    md = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## Kop\n")).alias("text"))
    return X.markdown_chunks(md, "text", ["Kop"]).select("doc_id", "ord", F.length("content").cast("long").alias("n"))


@query("txt39_confidence", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN least((c_custkey % 150) / 100, 1.0) END::DOUBLE AS confidence FROM customer WHERE c_custkey % 150 > 1")
def _(t):
    c = t.customer.where("c_custkey % 150 > 1")
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Antwoord. Zekerheid: "), (F.col("c_custkey") % 150).cast("string"), F.lit("%"))).otherwise("Antwoord.")
    return c.select("c_custkey", X.confidence(said).alias("confidence"))
