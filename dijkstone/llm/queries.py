"""The operators of this package applied to whole tables: ``QUERIES`` and ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dijkstone.llm import alignment, chat, decontaminate, embeddings, language, merkle, pieces, pii, sharding, simhash, toxicity, url_filter
from dijkstone.llm.common import in_fold
from dijkstone.llm.substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: A prime of more than a hundred times the number of shards.
SHARD_TABLE = 2_039


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign(docs, "doc_id", SHARDS, SHARD_TABLE)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 4) == 2
    model = toxicity.fit(docs, labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # A page is the document of its id; it is bad if that is labelled toxic or of low quality.
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return url_filter.judge(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(more)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", *decontaminate.RESULTS)


#: Place of the vocabulary file; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, pieces.Vocabulary.load(VOCABULARY)).select("doc_id", "n_ids", "ids", "exact")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embeddings.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold("doc_id", 5) == 0
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    # The rows as they are presented: every fifth, by the hash of its id, has been tampered with.
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    presented = {"text": F.when(in_fold("doc_id", 5) == 0, lowered).otherwise(F.col("text"))}
    return merkle.manifest(docs, "doc_id", "source", LEAF_FIELDS, presented).drop("path")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Places of the vocabulary files that are aligned.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", VOCABULARY


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, alignment.Vocabularies.load(BYTE_BPE, PIECE_BPE))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii": op12_pii,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL: dict[str, str] = {}
SQL["op6_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h') AS r1,
         contains(text, '### ') OR contains(text, '</turn>') AS esc,
         replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS et
  FROM t
), p AS (
  SELECT *, '### ' || replace(replace(replace(r1, ':', '\c'), '*', '\s'), chr(10), '\n')
            || CASE WHEN esc THEN '*' ELSE '' END || ': ' || CASE WHEN esc THEN et ELSE text END || '</turn>' || chr(10) AS piece
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
SQL["op7_decontamination"] = r"""
WITH items AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), listed AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM listed),
spots AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM docs, sizes)
), hits AS (SELECT doc_id, s, size, win FROM spots SEMI JOIN (SELECT DISTINCT win FROM listed) l USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, win FROM hits) JOIN listed USING (win) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
SQL["op2_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), spots AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM docs)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, s) AS n FROM spots) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
SQL["op1_sharding"] = r"""
WITH RECURSIVE shards AS (
  SELECT list('shard-' || lpad(i::VARCHAR, 2, '0') ORDER BY i) AS names FROM range(16) t(i)
), seeds AS (
  SELECT names, 2039 AS m,
         list_transform(names, lambda s: ('0x' || substr(md5(s || '/offset'), 1, 15))::BIGINT % 2039) AS off,
         list_transform(names, lambda s: ('0x' || substr(md5(s || '/skip'), 1, 15))::BIGINT % 2038 + 1) AS skip
  FROM shards
), turns(t, owner, nxt) AS (
  SELECT 0, list_transform(range(2039), lambda x: -1), list_transform(range(16), lambda x: 0::BIGINT)
  UNION ALL
  SELECT t + 1,
         list_concat(list_concat(owner[1 : p], [(t % 16)::INTEGER]), owner[p + 2 : 2039]),
         list_concat(list_concat(nxt[1 : t % 16], [j + 1]), nxt[t % 16 + 2 : 16])
  FROM (
    SELECT *, (off[t % 16 + 1] + j * skip[t % 16 + 1]) % 2039 AS p
    FROM (
      SELECT t, owner, nxt, off, skip,
             list_filter(range(nxt[t % 16 + 1], 2039), lambda k: owner[(off[t % 16 + 1] + k * skip[t % 16 + 1]) % 2039 + 1] = -1)[1] AS j
      FROM turns, seeds WHERE t < 2039
    )
  )
), filled AS (SELECT owner FROM turns WHERE t = 2039),
placed AS (SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 2039)::INTEGER AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-' || lpad((owner[slot + 1])::VARCHAR, 2, '0') AS shard FROM placed, filled
"""
SQL["op9_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""


def _url_sql() -> str:
    """The template tree, one level for each step of the recursion."""
    u, split = url_filter, "string_split(regexp_replace(path, '^/', ''), '/')"
    digits = f"list_transform({split}, lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END)"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in rules) + " END"
    k = u.PRIOR_PAGES
    return f"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/?[^?#]*)', 1) AS path FROM r),
p AS (SELECT *, {digits} AS segs FROM h),
l AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INTEGER) AS bad FROM labels GROUP BY 1),
raw AS (SELECT host, segs, count(*) AS n, count(bad) AS seen, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l USING (page_id) GROUP BY ALL),
tree(level, host, segs, n, seen, bad, template) AS (
  SELECT 0, host, segs, n, seen, bad, '' FROM raw
  UNION ALL
  SELECT level + 1, host, segs, n, seen, bad, CASE WHEN seg IS NULL THEN template ELSE template || '/' || CASE WHEN sn >= {u.LEAST_URLS} AND
    coalesce(abs(sb / nullif(ss, 0) - (ab - sb) / nullif(a - ss, 0)) / nullif(sqrt(ab / nullif(a, 0) * (1 - ab / nullif(a, 0)) * (1 / nullif(ss, 0) + 1 / nullif(a - ss, 0))), 0), 0) >= {u.LEAST_Z} THEN seg ELSE '*' END END
  FROM (
    SELECT *, sum(n) OVER w AS sn, sum(seen) OVER w AS ss, sum(bad) OVER w AS sb, sum(seen) OVER v AS a, sum(bad) OVER v AS ab
    FROM (SELECT *, segs[level + 1] AS seg FROM tree WHERE level < (SELECT max(len(segs)) FROM raw))
    WINDOW w AS (PARTITION BY host, template, seg), v AS (PARTITION BY host, template, seg IS NULL)
  )
), leaves AS (SELECT * FROM tree WHERE level = (SELECT max(len(segs)) FROM raw)),
o AS (SELECT coalesce((sum(seen) - sum(bad) + 1) / (sum(seen) + 1), 1) AS overall FROM raw),
hosts AS (SELECT host, (sum(seen) - sum(bad) + {k} * any_value(overall)) / (sum(seen) + {k}) AS of_host FROM raw, o GROUP BY 1),
pure AS (SELECT t.host, template, (sum(seen) - sum(bad) + {k} * any_value(of_host)) / (sum(seen) + {k}) AS purity FROM leaves t JOIN hosts USING (host) GROUP BY ALL)
SELECT page_id, p.host, path, {case(1).replace("host", "p.host")} AS rule,
  coalesce({case(0).replace("host", "p.host")}, CASE WHEN purity < {u.LEAST_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(purity, 6) AS purity
FROM p LEFT JOIN leaves t ON p.host = t.host AND p.segs = t.segs LEFT JOIN pure ON pure.host = t.host AND pure.template = t.template
"""


SQL["op5_url_filter"] = _url_sql()


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, by ``steps``, the list of the remainders of all bytes."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


_remainder_sql = "list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
_field_sql = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
_leaf_sql = lambda text: "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in LEAF_FIELDS) + ")"
#: Recursion from the leaves (tree, idx, n, h) of all trees to their roots, and each node with its siblings.
_grow_sql = """{0}(tree, lvl, idx, n, h) AS (
  SELECT tree, 0, idx, n, h FROM {1}
  UNION ALL SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY tree, lvl, idx // 16, n
), {0}_sides AS (
  SELECT tree, lvl, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {0} WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, idx // 16 ORDER BY idx)
)"""
SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE remainders AS (SELECT list({_remainder_sql} ORDER BY i) AS steps FROM range(256) t(i)),
crc AS (SELECT k, {_crc32_sql("k")} AS crc FROM (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents WHERE doc_id IS NOT NULL), remainders),
rows AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_leaf_sql("text")} AS h,
         {_leaf_sql("(CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS given
  FROM documents LEFT JOIN crc ON k = doc_id::VARCHAR
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM rows
),
{_grow_sql.format("grown", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS of, h, row_number() OVER (ORDER BY tree::BLOB) - 1 AS idx, count(*) OVER () AS n FROM grown WHERE n = 1
),
{_grow_sql.format("crown", "subroots")},
steps AS (
  SELECT l.tree, l.idx, s.lvl, before, after FROM leaves l JOIN grown_sides s ON s.tree = l.tree AND s.idx = l.idx // (16 ** s.lvl)::BIGINT
  UNION ALL
  SELECT l.tree, l.idx, 100 + s.lvl, before, after FROM leaves l JOIN subroots r ON r.of = l.tree JOIN crown_sides s ON s.idx = r.idx // (16 ** s.lvl)::BIGINT
), paths AS (SELECT tree, idx, list({{'before': before, 'after': after}} ORDER BY lvl) AS path FROM steps GROUP BY tree, idx),
walk(tree, idx, d, left_) AS (
  SELECT l.tree, l.idx, given, coalesce(path, []) FROM leaves l LEFT JOIN paths p ON p.tree = l.tree AND p.idx = l.idx
  UNION ALL SELECT tree, idx, sha256(left_[1].before || d || left_[1].after), left_[2:] FROM walk WHERE len(left_) > 0
)
SELECT doc_id, l.h AS leaf, r.h AS subroot, t.h AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
       d AS folded_root, d = t.h AS verified
FROM leaves l JOIN subroots r ON r.of = l.tree JOIN (SELECT h FROM crown WHERE n = 1) t ON true
JOIN (SELECT * FROM walk WHERE len(left_) = 0) w ON w.tree = l.tree AND w.idx = l.idx LEFT JOIN paths p ON p.tree = l.tree AND p.idx = l.idx
"""


def _pii_sql() -> str:
    """Each kind's matches with their places: texts are split at the matches, and lengths are summed."""
    figures = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(len({figures})), lambda i: CASE WHEN i % 2 = 0 THEN ({figures}[len({figures}) - i])::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][({figures}[len({figures}) - i])::INTEGER + 1] END)) % 10 = 0"
    code = "replace(hit, ' ', '')"
    order = f"string_split({code}[5:] || {code}[1:4], '')"
    value = "strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform({order}, lambda c: {value})), lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    # name, pattern, number of the pattern's group, test, score, whether it is always reported
    specs = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT)) <= 255"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN len({figures}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({figures}) BETWEEN 9 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"len({code}) BETWEEN 15 AND 34 AND {mod97}"),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')"),
        ("local_phone", r"\b0[0-9]{1,3}[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b", "true"),
    ]
    parts, kept = [], []
    for i, (name, pattern, stands) in enumerate(specs):
        kind = pii.KINDS[i]
        words = "(?:^|[^a-z])(?:" + "|".join(kind.context) + ")(?:[^a-z]|$)"
        likely = f"regexp_matches(lower(gap[-{pii.BEFORE}:] || ' ' || coalesce(nxt, '')[1:{pii.AFTER}]), '{words}')"
        score = f"{kind.score + (pii.CHECKSUM if kind.checked else 0)} + CASE WHEN {likely} THEN {pii.CONTEXT} ELSE 0 END"
        parts.append(
            f"""h{i} AS (
  SELECT r, gap, hit, lead(gap) OVER w AS nxt, (sum(len(gap) + coalesce(len(hit), 0)) OVER w)::BIGINT AS e
  FROM (SELECT r, unnest(regexp_split_to_array(text, '{pattern}')) AS gap, unnest(list_append(regexp_extract_all(text, '{pattern}'), NULL)) AS hit,
               generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i FROM docs WHERE regexp_matches(text, '{pattern}'))
  WINDOW w AS (PARTITION BY r ORDER BY i)
)"""
        )
        kept.append(f"SELECT r, {i} AS k, '{name}' AS kind, e - len(hit) AS s, e FROM h{i} WHERE hit IS NOT NULL AND {stands}" + ("" if kind.base else f" AND {score} >= {pii.LEAST_SCORE}"))
    bases = [i for i, k in enumerate(pii.KINDS) if k.base]
    alone = [i for i, k in enumerate(pii.KINDS) if not k.base and not k.checked]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
found AS ({" UNION ALL ".join(kept)}),
spans AS (
  SELECT * FROM found f WHERE k NOT IN ({", ".join(map(str, alone))})
    OR NOT EXISTS (SELECT 1 FROM found b WHERE b.r = f.r AND b.k IN ({", ".join(map(str, bases))}) AND b.s < f.e AND f.s < b.e)
), told AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{pii.KINDS[i].name}" for i in bases)},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k IN ({", ".join(map(str, bases))})) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{pii.KINDS[i].name}, 0)::BIGINT AS n_{pii.KINDS[i].name}" for i in bases)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (r)
"""


SQL["op12_pii"] = _pii_sql()
