"""Searches by an index of stemmed words over documents."""

import uuid

from pyspark.sql import functions as F

from dijkstone.operators import scoring as S
from dijkstone.operators.postings import Postings
from dijkstone.plans.registry import query
from dijkstone.plans.texts import TOKENS_SQL
from dijkstone.sources.storage import shared_dir

ANY, PREFIXES, PHRASE = ("thatin", "oder", "worthless", "thening"), ("the", "only"), ("of", "the")


def _undoubled(x: str) -> str:
    return f"regexp_replace({x}, '(k)k$|(d)d$|(t)t$', '\\1\\2\\3')"


def _en(w: str, n: int) -> str:
    return f"CASE WHEN length({w}) - {n} >= p1 AND regexp_matches({w}, '[^aeiouyè].{{{n}}}$') AND NOT regexp_matches({w}, 'gem.{{{n}}}$') THEN {_undoubled(f'left({w}, -{n})')} ELSE {w} END"


def _s(n: int) -> str:
    return f"CASE WHEN length(w) - {n} >= p1 AND regexp_matches(w, '[^aeiouyèj].{{{n}}}$') THEN left(w, -{n}) ELSE w END"


def _e(w: str) -> str:
    return f"CASE WHEN length({w}) - 1 >= p1 AND regexp_matches({w}, '[^aeiouyè]e$') THEN {_undoubled(f'left({w}, -1)')} ELSE {w} END"


def _ig(w: str) -> str:
    return f"{w} LIKE '%ig' AND length({w}) - 2 >= p2 AND NOT {w} LIKE '%eig'"


#: Every word with its stem: a table for each step of the algorithm.
STEMS_SQL = f"""k AS (SELECT doc_id, {TOKENS_SQL} AS ws FROM documents), u AS (SELECT DISTINCT unnest(ws) AS word FROM k UNION SELECT unnest({[*ANY, *PREFIXES, *PHRASE]})),
  marked AS (SELECT word, replace(replace(regexp_replace(regexp_replace(translate(word, 'äëïöüáéíóú', 'aeiouaeiou'), '^y', 'Y'), '([aeiouyè])(i[aeiouyè]|y)', '\\1#\\2', 'g'), '#i', 'I'), '#y', 'Y') AS w FROM u),
  reach AS (SELECT word, w, length(regexp_extract(w, '^[^aeiouyè]*[aeiouyè]+[^aeiouyè]')) AS a, length(regexp_extract(w, '^[^aeiouyè]*[aeiouyè]+[^aeiouyè]+[aeiouyè]+[^aeiouyè]')) AS b FROM marked),
  regions AS (SELECT word, w, CASE WHEN a = 0 THEN length(w) ELSE greatest(a, 3) END AS p1, CASE WHEN b = 0 THEN length(w) ELSE b END AS p2 FROM reach),
  one AS (SELECT word, p1, p2, CASE WHEN w LIKE '%heden' THEN CASE WHEN length(w) - 5 >= p1 THEN left(w, -5) || 'heid' ELSE w END WHEN w LIKE '%ene' THEN {_en("w", 3)} WHEN w LIKE '%en' THEN {_en("w", 2)} WHEN w LIKE '%se' THEN {_s(2)} WHEN w LIKE '%s' THEN {_s(1)} ELSE w END AS w FROM regions),
  two AS (SELECT word, p1, p2, w AS before, {_e("w")} AS w FROM one),
  heid AS (SELECT word, p1, p2, w <> before AS lost, w, w LIKE '%heid' AND length(w) - 4 >= p2 AND NOT w LIKE '%cheid' AS fit, left(w, -4) AS x FROM two),
  three AS (SELECT word, p1, p2, lost, CASE WHEN NOT fit THEN w WHEN x LIKE '%en' THEN {_en("x", 2)} ELSE x END AS w FROM heid),
  cut AS (SELECT *, left(w, -3) AS x, left(w, -4) AS y FROM three),
  four AS (SELECT word, CASE WHEN (w LIKE '%end' OR w LIKE '%ing') AND length(w) - 3 >= p2 THEN CASE WHEN {_ig("x")} THEN left(x, -2) ELSE {_undoubled("x")} END WHEN {_ig("w")} THEN left(w, -2)
    WHEN w LIKE '%lijk' AND length(w) - 4 >= p2 THEN {_e("y")} WHEN w LIKE '%baar' AND length(w) - 4 >= p2 THEN y WHEN w LIKE '%bar' AND length(w) - 3 >= p2 AND lost THEN x ELSE w END AS w FROM cut),
  stems AS (SELECT word, translate(regexp_replace(w, '([^aeiouyè])(?:(a)a|(e)e|(o)o|(u)u)([^aeiouyèI])$', '\\1\\2\\3\\4\\5\\6'), 'IY', 'iy') AS term FROM four),
  places AS (SELECT doc_id, n, place, term FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM k) JOIN stems USING (word))"""


def _asked(words) -> str:
    return f"(SELECT term FROM stems WHERE word IN {tuple(words)})"


def _index(t):
    index = Postings(t.spark, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}", heads=8)
    return index.write(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("txt04_stems", f"WITH {STEMS_SQL} SELECT DISTINCT word, term FROM stems JOIN (SELECT unnest(ws) AS word FROM k) USING (word)")
def _(t):
    from dijkstone.functions.stems import dutch_stem
    from dijkstone.functions.text import tokens

    words = t.documents.select(F.explode(tokens(F.col("text"), [])).alias("word")).distinct()
    return words.withColumn("term", dutch_stem(F.col("word")))


@query("txt04_any_of_index", f"WITH {STEMS_SQL} SELECT doc_id, count(DISTINCT term) AS n_terms FROM places WHERE term IN {_asked(ANY)} GROUP BY 1")
def _(t):
    return _index(t).any_of(list(ANY)).select(F.col("id").alias("doc_id"), "n_terms")


@query(
    "txt04_prefixes_index",
    f"WITH {STEMS_SQL} SELECT doc_id FROM places, (SELECT DISTINCT term AS p FROM stems WHERE word IN {PREFIXES}) WHERE starts_with(term, p) GROUP BY 1 HAVING count(DISTINCT p) = {len(PREFIXES)}",
)
def _(t):
    return _index(t).all_prefixes(list(PREFIXES)).select(F.col("id").alias("doc_id"))


@query(
    "txt04_phrase_index",
    f"WITH {STEMS_SQL} SELECT a.doc_id, a.place::INTEGER AS place FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.place = a.place + 1 WHERE a.term IN {_asked(PHRASE[:1] * 2)} AND b.term IN {_asked(PHRASE[1:] * 2)}",
)
def _(t):
    return _index(t).phrase(list(PHRASE)).select(F.col("id").alias("doc_id"), F.col("at").alias("place"))


@query(
    "txt05_ranked_index",
    f"""WITH {STEMS_SQL}, c AS (SELECT count(*) AS docs, avg(len(ws)) AS mean_n FROM k), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM places WHERE term IN {_asked(ANY)} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
        SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n))), 6) AS score FROM tf JOIN df USING (term), c GROUP BY 1""",
)
def _(t):
    return _index(t).ranked(list(ANY)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    "txt29_two_scopes",
    """WITH s AS (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE source = 'src0'), p AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)', 1) AS heading FROM pages),
       d AS (SELECT doc_id, md5(regexp_replace(text, '<[^>]+>', '', 'g')) AS body, text, heading FROM documents LEFT JOIN p USING (doc_id))
       SELECT doc_id, body FROM d WHERE doc_id IN (SELECT doc_id FROM s) AND regexp_matches(coalesce(text, '') || chr(10) || coalesce(heading, ''), '(?i)(^|[^\\p{L}\\p{N}_])(thatin|eanment)')""",
)
def _(t):
    heads = t.pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("heading"))
    texts = t.documents.select("doc_id", "text").join(heads, "doc_id", "left")
    scopes = [t.labels.where("quality = 1"), t.documents.where("source = 'src0'")]
    found = S.text_fallback(texts, scopes, ["thatin", "eanment", "the"], "doc_id", ["text", "heading"], ["heading"])
    return found.select("doc_id", F.md5(F.regexp_replace("text", "<[^>]+>", "").cast("binary")).alias("body"))
