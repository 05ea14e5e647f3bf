"""Which names stand as whole words in which texts.

Up to ``AUTOMATON_CHARS`` characters of distinct names go into one automaton (its goto, failure and output links are arrays of
the Aho-Corasick library), which is broadcast as the list of names, built once a worker and run once over each text: time is
linear in the texts, whatever the number of names. Beyond that size names meet the words of the texts in a join on their first
word; only (row, word) is exploded, and what meets comes back to its text for the test. Names and texts are never paired.

Defined results: case is ignored. A name counts where no letter, mark, digit or underscore is right before or after it. Null or
empty texts and names match nothing; names shorter than ``least`` characters are left out. Rows of texts that are equal in all
key columns and in their text give one row for each name.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.functions.text import whole_word

#: Characters of distinct names in an automaton at most (some 80 MB in a worker).
AUTOMATON_CHARS = 2_000_000
#: Characters of texts that are searched together.
_APART = r"(?U)[^\w]+"


def _in_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LNM"


def automaton(names):
    """An automaton that gives each name that it meets."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def words_in(search, text: str) -> list[str]:
    """The names that stand in a text as whole words, in the order of their first end."""
    found = {}
    for end, name in search.iter(text):
        if name not in found:
            at = end + 1 - len(name)
            if (at == 0 or not _in_word(text[at - 1])) and (end + 1 == len(text) or not _in_word(text[end + 1])):
                found[name] = None
    return list(found)


def _scan(handed):
    def run(batches):
        value = handed.value  # stays in the worker for the tasks to come
        search = value.get("search") or value.setdefault("search", automaton(value["names"]))
        for batch in batches:
            keys = batch.drop_columns(["__text"])
            rows, names = [], []
            for i, text in enumerate(batch.column("__text")):
                hits = words_in(search, text.as_py() or "")
                rows += [i] * len(hits)
                names += hits
            yield pa.RecordBatch.from_arrays([*keys.take(pa.array(rows, pa.int32())).columns, pa.array(names, pa.string())], names=[*keys.schema.names, "__name"])

    return run


def _by_automaton(texts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    handed = texts.sparkSession.sparkContext.broadcast({"names": names})
    schema = T.StructType([*texts.select(*keys).schema, T.StructField("__name", T.StringType())])
    return texts.where("__text <> ''").mapInArrow(_scan(handed), schema) if names else texts.sparkSession.createDataFrame([], schema)


def _by_first_word(texts: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    row = F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys), F.xxhash64("__text"))
    kept = texts.withColumn("__row", row).dropDuplicates(["__row"])
    head = F.element_at(F.filter(F.split("__name", _APART), lambda w: w != ""), 1)
    words = kept.select("__row", F.explode(F.array_distinct(F.split("__text", _APART))).alias("__w"))
    met = words.join(names.withColumn("__w", head), "__w").select("__row", "__name").distinct()
    return met.join(kept, "__row").where(whole_word(F.col("__text"), F.col("__name"))).select(*keys, "__name")


def found(texts: DataFrame, names: DataFrame, keys: list[str], text: str = "text", name: str = "name", least: int = 5, on: Column | None = None, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows of ``keys`` of ``texts`` with the columns of ``names`` that are found in them. ``on`` is a further condition, such
    as that the scope of a text is that of the name."""
    given = texts.select(*keys, F.lower(text).alias("__text"))
    listed = names.where(F.length(name) >= least).withColumn("__name", F.lower(name)).where("__name <> ''")
    distinct = listed.select("__name").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("__name")), F.lit(0))).first()[0]
    if size <= automaton_chars:
        hits = _by_automaton(given, keys, sorted(r[0] for r in distinct.collect()))  # automaton_chars at most
    else:
        hits = _by_first_word(given, keys, distinct)
    out = hits.join(listed, "__name")
    return (out if on is None else out.where(on)).select(*keys, *names.columns).distinct()
