"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last adds ids, n_ids and exact.

Defined results of all stages: rows with a null or empty text stay (they are neither toxic, repeated nor contaminated; of
several, the near-copy stage keeps the one of the least id, as they are equal). Rows with a null id are judged like others
and never dropped as near copies. Repeated rows get equal decisions. Extra columns pass through, whatever their names, but
for those named ids, n_ids or exact in the last stage, which are replaced. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dijkstone.llm import decontaminate, pieces, similar, toxicity
from dijkstone.llm.common import in_fold, materialize
from dijkstone.llm.queries import VOCABULARY
from dijkstone.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """The text, and the whole row as a struct, so that no result column of an operator meets a column of the row."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("__row"), "doc_id", "text")


def _back(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from rows that were put aside."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col(f"__row.{c}")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Labels are learned from three of four folds, as in the query of the operator."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(in_fold("doc_id", 4) != 2).select("doc_id", "toxic")
    return _back(toxicity.score(_aside(docs), toxicity.fit(docs, labels)).where("predicted = 0"), docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies: within 3 bits as in the query of the operator,
    or 0.8 or more similar in five-word shingles."""
    return similar.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus. Texts that lose nothing stay as they are."""
    out, cut = remove_repeats(_aside(docs), "doc_id", "text"), F.col("n_removed") > 0
    n_chars = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))
    return _back(out, docs, text=F.when(cut, F.col("kept_text")).otherwise(F.col("text")), n_chars=n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return _back(decontaminate.judge(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, n_ids, and whether decoding gives the text back."""
    return pieces.round_trip(docs, pieces.Vocabulary.load(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_near_copy),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Nearest-neighbour scores and SentencePiece ids can't be said in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
