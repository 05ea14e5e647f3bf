"""Structured Streaming over the same functions as the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dijkstone.sources.incremental import delta_sweep, upsert


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per window and key; what is later than ``late`` is dropped, and so is its state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def newest_only(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """First sight of each (key, ts) within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, ts])


def sweep_into(stream: DataFrame, spark: SparkSession, path: str, key: str, ts: str, order: str, checkpoint: str):
    """Keep a table of the newest row per key up to date. Late rows aren't dropped: the newer of old and new wins.

    The table is written as a version of its own for each batch and then named by a one-row pointer, so a batch that is run
    again after a failure gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int):
        from pyspark.errors import AnalysisException

        try:
            version = spark.read.json(f"{path}/_current").where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
        except AnalysisException:
            version = None
        new = delta_sweep(batch, key, ts, order)
        if version is not None:
            new = delta_sweep(spark.read.parquet(f"{path}/v={version}").unionByName(new), key, ts, order)
        new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        spark.range(1).select(F.lit(batch_id).alias("batch")).write.mode("append").json(f"{path}/_current")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.json(f"{path}/_current").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/v={version}")


def pair_life_cycles(events: DataFrame, key: str, ts: str, kind: str, opening: str, closing: str, late: str) -> DataFrame:
    """(key, opened, closed): each closing event with the latest opening one before it; openings wait as state per key."""

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts) if not state.hasTimedOut else None
        out = []
        if rows is not None:
            for t, k in zip(rows[ts], rows[kind]):
                if k == opening:
                    opened = t
                elif k == closing and opened is not None:
                    out.append((keys[0], opened, t))
                    opened = None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened,))
        yield pd.DataFrame(out, columns=[key, "opened", "closed"])

    kind_of_key = dict(events.dtypes)[key]
    return (
        events.withWatermark(ts, late)
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind_of_key}, opened timestamp, closed timestamp", "opened timestamp", "append", "NoTimeout")
    )


def run_ledger(spark: SparkSession, source: str, started, finished, n: int, n_failed: int, before: dict[str, int], after: dict[str, int]) -> DataFrame:
    """One row of the run ledger, with totals before and after."""
    status = "ok" if not n_failed else "gefaald" if n_failed >= n else "deels"
    return spark.createDataFrame(
        [(source, started, finished, status, n, n_failed, before, after)],
        "source string, started_at timestamp, finished_at timestamp, status string, n long, n_failed long, before map<string,long>, after map<string,long>",
    )


__all__ = ["current", "delta_sweep", "newest_only", "pair_life_cycles", "read_stream", "run_ledger", "sessions", "sweep_into", "upsert", "windowed_counts"]
