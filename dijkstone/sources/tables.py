"""Tables and files as DataFrames, and the ways to write them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dijkstone.sources.storage import materialize
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{base}/{name}.parquet")


def scattered(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session shuffles to, by a hash of its rows. A small file whose rows each become much
    work is one split, and adaptive execution would gather a shuffle without a number for its few bytes."""
    plain = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *plain)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Rows of XML files by their tag (also .gz), with a schema, so nothing is read twice."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """(archive, member, text) of archives; each archive is one file of bounded size and opened within its task."""
    import io
    import zipfile

    def rows(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(name, m, z.read(m).decode("utf-8", "replace")) for m in z.namelist() if m.endswith(suffix)]
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "archive string, member string, text string")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: their properties and geometry as text."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:string>>"
    return spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def component_tree(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Flatten a JSON component tree (id, title, children) to nodes with parent, depth and pre-order place.

    One level a step, whatever the depth: every step explodes the children of the level before, which is written.
    """
    node = "struct<id:string,title:string,children:array<string>>"
    level = df.select(key, F.from_json(payload, node).alias("n"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("place"))
    out, depth = [], 0
    while True:
        level = materialize(level, "components")
        out.append(level)
        kids = level.where(F.size("n.children") > 0).select(key, F.col("n.id").alias("parent_id"), "place", F.posexplode("n.children").alias("i", "json"))
        if kids.isEmpty():
            break
        depth += 1
        level = kids.select(key, F.from_json("json", node).alias("n"), "parent_id", F.lit(depth).alias("depth"), F.concat("place", F.array("i")).alias("place"))
    return reduce(DataFrame.unionByName, out).where("n.id is not null").select(key, F.col("n.id").alias("id"), "parent_id", F.col("n.title").alias("title"), "depth", "place")


def fallback_rows(facts: DataFrame, main: str, other: str) -> DataFrame:
    """Explode ``main``; only where it is empty explode ``other``, with a flag."""
    empty = F.coalesce(F.size(main), F.lit(0)) <= 0
    return facts.withColumn("value", F.explode_outer(F.when(empty, F.col(other)).otherwise(F.col(main)))).withColumn("from_fallback", empty)


def first_reference(refs: Column) -> Column:
    return F.get(refs, F.lit(0))


def late_dimension(dimension: DataFrame, facts: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """The dimension with a row "Onbekend" (all else null) for each key that only facts know."""
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dimension, key, "left_anti").withColumn(kind, F.lit("Onbekend"))
    return dimension.unionByName(missing, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet, in partitions if asked; sorted within files so that row-group statistics prune."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_scope(df: DataFrame, path: str, scope: list[str]) -> None:
    """Drop by scope and insert again: only the partitions that ``df`` holds are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_feature(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """(feature) GeoJSON features of points, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
