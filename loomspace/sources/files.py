"""Text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole UTF-8 files as (doc_id, text, source, source_ord); source is the path as given, source_ord its place in the list.

    A missing file is an error of Spark's reader; bytes that are not UTF-8 are an error here.
    """
    parts = []
    for k, path in enumerate(paths):
        raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), "content")
        checked = F.when(F.encode("text", "UTF-8") == F.col("content"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
        parts.append(raw.select("path", checked.alias("text"), F.lit(path).alias("source"), F.lit(k).alias("source_ord")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    number = F.row_number().over(Window.partitionBy("source_ord").orderBy("path")) - 1
    return out.withColumn("doc_id", number.cast("bigint")).drop("path")
