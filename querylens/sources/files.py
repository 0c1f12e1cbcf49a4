"""Reading SQL files and writing text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.codepages import decoded, encoded
from querylens.plans.dialects import dialect_name


def read_sources(spark: SparkSession, path: str, dialect: str, *, target: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """``doc_id, path, dialect, target, text, status`` of each file; a file that can't be decoded has a status and no text."""
    files = spark.read.format("binaryFile").load(path)
    return from_bytes(files.select(F.xxhash64("path").alias("doc_id"), "path", "content"), dialect, target=target, encoding=encoding)


def from_bytes(files: DataFrame, dialect: str, *, target: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """The same from a frame with ``content`` in binary."""
    text = decoded(F.col("content"), encoding)
    goal = F.lit(dialect_name(target) if target else None).cast("string")
    return files.withColumns({"dialect": F.lit(dialect_name(dialect)), "target": goal, "text": text}).withColumn("status", F.when(F.col("text").isNull(), "encoding_error").otherwise("ok")).drop("content")


def write_sql(texts: DataFrame, path: str, *, column: str = "sql", encoding: str = "utf-8") -> None:
    """Write each text with a newline at its end, in the target encoding, as a Parquet column ``content`` of bytes."""
    texts.withColumn("content", encoded(F.concat(F.col(column), F.lit("\n")), encoding)).drop(column).write.parquet(path)
