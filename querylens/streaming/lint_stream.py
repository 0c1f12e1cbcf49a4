"""Linting new files as they arrive.

A micro-batch holds whole documents, so its findings are those of a batch run over the same files;
they are appended as Parquet, once for each batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querylens.operators.lint import findings


def lint_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Start linting a stream of ``doc_id, dialect, target, text`` over all that is there; findings go to ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces its own folder.
        findings(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_hour(found: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Of a stream of findings with their time: how many of each rule by hour, late ones within ``late`` included."""
    return found.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "rule").agg(F.count("*").alias("n"))
