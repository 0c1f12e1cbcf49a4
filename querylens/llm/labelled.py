"""Labelled rows to fit a classifier on: a bounded sample, the same in every run."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fetched to fit a model; the labels with the lowest hashes.
SAMPLE_ROWS = 4000


def fold(doc_id: str = "doc_id") -> Column:
    """0, 1 or 2 by the id's checksum; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], *, held_out: bool, rows: int = SAMPLE_ROWS) -> pa.Table:
    """``doc_id, quality, fold, *columns``, at most ``rows`` rows, by ascending doc_id, in Arrow as it came.

    held_out: whether labels of fold 1 may be used. Rows without a label are left out; of several
    labels or texts of one doc_id the least counts.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"), fold().alias("fold"))
    if not held_out:
        known = known.where("fold <> 1")
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.first("fold").alias("fold")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # picked has at most ``rows`` rows whatever the labels.
    met = docs.select("doc_id", F.struct(*columns).alias("row")).join(F.broadcast(picked), "doc_id")
    one = met.groupBy("doc_id").agg(F.min("row").alias("row"), F.first("quality").alias("quality"), F.first("fold").alias("fold"))
    return one.select("doc_id", "quality", "fold", "row.*").toArrow().sort_by("doc_id")
