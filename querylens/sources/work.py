"""Tables written on the way, in the storage that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The session's setting for the folder of the scope that is open.
SCOPE = "querylens.work.scope"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that all machines share; ValueError if a cluster names none.

    Only on one machine, as in tests, a folder of this machine serves where none is set.
    """
    root = spark.conf.get(SCOPE, None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), "querylens-work")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times, or whose lineage is to end; a lost executor doesn't cost it."""
    df.write.parquet(path := work_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """A folder for the work tables of what runs within, deleted at the end: results must be written by then."""
    outer = spark.conf.get(SCOPE, None)
    path = work_path(spark, "scope")
    spark.conf.set(SCOPE, path)
    try:
        yield path
    finally:
        spark.conf.unset(SCOPE) if outer is None else spark.conf.set(SCOPE, outer)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
