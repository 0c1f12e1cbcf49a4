"""Exact deduplication by a stateful stream.

A streaming aggregation holds one state row for each digest, in RocksDB on the executors' disks with
its log in shared storage, and without expiry: the number of rows seen, the largest ``doc_id`` (the
stable identifier of the row that stays) and that row's locator (file and row in it). New files
only touch the digests they bring; a stopped stream goes on from its checkpoint.

A digest that was hit more than once is checked on full bytes: its rows are grouped by the text
itself, so texts that differ under one digest would form groups of their own.

Null texts count as empty; very long texts are hashed whole, and only those with copies are shuffled.
Of equal texts the row with the largest doc_id stays; of repeated rows with that id, the one with the
largest locator. Frames that aren't read from files are written to the shared folder first, so that
each row has one. Null doc_ids count as smallest. Empty tables give empty results; other columns are
ignored, or kept by :func:`drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings, stored, text_or_empty, work_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each store claims some megabytes of disk ahead, whatever it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # A store's first buffer is an eighth of this, for each of a machine's many stores.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


STATE = "digest string, best struct<keep_id:bigint,locator:struct<file:string,row:bigint>>, n bigint"


def from_files(docs: DataFrame) -> bool:
    """Whether rows have a place in a file."""
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def located(docs: DataFrame, *columns) -> DataFrame:
    """These columns of ``docs``, and each row's place in its file as ``locator``."""
    return docs.select(*columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def keyed(rows: DataFrame) -> DataFrame:
    """``doc_id, digest, locator`` of a batch or stream of documents read from files."""
    return located(rows, F.col("doc_id"), F.sha2(text_or_empty(), 256).alias("digest"))


def stream_state(keys: DataFrame, checkpoint: str) -> DataFrame:
    """Run a stream of ``doc_id, digest, locator`` over all that is there; return its state, a row for each digest.

    Called again with the same checkpoint and more input, it goes on with the state it has.
    """
    spark = keys.sparkSession
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("keep_id"), "locator")).alias("best")
    state = keys.groupBy("digest").agg(best, F.count("*").alias("n"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{checkpoint}-state/batch={batch}")

    with settings(spark, STATE_STORE):
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    try:
        written = spark.read.schema(f"{STATE}, batch int").parquet(f"{checkpoint}-state")
    except AnalysisException:  # no input, no batch
        return spark.createDataFrame([], STATE)
    if written.select(F.max("batch") - F.min("batch")).first()[0]:
        written = written.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")
    return written.select("digest", "best", "n")


def _judged(docs: DataFrame, keys: DataFrame, state: DataFrame) -> DataFrame:
    """A row for each row of ``docs``, whose digests went through the stream: its group and whether it stays."""
    # Full bytes: rows of digests with hits, grouped by the text itself. Two contents of one digest are a clash.
    texts = located(docs, F.col("doc_id"), text_or_empty().alias("content")).withColumn("digest", F.sha2("content", 256))
    hit = state.where("n > 1")
    total = state.agg(F.sum("n")).first()[0] or 0
    # At most 1,000 digests can each hold more than a thousandth of all rows: those are broadcast, and their copies
    # collapse within each task before they are shuffled. The groups of the others are small.
    often, seldom = state.where(F.col("n") > total / 1000), state.where(F.col("n") <= total / 1000)
    hot = F.broadcast(hit.where(F.col("n") > total / 1000).select("digest"))
    cool = hit.where(F.col("n") <= total / 1000).select("digest")
    contents = texts.select("digest", "content")
    met = contents.join(hot, "digest", "left_semi").unionByName(contents.join(hot, "digest", "left_anti").join(cool.hint("shuffle_hash"), "digest", "left_semi"))
    differ = met.groupBy("digest", "content").agg(F.count("*").alias("n"))
    clash = stored(differ.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest"), "dedup-clash")
    # No key of the shuffled join holds more than a thousandth of the rows.
    of_state = keys.join(F.broadcast(often), "digest").unionByName(keys.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(seldom, "digest"))
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("keep_id"), "locator")
    out = (F.col("doc_id"), F.col("best.keep_id").alias("keep_id"), F.col("n").alias("group_size"), (key == F.col("best")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("locator"))
    if clash.isEmpty():
        return of_state.select(*out)
    # Digests that stand for several texts: their rows are judged by the texts themselves.
    apart = texts.join(clash, "digest", "left_semi")
    groups = apart.groupBy("digest", "content").agg(F.max(key).alias("best"), F.count("*").alias("n"))
    return of_state.join(clash, "digest", "left_anti").select(*out).unionByName(apart.join(groups, ["digest", "content"]).select(*out))


def dedup_files(spark: SparkSession, path: str, schema, checkpoint: str | None = None) -> DataFrame:
    """Deduplicate the Parquet files at ``path``, read as a stream: a row for each row of them."""
    docs = spark.read.schema(schema).parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in docs.inputFiles()] == [name]:  # a single file; streams read folders
        source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    else:
        source = spark.readStream.schema(schema).parquet(path)
    state = stream_state(keyed(source), checkpoint or work_path(spark, "dedup"))
    return _judged(docs, keyed(docs), state)


def dedup(docs: DataFrame) -> DataFrame:
    """The same for any frame: its digests, not its texts, are written for the stream to read."""
    docs = docs if from_files(docs) else stored(docs.select("doc_id", "text"), "dedup-docs")
    spark, keys = docs.sparkSession, stored(keyed(docs), "dedup-keys")
    files = keys.inputFiles()
    if files:
        state = stream_state(spark.readStream.schema(keys.schema).parquet(files[0].rsplit("/", 1)[0]), work_path(spark, "dedup"))
    else:
        state = spark.createDataFrame([], STATE)
    return _judged(docs, keys, state)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`dedup` drops, with the same columns, whatever their names."""
    docs = docs if from_files(docs) else stored(docs, "dedup-docs")
    gone = dedup(docs).where("not kept").select("locator")
    return located(docs, F.struct(*docs.columns).alias("row")).join(gone, "locator", "left_anti").select("row.*")
