from pyspark.sql import functions as F

from querylens.operators.lint import findings
from querylens.plans.corpus import TEMPLATES
from querylens.streaming.lint_stream import counts_by_hour, lint_stream

DOCS = "doc_id long, dialect string, target string, text string"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, t.dialect, t.target, t.text) for i, t in enumerate(TEMPLATES[:20])], DOCS)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lint_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "rule", "line", "col")
    want = findings(docs).select("doc_id", "rule", "line", "col")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_by_hour(spark, tmp_path):
    """Counts of windows that closed; a finding later than the watermark is left out."""
    rows = [("2024-01-01 10:05:00", "A"), ("2024-01-01 10:50:00", "A"), ("2024-01-01 11:10:00", "B"), ("2024-01-01 14:00:00", "B")]
    for k, part in enumerate((rows, [("2024-01-01 15:00:00", "C")], [("2024-01-01 16:00:00", "C")], [("2024-01-01 10:30:00", "A")], [("2024-01-01 20:00:00", "C")])):
        spark.createDataFrame(part, "ts string, rule string").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("ts string, rule string, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = counts_by_hour(stream.withColumn("ts", F.to_timestamp("ts")), late="1 hour").select(F.hour("window.start").alias("h"), "rule", "n")
    counted.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["h"], r["rule"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (10, "A", 2) in got and (11, "B", 1) in got and all(h < 19 for h, _, _ in got)
