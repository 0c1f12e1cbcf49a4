"""What the windows of the rendered lint queries hold doesn't follow the table's length."""

import pytest
from pyspark.sql import functions as F

from querylens.operators import lint as lint_rules
from querylens.operators import report
from querylens.queries import QUERIES

ORDERS = "/root/testdata/sf0.001/orders.parquet"


@pytest.mark.parametrize("query", ["lint_json", "lint_pretty", "lint_reports"])
def test_windows_hold_the_same_words_of_a_longer_table(spark, tmp_path, monkeypatch, query):
    orders = spark.read.parquet(ORDERS)
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1
    longer = orders.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).withColumn("o_orderkey", F.col("o_orderkey") + n * F.col("copy")).drop("copy")
    words, plain = [], lint_rules.marked
    monkeypatch.setattr(lint_rules, "marked", lambda of: words.append(plain(of).count()) or plain(of))
    for name, table in (("short", orders), ("long", longer)):
        table.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert QUERIES[query](spark, f"{tmp_path}/{name}").count() == table.count()
    assert words[0] == words[1] > 0


@pytest.mark.parametrize("form", ["json", "pretty", "text"])
def test_windows_hold_a_share_of_the_words_where_all_shapes_differ(spark, monkeypatch, form):
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    text = F.concat(F.lit("SELECT * FROM t_"), letters, F.lit(" WHERE b_"), letters, F.lit(" = NULL"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("generic").alias("dialect"), F.lit(None).cast("string").alias("target"), text.alias("text"))
    held, plain = [], lint_rules.marked

    def spied(of):
        words = plain(of)
        held.extend(r["n"] for r in words.groupBy(F.spark_partition_id().alias("task")).agg(F.count("n_selects").alias("n")).collect())
        return words

    monkeypatch.setattr(lint_rules, "TASK_WORDS", 1000)
    monkeypatch.setattr(lint_rules, "marked", spied)
    found = report.report(docs, lint_rules.diagnostics(docs, rules={"QL0500", "QL0600"}), form).collect()
    assert sum(held) == 300 * 8 and max(held) <= 1000
    assert len(found) == 300 and all("QL0500" in r["report"] and "QL0600" in r["report"] for r in found)
