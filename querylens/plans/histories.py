"""Histories of DDL, and what they leave behind, stated by hand: the part table's keys choose among them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import dealt


class History(NamedTuple):
    """Statements, with {k} for the key, and what is left: columns as table.column or table.column!, if NOT NULL; keys and foreign keys; notes."""

    text: str
    columns: str
    keys: str = ""
    notes: str = ""


H = History
BASE = "CREATE TABLE t{k} (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id), KEY k1 (a));"
OF_BASE = "t{k}.id! t{k}.a"
KEYS = "t{k}:primary(id) t{k}:k1(a)"
HISTORIES = (
    H(BASE, OF_BASE, KEYS),
    H(BASE + "ALTER TABLE t{k} ADD COLUMN b INT NOT NULL, ADD (c INT, d INT)", OF_BASE + " t{k}.b! t{k}.c t{k}.d", KEYS),
    H(BASE + "ALTER TABLE t{k} DROP COLUMN a", "t{k}.id!", "t{k}:primary(id)"),
    H(BASE + "ALTER TABLE t{k} MODIFY COLUMN a INT NOT NULL", "t{k}.id! t{k}.a!", KEYS),
    H(BASE + "ALTER TABLE t{k} CHANGE COLUMN a z INT", "t{k}.id! t{k}.z", "t{k}:primary(id) t{k}:k1(z)"),
    H(BASE + "ALTER TABLE t{k} RENAME COLUMN a TO z", "t{k}.id! t{k}.z", "t{k}:primary(id) t{k}:k1(z)"),
    H(BASE + "ALTER TABLE t{k} RENAME TO r{k}", "r{k}.id! r{k}.a", "r{k}:primary(id) r{k}:k1(a)"),
    H(BASE + "CREATE TABLE u{k} LIKE t{k}; DROP TABLE t{k}", "u{k}.id! u{k}.a", "u{k}:primary(id) u{k}:k1(a)"),
    H(BASE + "CREATE TABLE IF NOT EXISTS t{k} (q INT); ALTER TABLE IF EXISTS nope ADD x INT; DROP TABLE IF EXISTS nope", OF_BASE, KEYS),
    H(BASE + "CREATE OR REPLACE TABLE t{k} (q INT PRIMARY KEY)", "t{k}.q!"),
    H(BASE + "CREATE UNIQUE INDEX k2 ON t{k} (a); DROP INDEX k1 ON t{k}", OF_BASE, "t{k}:primary(id) t{k}:k2(a)"),
    H(BASE + "ALTER TABLE t{k} ADD CONSTRAINT f1 FOREIGN KEY (a) REFERENCES shop.users (id), ADD UNIQUE KEY k3 (id, a)", OF_BASE, KEYS + " t{k}:k3(id,a) t{k}->shop.users(id)"),
    H(BASE + "ALTER TABLE t{k} ADD CONSTRAINT f1 FOREIGN KEY (a) REFERENCES users (id); ALTER TABLE t{k} DROP FOREIGN KEY f1, DROP PRIMARY KEY, DROP INDEX k1", OF_BASE),
    H(BASE + "CREATE FULLTEXT INDEX k4 ON t{k} (a); CREATE INDEX k5 ON t{k} (LOWER(a))", OF_BASE, KEYS + " t{k}:k4(a) t{k}:k5(LOWER(a))"),
    H("CREATE DATABASE d; USE d; CREATE TABLE x{k} (a INT); DROP DATABASE d; CREATE TABLE y{k} (b INT)", "y{k}.b"),
    H("CREATE DATABASE d; USE d; CREATE TABLE x{k} (a INT); CREATE TABLE e.y{k} (b INT); ALTER TABLE e.y{k} RENAME TO z{k}", "x{k}.a z{k}.b"),
    H("DROP TABLE gone{k}; CREATE VIEW v AS SELECT 1; " + BASE + BASE, OF_BASE, KEYS, "missing_table=gone{k} skipped=CREATE_VIEW duplicate_table=t{k}"),
    H(BASE + "USE; DROP DATABASE; ALTER TABLE t{k} RENAME; ALTER TABLE t{k} DROP; CREATE INDEX i ON t{k}", OF_BASE, KEYS, "malformed=USE malformed=DROP_DATABASE malformed=ALTER_TABLE malformed=ALTER_TABLE malformed=CREATE_INDEX"),
    H(BASE + "ALTER TABLE t{k} ADD COLUMN b INT, DROP; CREATE TABLE; ALTER TABLE; CREATE INDEX", OF_BASE, KEYS, "malformed=ALTER_TABLE malformed=CREATE_TABLE malformed=ALTER_TABLE malformed=CREATE_INDEX"),
)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of SQL text with ``project_id`` and ``file_ord``: one history for each part."""
    table = spark.createDataFrame([(i, h.text) for i, h in enumerate(HISTORIES)], "history long, pattern string")
    parts = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    parts = parts.select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").cast("string").alias("project_id"), F.lit(0).cast("long").alias("file_ord"), (F.col("p_partkey") % len(HISTORIES)).alias("history"))
    rows = parts.join(F.broadcast(table), "history")
    return rows.select("doc_id", "project_id", "file_ord", F.lit("mysql").alias("dialect"), F.lit(None).cast("string").alias("target"), F.replace("pattern", F.lit("{k}"), F.col("project_id")).alias("text"))


def histories_sql(what: str) -> str:
    """DuckDB relation ``stated(project_id, item)`` of what histories leave: columns, keys or notes."""
    items = ", ".join(f"({i}, '{item}')" for i, h in enumerate(HISTORIES) for item in getattr(h, what).split())
    return f"with items(history, item) as (values {items}), stated as (select p_partkey::varchar as project_id, replace(item, '{{k}}', p_partkey::varchar) as item from part join items on p_partkey % {len(HISTORIES)} = history)"
