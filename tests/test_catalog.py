"""DDL replay: one case for each kind of statement."""

import pytest
from pyspark.sql import functions as F

from querylens.operators import catalog
from querylens.operators.catalog import build_catalog, catalog_columns, catalog_foreign_keys, catalog_indexes, catalog_notes, known_columns, lookup, merged, note_texts, read_catalog, summary, write_catalog
from querylens.operators.lint import findings

DOCS = "doc_id long, project_id string, file_ord long, dialect string, target string, text string"
BASE = "CREATE TABLE t (id INT NOT NULL, a VARCHAR(10), PRIMARY KEY (id), KEY k1 (a));"
CASES = {
    "add": (BASE + "ALTER TABLE t ADD COLUMN b INT NOT NULL", {"id": False, "a": True, "b": False}),
    "drop": (BASE + "ALTER TABLE t DROP COLUMN a", {"id": False}),
    "modify": (BASE + "ALTER TABLE t MODIFY COLUMN a INT NOT NULL", {"id": False, "a": False}),
    "change": (BASE + "ALTER TABLE t CHANGE COLUMN a z INT", {"id": False, "z": True}),
    "rename_column": (BASE + "ALTER TABLE t RENAME COLUMN a TO z", {"id": False, "z": True}),
    "guarded": (BASE + "ALTER TABLE IF EXISTS nope ADD x INT; CREATE TABLE IF NOT EXISTS t (q INT)", {"id": False, "a": True}),
    "like": (BASE + "CREATE TABLE u LIKE t; DROP TABLE t", {"id": False, "a": True}),
    "replace": (BASE + "CREATE OR REPLACE TABLE t (q INT PRIMARY KEY)", {"q": False}),
    "dropped_database": ("CREATE DATABASE d; USE d; CREATE TABLE x (a INT); DROP DATABASE d; CREATE TABLE y (b INT)", {"b": True}),
}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, name, 0, "mysql", None, text) for i, (name, (text, _)) in enumerate(CASES.items())]
    extra = {
        "keys": BASE + "CREATE UNIQUE INDEX k2 ON t (a); ALTER TABLE t ADD CONSTRAINT f1 FOREIGN KEY (a) REFERENCES shop.users (id); ALTER TABLE t DROP INDEX k1; ALTER TABLE t DROP PRIMARY KEY",
        "notes": "DROP TABLE gone; CREATE VIEW v AS SELECT 1; " + BASE + BASE,
        "cursor": "CREATE DATABASE d; USE d; CREATE TABLE x (a INT); CREATE TABLE e.y (b INT); ALTER TABLE e.y RENAME TO z",
    }
    rows += [(100 + i, name, 0, "mysql", None, text) for i, (name, text) in enumerate(extra.items())]
    rows += [(200, "files", 1, "mysql", None, "ALTER TABLE t ADD b INT"), (201, "files", 0, "mysql", None, "CREATE TABLE t (a INT)")]
    return build_catalog(spark.createDataFrame(rows, DOCS)).persist()


@pytest.mark.parametrize("name", CASES)
def test_columns(entries, name):
    got = catalog_columns(entries).where(f"project_id = '{name}'").collect()
    assert {r["column_key"]: r["nullable"] for r in got} == CASES[name][1]


def test_keys(entries):
    got = catalog_indexes(entries).where("project_id = 'keys'").collect()
    assert [(r["name"], r["columns"], r["unique"]) for r in got] == [("k2", ["a"], True)]
    fk = catalog_foreign_keys(entries).where("project_id = 'keys'").first()
    assert (fk["name"], fk["columns"], fk["ref_db"], fk["ref_table"], fk["ref_columns"]) == ("f1", ["a"], "shop", "users", ["id"])


def test_notes(entries):
    got = {(r["kind"], r["subject"]) for r in catalog_notes(entries).where("project_id = 'notes'").collect()}
    assert got == {("missing_table", "gone"), ("skipped", "CREATE VIEW"), ("duplicate_table", "t")}


def test_current_database(entries):
    got = {(r["db_key"], r["table_key"]) for r in entries.where("project_id = 'cursor' and kind = 'table'").collect()}
    assert got == {("d", "x"), ("d", "z")}


def test_files_in_order(entries):
    assert {r["column_key"] for r in catalog_columns(entries).where("project_id = 'files'").collect()} == {"a", "b"}


def test_lookup_and_merge(spark, entries):
    wanted = spark.createDataFrame([("cursor", "Z"), ("cursor", "none")], "project_id string, name string")
    assert [(r["name"], r["db_key"]) for r in lookup(entries, wanted, "d").collect()] == [("Z", "d")]
    older, newer = entries.where("project_id = 'add'"), entries.where("project_id = 'add'")
    assert merged(older, newer).where("kind = 'column'").count() == 3
    both = merged(entries.where("project_id = 'notes'"), entries.where("project_id = 'notes'"))
    assert summary(both).first().asDict() == summary(entries.where("project_id = 'notes'")).first().asDict()


def test_every_prefix_of_ddl_is_replayed(spark):
    """Cut short anywhere, a statement leaves a note or does what it says; no project fails another."""
    texts = ["ALTER TABLE t ADD COLUMN b INT NOT NULL , DROP COLUMN a , RENAME COLUMN id TO z , CHANGE a b INT", "CREATE UNIQUE INDEX k2 ON d . t ( a , b )", "CREATE TABLE u LIKE t", "ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY ( a ) REFERENCES s . u ( id )", "DROP TABLE IF EXISTS t , u", "USE DATABASE d", "DROP DATABASE IF EXISTS d", "ALTER TABLE t RENAME TO e . z", "CREATE TABLE q ( a INT , PRIMARY KEY ( a ) )"]
    cut = [" ".join(t.split(" ")[: k + 1]) for t in texts for k in range(len(t.split(" ")))]
    rows = [(i, str(i), 0, "mariadb", None, BASE + c + "; CREATE TABLE last (a INT)") for i, c in enumerate(cut)]
    got = catalog_columns(build_catalog(spark.createDataFrame(rows, DOCS))).where("table_key = 'last'")
    assert got.count() == len(cut)


def test_catalog_written_and_read(spark, entries, tmp_path):
    path = str(tmp_path / "catalog")
    write_catalog(entries, path)
    back = read_catalog(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, entries.collect()))
    docs = spark.createDataFrame([(1, "mysql", None, "SELECT z.q, z.b FROM z")], "doc_id long, dialect string, target string, text string")
    assert [(r["rule"], r["col"]) for r in findings(docs, catalog=known_columns(back.where("project_id = 'cursor'"))).collect()] == [("QL0900", 10)]
    assert note_texts(back).where("text is null").count() == 0
    back.withColumn("version", F.lit(2)).write.mode("append").partitionBy("version").parquet(path)
    with pytest.raises(ValueError):
        read_catalog(spark, path)


def test_projects_that_differ_in_numbers_are_replayed_once(spark, monkeypatch):
    """With the entries that a replay of each project gives: equal and different numbers, several files, odd places, types named by digits, long texts."""
    rows = []
    for k in (7, 8, 10, 1001, 20_000_000_000):
        rows += [(f"a{k}", k + 5, f"ALTER TABLE t{k} RENAME TO r{k}; DROP TABLE gone{k}"), (f"a{k}", k, f"CREATE TABLE t{k} (id INT, c{k} VARCHAR({k}), PRIMARY KEY (id), KEY k1 (c{k})); ALTER TABLE t{k} DROP COLUMN q")]
        rows += [(f"b{k}", 0, f"CREATE TABLE t10 (a DECIMAL(10,{k})); CREATE TABLE u (b INT REFERENCES t{k}); DROP TABLE t{k}; ALTER TABLE u ADD FOREIGN KEY (b) REFERENCES d{k}.t{k} (x{k})"), (f"c{k}", None, f"CREATE TABLE f (a FLOAT8, b FLOAT{k})")]
        rows += [(f"d{k}", 3, "".join(f"CREATE TABLE t{i} (c{k} INT); " for i in range(200)))]
    rows += [(None, 1, "CREATE TABLE n1 (a INT)"), (None, 2, "DROP TABLE n1; CREATE TABLE n2 (a1 INT)"), ("e", 1, None), ("f", 1, "CREATE TABLE")]
    docs = spark.createDataFrame([(i, *r[:2], "mysql", None, r[2]) for i, r in enumerate(rows)], "doc_id long, project_id string, file_ord long, dialect string, target string, text string")
    seen = []
    plain = catalog.replayed
    monkeypatch.setattr(catalog, "replayed", lambda units: seen.append(units.select("project_id").distinct().count()) or plain(units))
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(catalog.build_catalog(docs)) == listed(plain(docs))
    # a once, b twice (10 is equal to 10), c and d each, and three more.
    assert seen == [1 + 2 + 5 + 5 + 3]
