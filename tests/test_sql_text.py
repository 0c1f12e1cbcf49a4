"""Tokens, statements, lint rules, translation, reports: small cases and the derived corpus."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from querylens.functions.codepages import decoded, encoded, encoding_name
from querylens.operators import report, tokens
from querylens.operators import lint as lint_rules
from querylens.operators.lint import diagnostics, findings
from querylens.operators.masks import statement_facts
from querylens.operators.tokens import MARK, pieces, raw_reason, running, statements
from querylens.operators.translate import translate, warnings
from querylens.plans import corpus as corpora
from querylens.plans.corpus import TEMPLATES
from querylens.plans.dialects import dialect_name
from querylens.plans.rules import RULES, resolve, selected
from querylens.queries import QUERIES
from querylens.sources.files import from_bytes

DOCS = "doc_id long, dialect string, target string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t.dialect, t.target, t.text.replace("{k}", "77")) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, DOCS)


def lint(spark, text, dialect="mysql", target=None, **options):
    return [(r["rule"], r["line"], r["col"]) for r in findings(spark.createDataFrame([(1, dialect, target, text)], DOCS), **options).collect()]


def test_templates_break_the_rules_they_state(corpus):
    got = {}
    for r in findings(corpus).collect():
        got.setdefault(r["doc_id"], []).append(r["rule"])
    assert {i: sorted(got.get(i, [])) for i in range(len(TEMPLATES))} == {i: sorted(t.rules) for i, t in enumerate(TEMPLATES)}


def test_every_rule_but_the_silent_ones_is_in_a_template():
    off = {r.rule for r in RULES if not r.enabled}
    assert {r for t in TEMPLATES for r in t.rules} == {r.rule for r in RULES} - off


def test_rules_that_are_off_by_default(spark):
    found = {r for r, _, _ in lint(spark, "SELECT t.* FROM t WHERE a = '5'", rules={"QL0501", "QL0506"})}
    assert found == {"QL0501", "QL0506"}
    assert lint(spark, "CREATE EVENT e DO x", "mariadb", rules={"QL0001"}) == [("QL0001", 1, 1)]


def test_places(spark):
    assert lint(spark, "SELECT id,\n  * FROM users") == [("QL0500", 2, 3)]


GOLDEN = [
    ("SELECT * FROM users", "QL0500", 1, 8), ("SELECT id FROM t1, t2 WHERE t1.x = t2.y", "QL0300", 1, 1), ("SELECT a FROM t1 NATURAL JOIN t2", "QL0302", 1, 1), ("SELECT a FROM t1 INNER JOIN t2", "QL0303", 1, 1),
    ("SELECT a FROM t1 INNER JOIN t2 ON 1 = 1", "QL0304", 1, 1), ("SELECT a FROM t1 FULL OUTER JOIN t2 ON t1.id = t2.id", "QL0306", 1, 1), ("SELECT a FROM t WHERE b = NULL", "QL0600", 1, 23), ("UPDATE users SET name = 'x'", "QL0601", 1, 8), ("DELETE FROM users", "QL0602", 1, 13),
]


def test_golden_places(spark):
    docs = spark.createDataFrame([(i, "mysql", None, text) for i, (text, *_) in enumerate(GOLDEN)] + [(99, "mysql", None, "SELECT id, name FROM users"), (100, "mysql", None, "SELECT 1;\n SELECT 'é\n', /* x */ *\nFROM t; SELECT *")], DOCS)
    got = sorted((r["doc_id"], r["rule"], r["line"], r["col"]) for r in findings(docs).collect())
    assert got == [(i, *want) for i, (_, *want) in enumerate(GOLDEN)] + [(100, "QL0500", 3, 12), (100, "QL0500", 4, 16)]


def test_statements_that_no_rule_knows(spark):
    docs = spark.createDataFrame([(1, "mysql", None, "SELECT a FROM FROM t"), (2, "mysql", None, "SELECT 1 )("), (3, "mysql", None, "FROB x; SELECT 1"), (4, "postgres", None, "CREATE FUNCTION f() BEGIN IF a THEN SELECT CASE WHEN b THEN 1 END; END IF; END; SELECT 2"), (5, "mysql", None, "BEGIN; SELECT 1; END")], DOCS)
    got = {}
    for r in statements(docs).collect():
        got.setdefault((r["doc_id"], r["status"]), []).append(r["kind"])
    assert got == {(1, "parse_error"): ["SELECT"], (2, "parse_error"): ["SELECT"], (3, "ok"): ["UNKNOWN", "SELECT"], (4, "ok"): ["CREATE", "SELECT"], (5, "ok"): ["BEGIN", "SELECT", "END"]}


def test_running_sums(spark):
    row = spark.range(1).select(running(F.sequence(F.lit(1), F.lit(2500))).alias("s"), running(F.array().cast("array<int>")).alias("e")).first()
    assert row["s"] == [k * (k + 1) // 2 for k in range(2500)] and row["e"] == []


def test_any_sequence_of_tokens_is_linted(spark):
    """No text makes the job fail, and none is lost but those that are broken."""
    pool = ["SELECT", "FROM", "WHERE", "a", "t.b", "`x.y`", "[q.r]", ".", "..", "(", ")", ",", "*", "t.*", "=", "NULL", "'s'", "'%x'", "1", "AND", "OR", "NOT", "IN", "JOIN", "ON", "USING", "INSERT INTO", "VALUES", "UPDATE", "SET", "CREATE TABLE", "INT", "COUNT", "CASE", "END", "BEGIN", ";", "WITH", "UNION", "LIMIT", "ORDER BY", "GROUP BY", "RETURNING", "::", '"z"', "-- c\n", "/* k */", "{", "\x00", "é"]
    deal = random.Random(5)
    rows = [(i, ("mysql", "mariadb", "postgres", "mssql", "sqlite", "generic")[i % 6], (None, "mysql")[i % 2], " ".join(deal.choices(pool, k=deal.randint(1, 25)))) for i in range(400)]
    rows += [(1000, "postgres", None, "SELECT (c).a.b, (f(x)).y FROM t WHERE ((t).k = NULL)"), (1001, "generic", None, "SELECT [a.b] FROM t WHERE [c.d] = 1 AND . = 2")]
    docs = spark.createDataFrame(rows, DOCS)
    got = findings(docs, rules={r.rule for r in RULES}).collect()
    assert [(r["rule"], r["line"]) for r in got if r["doc_id"] == 1000] == [("QL0600", 1)]
    assert all(r["line"] >= 1 and r["col"] >= 1 for r in got)
    joined = statements(docs).select("doc_id", F.array_join("toks", "").alias("text")).collect()
    texts = {i: t.replace("\x01", " ") for i, _, _, t in rows}
    assert all(r["text"] in texts[r["doc_id"]] for r in joined)
    assert translate(docs.where("target is not null")).count() == 200


def test_messages_say_details(spark):
    docs = spark.createDataFrame([(1, "mysql", None, "SELECT a FROM b, c, d"), (2, "mariadb", "mysql", "CREATE EVENT e DO x"), (3, "mysql", None, "CREATE TABLE t (a INT); SELECT t.z FROM t")], DOCS)
    got = {(r["doc_id"], r["rule"]): r["message"] for r in diagnostics(docs).collect()}
    assert got[1, "QL0300"].endswith("(3 relations)") and got[2, "QL0204"].endswith("(create_event)") and got[3, "QL0900"].endswith("(t.z)")


def test_equal_names_in_many_documents(spark):
    """Each document's own tables count, not those of the same name elsewhere; the catalog's are for all."""
    docs = spark.createDataFrame([(i, "generic", None, f"CREATE TABLE t (c{i} INT NOT NULL); SELECT x.c1, COUNT(x.c{i}) FROM t x") for i in range(4)], DOCS)
    assert sorted((r["doc_id"], r["rule"]) for r in findings(docs).collect()) == [(0, "QL0505"), (0, "QL0900"), (1, "QL0505"), (2, "QL0505"), (2, "QL0900"), (3, "QL0505"), (3, "QL0900")]
    catalog = spark.createDataFrame([("v", "a", False), ("v", "b", True)], "table_key string, column_key string, nullable boolean")
    used = spark.createDataFrame([(1, "generic", None, "SELECT v.q FROM v"), (2, "generic", None, "SELECT COUNT(v.a), COUNT(v.b) FROM v")], DOCS)
    assert sorted((r["doc_id"], r["rule"], r["col"]) for r in findings(used, catalog=catalog).collect()) == [(1, "QL0900", 10), (2, "QL0505", 20)]


def test_catalog_silences_not_in(spark):
    catalog = spark.createDataFrame([("u", "b", False)], "table_key string, column_key string, nullable boolean")
    assert lint(spark, "SELECT a FROM t WHERE a NOT IN (SELECT b FROM u)", catalog=catalog) == []
    assert lint(spark, "SELECT u.q FROM u", catalog=catalog)[0][0] == "QL0900"


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "mysql", None, ""), (2, "mysql", None, None), (3, "mysql", None, " ; -- x\n;")], DOCS)
    assert statements(docs).count() == 0
    assert findings(docs).count() == 0


def test_pieces_lose_nothing(spark):
    texts = ["SELECT 'it''s' -- c\n, `a`", "x;'unclosed", "$$;$$ /* a ; */ \"b\"", "E'\\'';é日本 1.5e3"]
    docs = spark.createDataFrame([(i, d, None, t) for i, t in enumerate(texts) for d in ("mysql", "mariadb", "postgres", "mssql")], DOCS)
    assert docs.where(F.array_join(pieces(F.col("dialect"), F.col("text")), "") != F.col("text")).count() == 0


def test_statements_and_lines(spark):
    text = "SELECT 'a;b';\n-- c;\nSELECT /* ; */ `x;y`;\n"
    got = statements(spark.createDataFrame([(1, "mysql", None, text)], DOCS)).orderBy("stmt").collect()
    assert [(r["stmt"], r["start_line"]) for r in got] == [(0, 1), (1, 2)]
    assert got[0]["sql"] == "SELECT 'a;b'"


def test_conditional_comments_of_mariadb(spark):
    docs = spark.createDataFrame([(1, "mariadb", None, "SELECT /*!50000 a, */ b /* c */")], DOCS)
    assert statements(docs).first()["shape"].split(MARK) == ["SELECT", "a", ",", "b"]


def test_a_broken_document_is_alone(spark):
    docs = spark.createDataFrame([(1, "mysql", None, "SELECT 1; SELECT (2"), (2, "mysql", None, "SELECT * FROM t"), (3, "mariadb", None, "SELECT 1; SELECT (2")], DOCS)
    status = {(r["doc_id"], r["stmt"]): (r["status"], r["is_raw"]) for r in statements(docs).collect()}
    assert status == {(1, 0): ("parse_error", False), (1, 1): ("parse_error", False), (2, 0): ("ok", False), (3, 0): ("ok", False), (3, 1): ("ok", True)}
    assert {r["doc_id"] for r in findings(docs).collect()} == {2}


def test_raw_reasons(spark):
    cases = {
        "CREATE TABLE t (a INT) WITH SYSTEM VERSIONING": "system_versioning", "SELECT * FROM t FOR SYSTEM_TIME ALL": "temporal_query", "CREATE OR REPLACE PACKAGE p": "create_package",
        "CREATE SEQUENCE s NOCACHE": "sequence_options", "CREATE TABLE t (v VECTOR(3))": "vector_type", "DELIMITER //": "delimiter", "CREATE TRIGGER x": "stored_program_body",
        "/*!40000 ALTER TABLE t DISABLE KEYS": "optimization_hint", "CREATE DEFINER=`a` VIEW v": "definer_clause", "CREATE EVENT e": "create_event", "FROB": "unrepresented",
    }
    rows = spark.createDataFrame(list(cases.items()), "sql string, want string")
    assert rows.where(raw_reason(F.col("sql")) != F.col("want")).count() == 0


def test_explanations():
    assert report.explain("select-star").startswith("QL0500 select-star\ncategory: perf\n")
    with pytest.raises(ValueError):
        report.explain("nothing")


def test_rule_selection():
    assert resolve("500") == resolve("0500") == resolve("select-star") == "QL0500"
    assert "QL0501" in selected(enable=["501"], disable=["501"]) and "QL0500" not in selected(disable=["select-star"])
    assert len(RULES) == 45 and len(selected()) == 41 and "QL0001" in selected(verbose=True)
    with pytest.raises(ValueError):
        resolve("nothing")
    assert dialect_name("TSQL") == "mssql"
    with pytest.raises(ValueError):
        dialect_name("oracle")


def test_translation(spark):
    rows = [(1, "mariadb", "mysql", "INSERT INTO t (a)\n VALUES (1) RETURNING a; SELECT 1"), (2, "mariadb", "postgres", "DELETE FROM t RETURNING a"), (3, "mariadb", "postgres", "CREATE TABLE t (a INT) WITH SYSTEM VERSIONING;")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["sql"], r["codes"], r["exit_code"]) for r in translate(docs).collect()}
    assert got[1] == ("INSERT INTO t (a)\n VALUES (1);\nSELECT 1", ["RETURNING_DROPPED"], 0)
    assert got[2] == ("DELETE FROM t RETURNING a", [], 0)
    assert got[3] == ("CREATE TABLE t (a INT) WITH SYSTEM VERSIONING", ["RAW_PASSTHROUGH"], 0)
    strict = {r["doc_id"]: (r["sql"], r["exit_code"]) for r in translate(docs, strict=True).collect()}
    assert strict[1] == (None, 3) and strict[2] == ("DELETE FROM t RETURNING a", 0)
    assert warnings(docs).count() == 2


def test_codepages(spark):
    every = spark.createDataFrame([(i, bytearray([i])) for i in range(256)], "b int, content binary")
    got = {r["b"]: r["t"] for r in every.select("b", decoded(F.col("content"), "latin1").alias("t")).collect()}
    assert all(got[i] == bytes([i]).decode("cp1252") for i in range(256) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    back = every.where(encoded(decoded(F.col("content"), "cp1252"), "cp1252") != F.col("content"))
    assert back.count() == 0
    one = spark.createDataFrame([("café €",), ("日",), (None,)], "t string").select(encoded(F.col("t"), "latin1").alias("c")).collect()
    assert [r["c"] and bytes(r["c"]) for r in one] == [b"caf\xe9 \x80", None, None]
    rows = from_bytes(spark.createDataFrame([(1, bytearray(b"SELECT 'caf\xe9'"))], "doc_id long, content binary"), "mysql")
    assert rows.first()["status"] == "encoding_error"
    assert encoding_name("UTF_8") == "utf-8"
    with pytest.raises(ValueError):
        encoding_name("ebcdic")


def test_reports(spark):
    docs = spark.createDataFrame([(1, "mysql", None, "SELECT * FROM users"), (2, "mysql", None, "SELECT a FROM t")], DOCS)
    found = diagnostics(docs)
    text = {r["doc_id"]: r["report"] for r in report.report(docs, found).collect()}
    assert text[1].splitlines()[0].startswith("input:1:8: info [QL0500]") and text[2] == "0 diagnostics"
    made = {r["doc_id"]: json.loads(r["report"]) for r in report.report(docs, found, "json").collect()}
    assert made[1]["diagnostics"][0]["span"]["start"] == {"line": 1, "column": 8} and made[2]["diagnostics"] == []
    sarif = {r["doc_id"]: json.loads(r["report"]) for r in report.report(docs, found, "sarif").collect()}
    assert sarif[1]["runs"][0]["results"][0]["level"] == "note" and len(sarif[1]["runs"][0]["tool"]["driver"]["rules"]) == 45
    assert "       ^" in {r["doc_id"]: r["report"] for r in report.report(docs, found, "pretty").collect()}[1]
    assert {r["doc_id"]: r["exit_code"] for r in report.exit_codes(docs, found, "info").collect()} == {1: 1, 2: 0}
    assert report.shown(found, "warning").count() == 0


def test_long_texts_take_time_in_proportion(spark):
    """Thousands of statements in one text: places and kinds are right, and nothing is evaluated again for each statement."""
    n = 30_000
    text = "".join(f"SELECT 'é;' AS x, {i}; -- next\n" for i in range(n))
    docs = spark.createDataFrame([(1, "mysql", None, text)], DOCS)
    began = time.monotonic()
    got = statements(docs).groupBy("kind", "status").agg(F.count("*").alias("n"), F.max("start_line").alias("last"), F.max("lead").alias("lead")).collect()
    assert [tuple(r) for r in got] == [("SELECT", "ok", n, n - 1, 18 + len(str(n - 1)) + 1)]
    assert time.monotonic() - began < 60


def test_texts_that_differ_in_numbers_are_linted_once(spark, monkeypatch):
    """With the findings that each text has by itself: places, details and equality of numbers and names, types named by digits, long texts."""
    ks = (1, 10, 1001, 12345678901)
    texts = [
        "SELECT a{k}, `b{k}` FROM t{k}\nJOIN u ON {k} = 10 WHERE x{k} = {k} AND b = NULL", "CREATE TABLE t{k} (a INT, price{k} FLOAT8, cost FLOAT{k}); SELECT x.z{k}, x.a FROM t{k} x", "CREATE TABLE t{k} (a INT, price{k} REAL);\n\n SELECT x.z{k}, x.a FROM t{k} x, v{k}",
        "SELECT 1 /* {k} */; SELECT * FROM t WHERE c = '{k}\n{k}' AND d = NULL", "SELECT a FROM t WHERE x{k} = 1 OR x1 = 2", "'{k}", ";{k}", "SELECT * FROM t -- " + "{k} " * 1500, " ".join(f"SELECT {i}, * FROM t{i};" for i in range(70)), None, "",
    ]
    rows = [(1000 * j + i, d, None, t and t.replace("{k}", str(k))) for j, t in enumerate(texts) for i, k in enumerate(ks) for d in ("mysql", "postgres")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("doc_id", F.monotonically_increasing_id()).localCheckpoint()
    listed = lambda df: sorted(map(str, df.collect()))
    cols = ["doc_id", "stmt", "rule", "line", "col", "detail"]
    rules = {r.rule for r in RULES}
    seen, plain = [], lint_rules.text_findings
    monkeypatch.setattr(lint_rules, "text_findings", lambda masks, *more: seen.append(masks.count()) or plain(masks, *more))
    assert listed(findings(docs, rules=rules).select(cols)) == listed(plain(docs, rules, None).select(cols))
    assert seen[0] < len(rows) / 1.5
    facts = ["doc_id", "dialect", "target", "stmt", "kind", "is_raw", "raw_reason", "status"]
    assert listed(statement_facts(docs).select(facts)) == listed(statements(docs).select(facts))


@pytest.fixture(scope="module")
def dealt(spark):
    """Texts of many tasks with their diagnostics."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpora, "TASK_KEYS", 100)
        docs = corpora.corpus(spark, "/root/testdata/sf0.001")
    return docs, diagnostics(docs)


#: What the queries make of the diagnostics of each document.
MADE = {
    "lint_findings": lambda docs, found: found.groupBy("doc_id", "rule").agg(F.count("*").alias("n")),
    "lint_by_rule": lambda docs, found: report.by_rule(found),
    "lint_exit_codes": lambda docs, found: report.exit_codes(docs, found, "warning").groupBy("exit_code").agg(F.count("*").alias("n")),
    "lint_help_dedup": lambda docs, found: report.with_help(found).groupBy("doc_id").agg(F.count("help").alias("n_help"), F.count("*").alias("n")),
    "lint_reports": report.text_report,
    "lint_pretty": report.pretty_report,
    "lint_json": report.json_report,
    "lint_sarif": report.sarif_report,
}


@pytest.mark.parametrize("query", MADE)
def test_tasks_keep_their_share_of_documents(spark, dealt, query):
    """Nothing is dealt by document again, to a number of tasks that doesn't follow the table's length; the rows are those of texts dealt otherwise."""
    docs, found = dealt
    made = MADE[query](docs, found)
    assert not re.search(r"hashpartitioning\(doc_id[^\n]*ENSURE_REQUIREMENTS", made._jdf.queryExecution().executedPlan().toString())
    shares = [r["count"] for r in found.select("doc_id").distinct().groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 10 and max(shares) < 200
    other = MADE[query](docs.repartition(3), found.repartition(3))
    assert sorted(map(str, made.collect())) == sorted(map(str, other.collect()))


def _long_texts() -> list[tuple]:
    """Statements of all kinds in changing order, with what may go wrong where a text is cut."""
    bits = [
        "SELECT 'é;' AS x, {i};", " -- next; 'one\n", "\n\n/* a;\nb */", ";;", "SELECT `a;b`, \"c;\nd\" FROM t{i};", "\t", "INSERT INTO t VALUES ('a\\';b', 'it''s;');", "# it's;\n", "SELECT $q$ ; $q$, $a$;$b$;$a$;", "SELECT [a;b];",
        "/*!50000 SELECT {i}; */", "FROB {i};", "CREATE SEQUENCE s{i} NOCACHE;", "SELECT 😀{i};\n", "ALTER TABLE t DISABLE KEYS;",
    ]
    bodies = ["CREATE PROCEDURE p{i}() BEGIN SELECT 1; IF a THEN SELECT CASE b WHEN 1 THEN 2 END; END IF; END;", "END;", "BEGIN TRANSACTION;", "END;IF x;", "END;CASE;", "CREATE TRIGGER g{i} BEFORE INSERT ON t BEGIN UPDATE u SET a = 1;\n", "COMMIT;BEGIN;"]
    broken = ["SELECT (1;", "SELECT 1 FROM WHERE;"]
    rnd, rows = random.Random(5), []
    for bag in (bits, bits + bodies, bits + bodies + broken):
        for _ in range(6):
            rows.append("".join(rnd.choice(bag).replace("{i}", str(i)) for i in range(60)))
    rows += ["\n" + rows[0] + "SELECT 'open; \n SELECT 1;", rows[1] + "/* open; ", rows[0], "", None, ";", "SELECT 1", rows[2] + "SELECT $q$; " * 3]
    return [(100 * i + j, d, None, t) for i, t in enumerate(rows) for j, d in enumerate(("mysql", "mariadb", "postgres", "sqlite", None))] + [(7, "mysql", "postgres", rows[0]), (7, "mysql", None, rows[0])]


@pytest.mark.parametrize("size", [1, 50])
def test_long_texts_in_parts_have_the_statements_of_the_whole(spark, monkeypatch, size):
    """All columns are equal: numbers, lines and places of statements, bodies of programs, what a broken or raw statement says of its text."""
    docs = spark.createDataFrame(_long_texts(), DOCS).localCheckpoint()
    monkeypatch.setattr(tokens, "LONG", 0)
    monkeypatch.setattr(tokens, "PART_PIECES", size)
    cut = tokens.parts(docs).select("doc_id", "dialect", "part", "text").collect()
    texts = {}
    for r in sorted(cut, key=lambda r: (r["doc_id"], r["part"])):
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert all("".join(texts[i]) in (t or "", 2 * (t or "")) for i, _, _, t in _long_texts() if i != 7)
    assert size > 1 or max(map(len, texts.values())) > 20
    listed = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    expected = listed(statements(docs))
    assert len(expected) > 3000
    assert listed(tokens.long_statements(docs)) == expected


def test_a_task_holds_a_part_of_a_long_text(spark, monkeypatch, tmp_path):
    """The files of the query come as rows of a bounded number of pieces, in all tasks."""
    held, plain = [], tokens._statement_arrays

    def spied(rows, ids):
        held.extend(rows.select(F.size(pieces(F.col("dialect"), F.col("text"))).alias("n"), F.spark_partition_id().alias("task")).collect())
        return plain(rows, ids)

    orders = spark.range(6_000).select(F.col("id").alias("o_orderkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tokens, "_statement_arrays", spied)
    monkeypatch.setattr(tokens, "PART_PIECES", 500)
    got = QUERIES["files_statements"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("SELECT", "ok", 6_000)]
    assert len(held) > 100 and max(r["n"] for r in held) <= 520 and len({r["task"] for r in held}) == 4
