"""A corpus of SQL derived from the orders table: each order becomes a text by the template of its key.

Templates state which rules they break, how often. The statements are written here, not by the lint
rules, so a query's result can be held against what its templates state; but one author wrote both.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Template(NamedTuple):
    dialect: str
    target: str | None
    text: str
    rules: tuple[str, ...]
    off: tuple[str, ...] = ()  # of the rules that are off by default


T = Template
TEMPLATES = (
    T("mysql", None, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = {k}", ()),
    T("mysql", None, "SELECT * FROM orders WHERE o_orderkey = {k}", ("QL0500",)),
    T("generic", None, "SELECT o.* FROM orders o WHERE o.o_orderkey = {k}", (), ("QL0501",)),
    T("generic", None, "SELECT c_name FROM customer, orders WHERE c_custkey = o_custkey AND o_orderkey = {k}", ("QL0300",)),
    T("mysql", None, "SELECT c_name FROM customer CROSS JOIN orders", ("QL0301",)),
    T("mysql", None, "SELECT c_name FROM customer CROSS JOIN orders WHERE o_orderkey = {k}", ()),
    T("mysql", None, "SELECT a FROM t1 NATURAL JOIN t2", ("QL0302",)),
    T("mysql", None, "SELECT a FROM t1 INNER JOIN t2", ("QL0303",)),
    T("mysql", None, "SELECT a FROM t1 JOIN t2 ON 1 = 1", ("QL0304",)),
    T("mysql", None, "SELECT a FROM t1 JOIN t2 ON (TRUE)", ("QL0304",)),
    T("postgres", None, "SELECT a FROM t1 JOIN t2 ON t1.k = t2.k AND t1.v = {k}", ()),
    T("postgres", None, 'SELECT a FROM t1 JOIN t2 USING ("id")', ("QL0305",)),
    T("mysql", None, "SELECT a FROM t1 FULL OUTER JOIN t2 ON t1.id = t2.id", ("QL0306",)),
    T("postgres", None, "SELECT a FROM t1 FULL OUTER JOIN t2 ON t1.id = t2.id", ()),
    T("generic", None, "SELECT a FROM t1, t2 JOIN t3 ON t2.id = t3.id", ("QL0300", "QL0307")),
    T("generic", None, "SELECT a FROM t WHERE a NOT IN (SELECT b FROM u WHERE b > {k})", ("QL0400",)),
    T("generic", None, "CREATE TABLE u (b INT NOT NULL); SELECT a FROM t WHERE a NOT IN (SELECT b FROM u)", ()),
    T("generic", None, "SELECT a FROM t WHERE a IN (SELECT b FROM u)", ("QL0401",)),
    T("generic", None, "SELECT a, (SELECT MAX(b) FROM u) AS m FROM t", ("QL0402",)),
    T("generic", None, "SELECT a FROM (SELECT b AS a FROM u ORDER BY b) AS s", ("QL0403",)),
    T("generic", None, "SELECT a FROM (SELECT b AS a FROM u ORDER BY b LIMIT 5) AS s", ()),
    T("generic", None, "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.x = t.x)", ("QL0404",)),
    T("generic", None, "SELECT a FROM t WHERE name LIKE '%{k}'", ("QL0502",)),
    T("generic", None, "SELECT a FROM t WHERE name LIKE '{k}%'", ()),
    T("generic", None, "SELECT a FROM t WHERE YEAR(d) = {k}", ("QL0503",)),
    T("generic", None, "SELECT a FROM t WHERE {k} = UPPER(name, 2)", ("QL0503",)),
    T("generic", None, "SELECT DISTINCT a FROM t JOIN u ON t.x = u.x", ("QL0504",)),
    T("generic", None, "SELECT COUNT(a), COUNT(*) FROM t", ("QL0505",)),
    T("generic", None, "SELECT COUNT(DISTINCT a) FROM t", ("QL0505",)),
    T("generic", None, "CREATE TABLE t (a INT NOT NULL, c INT); SELECT COUNT(a), COUNT(c) FROM t", ("QL0505",)),
    T("generic", None, "SELECT a FROM t WHERE a = {k} OR b = {k}", ("QL0507",)),
    T("generic", None, "SELECT a FROM t WHERE a = 1 OR a = {k}", ()),
    T("generic", None, "SELECT a FROM t WHERE b = NULL", ("QL0600",)),
    T("generic", None, "SELECT a FROM t WHERE b IS NOT NULL AND c = {k}", ()),
    T("mysql", None, "UPDATE users SET name = 'x{k}'", ("QL0601",)),
    T("mysql", None, "UPDATE users SET name = NULL WHERE id = {k}", ()),
    T("mysql", None, "DELETE FROM users", ("QL0602",)),
    T("mysql", None, "DELETE FROM users WHERE id = {k}", ()),
    T("generic", None, "SELECT a FROM t WHERE a = 1 OR a = 2 AND b = {k}", ("QL0603",)),
    T("generic", None, "SELECT a FROM t WHERE (a = 1 OR a = 2) AND b BETWEEN 1 AND {k}", ()),
    T("generic", None, "SELECT a, b FROM t ORDER BY 1, 2 DESC", ("QL0604", "QL0604")),
    T("generic", None, "SELECT a FROM t HAVING COUNT(*) > {k}", ("QL0605",)),
    T("generic", None, "SELECT a, COUNT(*) FROM t GROUP BY 1 HAVING COUNT(*) > {k}", ("QL0606",)),
    T("generic", None, "SELECT a FROM (SELECT b AS a FROM u)", ("QL0701",)),
    T("generic", None, "SELECT a FROM t LIMIT {k}", ("QL0704",)),
    T("generic", None, "SELECT a FROM t ORDER BY a LIMIT {k}", ()),
    T("mysql", None, "CREATE TABLE p{k} (id INT, unit_price FLOAT, note VARCHAR, code VARCHAR(8))", ("QL0801", "QL0802")),
    T("generic", None, "CREATE TABLE t (a INT); SELECT x.a, x.z FROM t x WHERE x.a = {k}", ("QL0900",)),
    T("generic", None, "CREATE TABLE t (a INT, b INT); INSERT INTO t (a, q) VALUES ({k}, 2)", ("QL0900",)),
    T("postgres", None, "SELECT `a` FROM t WHERE `b` = {k}", ("QL0100", "QL0100")),
    T("generic", None, "SELECT [a] FROM t WHERE b = {k}", ("QL0101",)),
    T("mssql", None, "SELECT TOP 10 [a] FROM t WHERE b = {k}", ()),
    T("mysql", None, "SELECT a::int FROM t WHERE b = {k}", ("QL0102",)),
    T("postgres", None, "INSERT INTO t (a) VALUES ({k}) ON DUPLICATE KEY UPDATE a = 1", ("QL0103",)),
    T("mysql", None, "INSERT INTO t (a) VALUES ({k}) RETURNING a", ("QL0104",)),
    T("mariadb", "mysql", "INSERT INTO t (a) VALUES ({k}) RETURNING a", ("QL0200",)),
    T("mariadb", "postgres", "INSERT INTO t (a) VALUES ({k}) RETURNING a", ()),
    T("mysql", "postgres", "INSERT INTO t (a) VALUES ({k}) ON DUPLICATE KEY UPDATE a = a + 1", ("QL0201",)),
    T("postgres", "mysql", "INSERT INTO t (a) VALUES ({k}) ON CONFLICT (a) DO UPDATE SET a = EXCLUDED.a", ("QL0202",)),
    T("postgres", "mysql", "CREATE SEQUENCE s{k} START WITH {k}", ("QL0203",)),
    T("mariadb", "postgres", "CREATE TABLE a{k} (id INT) WITH SYSTEM VERSIONING", ("QL0204",), ("QL0001",)),
    T("mariadb", "mariadb", "SELECT /*!50000 a, */ b FROM t WHERE c = {k} -- it's\n; SELECT 1", ()),
    T("generic", None, "SELECT [a.b].c FROM [a.b] WHERE ([a.b].d = 'x' AND ((e <> NULL)))", ("QL0101", "QL0101", "QL0600"), ("QL0506",)),
    T("generic", None, "CREATE TABLE t (a INT); SELECT s.k FROM t JOIN s ON (t.z = s.k) WHERE (t.q = {k} OR t.a IN (t.b, 2))", ("QL0900", "QL0900", "QL0900")),
    T("generic", None, "SELECT a FROM t JOIN u ON ((1 = 1)) WHERE b = {k}", ("QL0304",)),
    T("mysql", None, "VACUUM t; SELECT * FROM t", ("QL0500",)),
    T("mysql", None, "CREATE PROCEDURE p{k}() BEGIN SELECT 1; UPDATE t SET a = 1 WHERE b = 2; END; SELECT * FROM t", ("QL0500",)),
    T("mysql", None, "UPDATE t SET a = NULL, b = (c = NULL) WHERE (id = {k})", ("QL0600",)),
    T("mysql", "mssql", "INSERT INTO t (a) VALUES ({k}) RETURNING a", ("QL0104", "QL0200")),
    T("mariadb", "mssql", "UPDATE t SET a = {k} WHERE b = 1 RETURNING a", ("QL0200",)),
    T("sqlite", "mysql", "DELETE FROM t WHERE b IN (1, {k}) RETURNING (a)", ("QL0200",)),
    T("mariadb", "mysql", "SELECT * FROM t FOR SYSTEM_TIME ALL WHERE a = {k}", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE OR REPLACE PACKAGE p{k} AS x INT", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE SEQUENCE s{k} NOCACHE", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE TABLE t{k} (v VECTOR(3))", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "DELIMITER //", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE TRIGGER x{k} BEFORE INSERT ON t FOR EACH ROW SET NEW.a = 1", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "/*!40000 ALTER TABLE t{k} DISABLE KEYS */", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE DEFINER=`a` VIEW v{k} AS SELECT 1", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "CREATE EVENT e{k} DO x", ("QL0204",), ("QL0001",)),
    T("mariadb", "mysql", "FROB {k}", ("QL0204",), ("QL0001",)),
    T("mysql", None, 'SELECT a FROM t WHERE b = "x;y" # a comment; with SELECT *\n AND c = {k}', (), ("QL0506",)),
)

class Part(NamedTuple):
    """A condition, the rule it breaks, whether only in the WHERE of a select, and at which of its characters."""

    text: str
    rule: str
    of_where: bool = False
    at: int = 0


P = Part
PARTS = (
    P("b = NULL", "QL0600"), P("NULL <> t.b", "QL0600"), P("IF(b = NULL, 1, 2) > z", "QL0600", at=3), P("CASE WHEN b != NULL THEN 1 ELSE 2 END > z", "QL0600", at=10), P("name LIKE '%x'", "QL0502"), P("name NOT LIKE '%x'", "QL0502"),
    P("YEAR(d) = 2", "QL0503", True), P("LEFT(t.name, 3) < 'abc'", "QL0503", True), P("5 >= MOD(7, b)", "QL0503", True), P("a = 1 OR b = 2", "QL0507"), P("x.y.a = 1 OR x.y.b = 2", "QL0507"), P("a IN (SELECT b FROM u)", "QL0401"),
    P("a NOT IN (SELECT b FROM u)", "QL0400"), P("COUNT(a) + 0 > 1", "QL0505"), P("0 + COUNT(DISTINCT t.a) > 1", "QL0505", at=4), P("`b` = 1", "QL0100"), P("z > LENGTH(`b`) + 1", "QL0100", at=11), P("t.[b] = 1", "QL0101", at=2),
    P("EXISTS (SELECT 1 FROM u WHERE (u.x = 1))", "QL0404", True), P("(SELECT MAX(b) FROM u WHERE u.x = 1 AND y = 2) > z", "QL0404", True), P("a = 1 AND b = 2", ""), P("b IS NULL", ""), P("f(NULL) = z", ""), P("(a = 1 OR a = 2) AND z BETWEEN 1 AND 2", ""),
)
WRAPS = ("({c})", "NOT ({c})", "(({c}) AND z = 1)", "z > 0 AND ({c})", "((z = 1) OR (({c})))")
#: Statements and whether their condition is the WHERE of a select.
PLACES = (("SELECT a FROM t WHERE {c}", True), ("SELECT a FROM t JOIN s ON {c}", False), ("UPDATE t SET a = 1 WHERE {c}", False), ("DELETE FROM t WHERE {c}", False), ("SELECT a FROM t GROUP BY a HAVING {c}", False), ("SELECT a\n  FROM (SELECT q AS a FROM t\n WHERE {c}) AS s", True), ("INSERT INTO w (a) SELECT a FROM t WHERE {c}", True))


#: Keys in one task, at most about: what a task holds doesn't grow with the table.
TASK_KEYS = 250_000


def dealt(table: DataFrame, key: str) -> DataFrame:
    """Dealt by key to all cores, and to more tasks the longer it is: reading a key is nothing beside cutting its text, and small files have few tasks.

    What is grouped, numbered or joined by document later needs no other shuffle, so tasks keep their share of keys to the end.
    """
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_KEYS)), key)


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, dialect, target, text``: for each order a statement put together from a part, a wrap and a place by its key."""
    n, m = len(PARTS), len(WRAPS)
    parts = spark.createDataFrame([(i, p.text) for i, p in enumerate(PARTS)], "part long, c string")
    wraps = spark.createDataFrame(list(enumerate(WRAPS)), "wrap long, w string")
    places = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PLACES)], "place long, s string")
    key = F.col("o_orderkey")
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    rows = orders.select(key.alias("doc_id"), (key % n).alias("part"), (F.floor(key / n) % m).alias("wrap"), (F.floor(key / (n * m)) % len(PLACES)).alias("place"))
    for small in (parts, wraps, places):
        rows = rows.join(F.broadcast(small), small.columns[0])
    return rows.select("doc_id", F.lit("generic").alias("dialect"), F.lit(None).cast("string").alias("target"), F.replace("s", F.lit("{c}"), F.replace("w", F.lit("{c}"), F.col("c"))).alias("text"))


def composed_sql() -> str:
    """What the parts break in their places, as DuckDB relation ``stated(doc_id, rule, c, off, text)``."""
    parts = ", ".join(f"({i}, '{p.rule}', {str(p.of_where).lower()}, {_quote(p.text)}, {p.at})" for i, p in enumerate(PARTS))
    wraps = ", ".join(f"({i}, {_quote(w)})" for i, w in enumerate(WRAPS))
    places = ", ".join(f"({i}, {str(w).lower()}, {_quote(s)})" for i, (s, w) in enumerate(PLACES))
    n, m = len(PARTS), len(WRAPS)
    return f"""with parts(part, rule, of_where, c, off) as (values {parts}), wraps(wrap, w) as (values {wraps}), places(place, is_where, s) as (values {places}),
stated as (select o_orderkey as doc_id, rule, c, off, replace(s, '{{c}}', replace(w, '{{c}}', c)) as text
           from orders join parts on o_orderkey % {n} = part join wraps on (o_orderkey // {n}) % {m} = wrap join places on (o_orderkey // {n * m}) % {len(PLACES)} = place
           where rule <> '' and (is_where or not of_where))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, dialect, target, text``: one text for each order; the templates are a table of fixed size."""
    rows = [(i, t.dialect, t.target, t.text) for i, t in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template long, dialect string, target string, pattern string")
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % len(TEMPLATES)).alias("template"))
    text = F.replace("pattern", F.lit("{k}"), F.col("doc_id").cast("string"))
    return orders.join(F.broadcast(templates), "template").select("doc_id", "dialect", "target", text.alias("text"))


def _quote(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def corpus_sql() -> str:
    """The same as a DuckDB relation ``corpus``, for use after WITH."""
    rows = ", ".join(f"({i}, {_quote(t.dialect)}, {_quote(t.target)}, {_quote(t.text)})" for i, t in enumerate(TEMPLATES))
    return f"""templates(template, dialect, target, pattern) as (values {rows}),
corpus as (select o_orderkey as doc_id, dialect, target, replace(pattern, '{{k}}', cast(o_orderkey as varchar)) as text, t.template
           from orders o join templates t on o.o_orderkey % {len(TEMPLATES)} = t.template)"""


def stated_sql(off: bool = False) -> str:
    """What the templates state, as DuckDB relations ``corpus`` and ``stated(template, rule)``; with the rules that are off by default or without."""
    rows = ", ".join(f"({i}, '{r}')" for i, t in enumerate(TEMPLATES) for r in (*t.rules, *(t.off if off else ())))
    return f"with {corpus_sql()}, stated(template, rule) as (values {rows})"
