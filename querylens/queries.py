"""The registered queries of the SQL analysis operators, and their SQL.

Rules are run over the derived corpus; what its templates state is held against what the rules find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.codepages import decoded, encoded
from querylens.operators import catalog, report
from querylens.operators.lint import diagnostics, findings
from querylens.operators.masks import statement_facts
from querylens.operators.tokens import long_statements, pieces
from querylens.operators.translate import translate, warnings
from querylens.plans.corpus import PARTS, TEMPLATES, composed, composed_sql, corpus, corpus_sql, stated_sql
from querylens.plans.dialects import CAPABILITIES, SUPPORTED, dialect_caps
from querylens.plans.histories import histories, histories_sql
from querylens.plans.rules import RULES, SEVERITIES
from querylens.sources.files import read_sources, write_sql
from querylens.sources.work import stored, work_path


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(corpus(spark, sf_dir))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def lint_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that are off by default as well."""
    found = findings(corpus(spark, sf_dir), rules=[r.rule for r in RULES])
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def lint_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_rule(diagnostics(corpus(spark, sf_dir)))


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(diagnostics(corpus(spark, sf_dir)))


def lint_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return report.exit_codes(docs, diagnostics(docs), "warning").groupBy("exit_code").agg(F.count("*").alias("n"))


def lint_help_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = report.with_help(diagnostics(corpus(spark, sf_dir)))
    return shown.groupBy("doc_id").agg(F.count("help").alias("n_help"), F.count("*").alias("n"))


def lint_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in nested parentheses, in all kinds of statements: what their parts break, and nothing else."""
    of_place = ("QL0402", "QL0601", "QL0602")
    found = findings(composed(spark, sf_dir), rules=[r.rule for r in RULES if r.enabled and r.rule not in of_place])
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def lint_composed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the findings point: the first character of the operand, call or identifier."""
    rules = {p.rule for p in PARTS} - {"", "QL0404"}
    return findings(composed(spark, sf_dir), rules=rules).select("doc_id", "rule", "line", "col")


def _rendered(form: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark, sf_dir)
        return report.report(docs, diagnostics(docs, rules={"QL0500", "QL0600", "QL0302", "QL0601"}), form, **options)

    return run


def lint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered("text")(spark, sf_dir)


def lint_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered("pretty")(spark, sf_dir)


def lint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered("json")(spark, sf_dir)


def lint_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each report; its head, equal for all, is checked in the tests."""
    text = F.get_json_object("report", "$.runs[0].results")
    return _rendered("sarif")(spark, sf_dir).select("doc_id", text.alias("results"))


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir)


def pieces_lose_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", F.array_join(pieces(F.col("dialect"), F.col("text")), "").alias("text"))


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_facts(corpus(spark, sf_dir)).groupBy("dialect", "kind").agg(F.count("*").alias("n"))


def raw_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_facts(corpus(spark, sf_dir)).where("is_raw").select("doc_id", "stmt", "raw_reason")


def translate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).where("target is not null")
    return translate(docs).select("doc_id", "sql", F.array_join("codes", ",").alias("codes"), "exit_code")


def translate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warnings(corpus(spark, sf_dir).where("target is not null")).select("doc_id", "stmt", "code")


def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of DDL for each part: it creates, changes and renames a table of its own."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("CREATE DATABASE shop; USE shop; CREATE TABLE t"), key, F.lit(" (id INT NOT NULL, price DECIMAL(10,2), PRIMARY KEY (id), UNIQUE KEY u1 (price)); ALTER TABLE t"), key,
        F.lit(" ADD COLUMN c"), F.col("p_size").cast("string"), F.lit(" VARCHAR(20) NOT NULL, DROP COLUMN price; ALTER TABLE t"), key, F.lit(" RENAME TO r"), key, F.lit("; DROP TABLE gone"),
    )
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("doc_id"), key.alias("project_id"), F.lit(0).cast("long").alias("file_ord"), F.lit("mysql").alias("dialect"), F.lit(None).cast("string").alias("target"), text.alias("text"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_columns(catalog.build_catalog(_ddl(spark, sf_dir)))


def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.catalog_indexes(catalog.build_catalog(_ddl(spark, sf_dir)))
    return found.select("project_id", "table_key", F.array_join("columns", ",").alias("columns"), F.col("unique").alias("is_unique"), F.col("primary").alias("is_primary"))


def catalog_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_notes(catalog.build_catalog(_ddl(spark, sf_dir))).select("project_id", "kind", "subject")


def histories_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that all kinds of DDL leave behind."""
    found = catalog.catalog_columns(catalog.build_catalog(histories(spark, sf_dir)))
    return found.select("project_id", F.concat("table_key", F.lit("."), "column_key", F.when(F.col("nullable"), "").otherwise("!")).alias("item"))


def histories_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary keys, indexes and foreign keys."""
    entries = catalog.build_catalog(histories(spark, sf_dir))
    keys = catalog.catalog_indexes(entries).select("project_id", F.concat("table_key", F.lit(":"), F.when(F.col("primary"), "primary").otherwise(F.col("name")), F.lit("("), F.array_join("columns", ","), F.lit(")")).alias("item"))
    foreign = catalog.catalog_foreign_keys(entries).select("project_id", F.concat("table_key", F.lit("->"), "ref_db", F.lit("."), "ref_table", F.lit("("), F.array_join("ref_columns", ","), F.lit(")")).alias("item"))
    return keys.unionByName(foreign)


def histories_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of what was skipped, missing, doubled or cut short."""
    found = catalog.catalog_notes(catalog.build_catalog(histories(spark, sf_dir)))
    return found.select("project_id", F.concat("kind", F.lit("="), F.replace("subject", F.lit(" "), F.lit("_"))).alias("item"))


def histories_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by their unqualified name in capitals: in the current database, the default one, or the first."""
    entries = stored(catalog.build_catalog(histories(spark, sf_dir)), "entries")
    wanted = entries.select("project_id").distinct().select("project_id", F.explode(F.array(*(F.concat(F.lit(c), "project_id") for c in "TRUXYZ"))).alias("name"))
    return catalog.lookup(entries, wanted, "d").select("project_id", "name", "db_key")


def histories_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each project, read back from the written catalog, merged with itself."""
    entries = stored(catalog.build_catalog(histories(spark, sf_dir)), "entries")
    return catalog.summary(catalog.merged(entries, entries)).select("project_id", "n_columns", "n_notes").where("n_columns + n_notes > 0")


def files_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of SQL, read as bytes and decoded: statements of each kind and status in all of them."""
    path = work_path(spark, "sql-files")
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("SELECT 'é;' AS x, "), F.col("o_orderkey").cast("string"), F.lit("; -- next")).alias("value"))
    lines.repartition(8).write.text(path)
    docs = read_sources(spark, f"{path}/*.txt", "mysql")
    return long_statements(docs.where("status = 'ok'"), ("kind",)).groupBy("kind", "status").agg(F.count("*").alias("n"))


def written_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written in an 8-bit encoding with a line's end each, and read again."""
    path = work_path(spark, "sql-bytes")
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("SELECT 'é€' AS k"), F.col("o_orderkey").cast("string")).alias("sql"))
    write_sql(texts, path, encoding="latin1")
    return spark.read.parquet(path).select("doc_id", decoded(F.col("content"), "latin1").alias("text"), F.length("content").cast("long").alias("n_bytes"))


def caps_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_caps(spark)


def rules_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_totals(spark)


def decode_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an accent, written in an 8-bit encoding and read again; as UTF-8 they can't be read."""
    name = F.concat("c_name", F.lit(" é€"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", encoded(name, "latin1").alias("content"))
    return rows.select("c_custkey", decoded(F.col("content"), "cp1252").alias("text"), decoded(F.col("content"), "utf8").isNull().alias("utf8_fails"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (lint_findings, lint_all_rules, lint_by_rule, lint_summary, lint_exit_codes, lint_help_dedup, corpus_texts, pieces_lose_nothing, statement_kinds, raw_reasons, translate_corpus, translate_warnings, catalog_columns, catalog_indexes, catalog_notes, decode_latin1, lint_composed, lint_composed_places, lint_reports, lint_pretty, lint_json, lint_sarif, histories_columns, histories_keys, histories_notes, histories_summary, histories_lookup, files_statements, written_sql, caps_matrix, rules_by_category)
}

_SEVERITY = ", ".join(f"('{r.rule}', '{r.severity}', {SEVERITIES.index(r.severity)})" for r in RULES)
_FOUND = f"{stated_sql()}, severities(rule, severity, severity_rank) as (values {_SEVERITY}), found as (select c.doc_id, s.rule, v.severity, v.severity_rank from corpus c join stated s using (template) join severities v using (rule))"


def _kinds_of(t) -> list[str]:
    """The kinds of a template's statements, by its text."""
    if "QL0001" in t.off:
        return ["RAW"]
    if "/*!" in t.text:
        return ["SELECT", "SELECT"]
    if "PROCEDURE" in t.text:
        return ["CREATE", "SELECT"]
    return [p.split()[0] for p in t.text.split("; ") if p.split()[0].isupper() and "#" not in t.text] or ["SELECT"]


_KINDS = ", ".join(f"({i}, '{w}')" for i, t in enumerate(TEMPLATES) for w in _kinds_of(t))
#: Why each raw template is raw, by the words that make it so.
_REASONS = {"SYSTEM VERSIONING": "system_versioning", "FOR SYSTEM_TIME": "temporal_query", "PACKAGE": "create_package", "NOCACHE": "sequence_options", "VECTOR(": "vector_type", "DELIMITER": "delimiter", "TRIGGER": "stored_program_body", "DISABLE KEYS": "optimization_hint", "DEFINER=": "definer_clause", "EVENT": "create_event", "FROB": "unrepresented"}
_RAW = ", ".join(f"({i}, '{next(r for w, r in _REASONS.items() if w in t.text)}')" for i, t in enumerate(TEMPLATES) if "QL0001" in t.off)
_WARN = {"QL0200": "RETURNING_DROPPED", "QL0203": "SEQUENCE_DROPPED", "QL0204": "RAW_PASSTHROUGH"}
_WARNED = ", ".join(f"({i}, '{_WARN[r]}')" for i, t in enumerate(TEMPLATES) if t.target for r in t.rules if r in _WARN)
_CAPS = ", ".join("(" + ", ".join([f"'{d}'", *(str(c in SUPPORTED[d]).lower() for c in CAPABILITIES)]) + ")" for d in SUPPORTED)
_RULES = ", ".join(f"('{r.category}', {str(r.enabled).lower()})" for r in RULES)
_SHOWN = {r.rule: r for r in RULES}
_PLACED = ", ".join(f"({i}, '{r}', '{_SHOWN[r].severity}', '{_SHOWN[r].message}', '{_SHOWN[r].suggestion}', '{_SHOWN[r].name}', '{_SHOWN[r].category}', {col})" for i, t in enumerate(TEMPLATES) for r, col in (*(("QL0500", t.text.index("*") + 1) for r in t.rules if r == "QL0500"), *(("QL0600", t.text.index(" NULL") - 2) for r in t.rules if r == "QL0600" and "UPDATE" not in t.text and "<>" not in t.text), *(("QL0600", t.text.index("c = NULL") + 1) for r in t.rules if r == "QL0600" and "UPDATE" in t.text), *(("QL0600", t.text.index("e <> NULL") + 1) for r in t.rules if r == "QL0600" and "<>" in t.text), *((r, 1) for r in t.rules if r == "QL0302"), *((r, 8) for r in t.rules if r == "QL0601")))
#: A finding at most for each text, with its column: of text with a key before the place the key's length is added.
_ONE = f"with {corpus_sql()}, placed(template, rule, severity, message, suggestion, name, category, off) as (values {_PLACED}), shown as (select c.*, p.rule, p.severity, p.message, p.suggestion, p.name, p.category, off + case when strpos(t.pattern, '{{k}}') between 1 and off then len(c.doc_id::varchar) - 3 else 0 end as col from corpus c left join placed p using (template) join templates t using (template))"

SQL: dict[str, str] = {
    "lint_findings": f"{_FOUND} select doc_id, rule, count(*) as n from found group by all",
    "lint_all_rules": f"{stated_sql(off=True)} select rule, count(*) as n, count(distinct doc_id) as n_docs from corpus join stated using (template) group by all",
    "lint_by_rule": f"{_FOUND} select rule, severity, count(*) as n, count(distinct doc_id) as n_docs from found group by all",
    "lint_summary": f"{_FOUND} select doc_id, count_if(severity = 'error')::bigint as errors, count_if(severity = 'warning')::bigint as warnings, count_if(severity = 'info')::bigint as infos from found group by all",
    "lint_exit_codes": f"{_FOUND} select case when worst <= 1 then 1 else 0 end as exit_code, count(*) as n from corpus left join (select doc_id, min(severity_rank) as worst from found group by all) using (doc_id) group by all",
    "lint_help_dedup": f"{_FOUND} select doc_id, count(distinct rule) as n_help, count(*) as n from found group by all",
    "corpus_texts": f"with {corpus_sql()} select doc_id, dialect, target, text from corpus",
    "pieces_lose_nothing": f"with {corpus_sql()} select doc_id, text from corpus",
    "statement_kinds": f"with {corpus_sql()}, kinds(template, kind) as (values {_KINDS}) select dialect, kind, count(*) as n from corpus join kinds using (template) group by all",
    "raw_reasons": f"with {corpus_sql()}, raw(template, raw_reason) as (values {_RAW}) select doc_id, 0 as stmt, raw_reason from corpus join raw using (template)",
    "lint_composed": f"{composed_sql()} select doc_id, rule, count(*) as n from stated group by all",
    "lint_composed_places": f"{composed_sql()}, found as (select doc_id, rule, text[1:strpos(text, c) + off - 1] as before from stated where rule <> 'QL0404') select doc_id, rule, (1 + len(before) - len(replace(before, chr(10), '')))::int as line, (1 + len(string_split(before, chr(10))[-1]))::int as col from found",
    "lint_reports": f"{_ONE} select doc_id, case when rule is null then '0 diagnostics' else 'input:1:' || col || ': ' || severity || ' [' || rule || '] ' || message || chr(10) || '  help: ' || suggestion || chr(10) || '1 diagnostic (' || case severity when 'error' then '1 error, 0 warnings, 0 info' when 'warning' then '0 errors, 1 warning, 0 info' else '0 errors, 0 warnings, 1 info' end || ')' end as report from shown",
    "lint_pretty": f"{_ONE} select doc_id, case when rule is null then '0 diagnostics' else severity || ' [' || rule || '] ' || message || chr(10) || ' --> input:1:' || col || chr(10) || '  | ' || case when len(text) > 100 then text[1:100] || '…' else text end || chr(10) || '  | ' || repeat(' ', col - 1) || '^' || chr(10) || '   = help: ' || suggestion || chr(10) || '   = ' || category || ': ' || name || chr(10) || '1 diagnostic (' || case severity when 'error' then '1 error, 0 warnings, 0 info' when 'warning' then '0 errors, 1 warning, 0 info' else '0 errors, 0 warnings, 1 info' end || ')' end as report from shown",
    "lint_json": f"""{_ONE} select doc_id, '{{"source":"input","diagnostics":[' || case when rule is null then '' else '{{"rule":"' || rule || '","name":"' || name || '","category":"' || category || '","severity":"' || severity || '","message":"' || message || '","suggestion":"' || suggestion || '","source_dialect":"' || dialect || '"' || coalesce(',"target_dialect":"' || target || '"', '') || ',"span":{{"start":{{"line":1,"column":' || col || '}}}}}}' end || '],"summary":{{"errors":' || (coalesce(severity, '') = 'error')::int || ',"warnings":' || (coalesce(severity, '') = 'warning')::int || ',"infos":' || (coalesce(severity, '') = 'info')::int || '}}}}' as report from shown""",
    "lint_sarif": f"""{_ONE} select doc_id, '[' || case when rule is null then '' else '{{"ruleId":"' || rule || '","level":"' || replace(severity, 'info', 'note') || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"input"}},"region":{{"startLine":1,"startColumn":' || col || '}}}}}}]}}' end || ']' as results from shown""",
    "translate_corpus": f"with {corpus_sql()}, warned(template, code) as (values {_WARNED}) select doc_id, case code when 'RETURNING_DROPPED' then regexp_replace(text, ' RETURNING .*$', '') else replace(text, chr(10) || '; ', ';' || chr(10)) end as sql, coalesce(code, '') as codes, 0 as exit_code from corpus left join warned using (template) where target is not null",
    "translate_warnings": f"with {corpus_sql()}, warned(template, code) as (values {_WARNED}) select doc_id, 0 as stmt, code from corpus join warned using (template)",
    "catalog_columns": """select p_partkey::varchar as project_id, 'shop' as db_key, 'r' || p_partkey as table_key, x.key as column_key, x.key as name, x.kind as data_type, false as nullable
        from part, lateral (values ('id', 'INT'), ('c' || p_size, 'VARCHAR(20)')) x(key, kind)""",
    "catalog_indexes": "select p_partkey::varchar as project_id, 'r' || p_partkey as table_key, 'id' as columns, true as is_unique, true as is_primary from part",
    "catalog_notes": "select p_partkey::varchar as project_id, 'missing_table' as kind, 'gone' as subject from part",
    **{f"histories_{what}": f"{histories_sql(what)} select project_id, item from stated" for what in ("columns", "keys", "notes")},
    "histories_lookup": f"{histories_sql('columns')}, found as (select distinct project_id, split_part(item, '.', 1) as t from stated) select project_id, upper(t) as name, case when t[1] in ('x', 'z') then 'd' else '' end as db_key from found",
    "histories_summary": f"{histories_sql('columns')}, noted as (select project_id, count(*) as n from ({histories_sql('notes')} select project_id from stated) group by all) select project_id, count(*) as n_columns, coalesce(any_value(n), 0)::bigint as n_notes from stated left join noted using (project_id) group by all",
    "files_statements": "select 'SELECT' as kind, 'ok' as status, count(*) as n from orders",
    "written_sql": "select o_orderkey as doc_id, 'SELECT ''é€'' AS k' || o_orderkey || chr(10) as text, (17 + len(o_orderkey::varchar))::bigint as n_bytes from orders",
    "caps_matrix": f"select * from (values {_CAPS}) t(dialect, {', '.join(CAPABILITIES)})",
    "rules_by_category": f"select category, count(*) as n, count_if(enabled)::bigint as n_enabled from (values {_RULES}) t(category, enabled) group by rollup (category)",
    "decode_latin1": "select c_custkey, c_name || ' é€' as text, true as utf8_fails from customer",
}

#: What rules warn of, run over the tables: each counts the flagged form and the advised one, and how often lint flags its text.
EVIDENCE = {
    "evidence_not_in_nulls": ("QL0400", """select (select count(*) from {orders} where o_custkey not in (select case when c_custkey % 7 = 0 then null else c_custkey end from {customer})) as not_in,
        (select count(*) from {orders} o where not exists (select 1 from {customer} c where c_custkey % 7 <> 0 and c.c_custkey = o.o_custkey)) as not_exists"""),
    "evidence_equals_null": ("QL0600", "select count(case when x = null then 1 end) as equals_null, count(case when x is null then 1 end) as is_null from (select nullif(p_size, 10) as x from {part}) t"),
    "evidence_count_column": ("QL0505", "select p_brand, count(x) as of_column, count(*) as of_rows from (select p_brand, nullif(p_size, 10) as x from {part}) t group by p_brand"),
    "evidence_and_or": ("QL0603", """select count(case when p_size = 1 or p_size = 2 and p_partkey % 2 = 0 then 1 end) as bare, count(case when (p_size = 1 or p_size = 2) and p_partkey % 2 = 0 then 1 end) as grouped from {part}"""),
    "evidence_or_union": ("QL0507", """select (select count(*) from {orders} where o_custkey = 7 or o_orderstatus = 'F') as with_or,
        (select count(*) from (select o_orderkey from {orders} where o_custkey = 7 union all select o_orderkey from {orders} where o_orderstatus = 'F' and o_custkey <> 7) t) as with_union"""),
    "evidence_full_outer": ("QL0306", """select (select count(*) from {customer} full outer join {orders} on c_custkey = o_custkey) as full_outer,
        (select count(*) from {customer} left join {orders} on c_custkey = o_custkey) + (select count(*) from {orders} where not exists (select 1 from {customer} where c_custkey = o_custkey)) as emulated"""),
    "evidence_group_position": ("QL0606", "select o_orderstatus as status, count(*) as n from {orders} group by 1"),
    "evidence_in_exists": ("QL0401", """select (select count(*) from {customer} where c_custkey in (select o_custkey from {orders})) as with_in,
        (select count(*) from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey)) as with_exists"""),
    "evidence_distinct_join": ("QL0505", "select (select count(distinct c_custkey) from {customer} join {orders} on c_custkey = o_custkey) as with_distinct, (select count(*) from {customer} where c_custkey in (select o_custkey from {orders})) as semi_join"),
}


def _evidence(rule: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [n for n in ("orders", "customer", "part") if "{" + n + "}" in text]
        counted = spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
        docs = spark.createDataFrame([(1, "mysql", None, text.replace("{", "").replace("}", ""))], "doc_id long, dialect string, target string, text string")
        flagged = findings(docs, rules={rule}).agg(F.count("*").alias("n_flagged"))
        return counted.join(F.broadcast(flagged))  # one row

    return run


for _name, (_rule, _text) in EVIDENCE.items():
    QUERIES[_name] = _evidence(_rule, _text)
    SQL[_name] = "select *, 1::bigint as n_flagged from (" + _text.replace("{", "").replace("}", "") + ")"
