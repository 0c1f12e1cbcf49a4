"""Sorting, filtering, counting and rendering of diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.plans.rules import RULES, SEVERITIES, resolve, rules_table

ORDER = ("stmt", "line", "col", "rule")
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def shown(found: DataFrame, severity: str = "info") -> DataFrame:
    """Diagnostics of this severity or worse."""
    return found.where(F.col("severity_rank") <= SEVERITIES.index(severity))


def exit_codes(docs: DataFrame, found: DataFrame, exit_on: str = "error") -> DataFrame:
    """``doc_id, exit_code``: 1 where a diagnostic reaches ``exit_on``, whatever is shown."""
    worst = found.groupBy("doc_id").agg(F.min("severity_rank").alias("worst"))
    return docs.select("doc_id").join(worst, "doc_id", "left").select("doc_id", F.when(F.col("worst") <= SEVERITIES.index(exit_on), 1).otherwise(0).alias("exit_code"))


def summary(found: DataFrame) -> DataFrame:
    """``doc_id, errors, warnings, infos``."""
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES))


def by_rule(found: DataFrame) -> DataFrame:
    """``rule, severity, n, n_docs`` over all documents."""
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def first_of(found: DataFrame, *by: str) -> Column:
    """Whether a diagnostic is its document's first of these."""
    return F.row_number().over(Window.partitionBy("doc_id", *by).orderBy(*ORDER)) == 1


def with_help(found: DataFrame, mode: str = "auto") -> DataFrame:
    """Diagnostics with ``help``: always, never, or at the first of each rule and suggestion."""
    if mode == "always":
        return found.withColumn("help", F.col("suggestion"))
    if mode == "never":
        return found.withColumn("help", F.lit(None).cast("string"))
    return found.withColumn("help", F.when(first_of(found, "rule", "suggestion"), F.col("suggestion")))


def with_snippet(found: DataFrame, docs: DataFrame, width: int = 100) -> DataFrame:
    """Diagnostics with their source line, cut at ``width``, and a caret below the place."""
    line = F.element_at(F.split("text", "\n"), F.col("line"))
    cut = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("…"))).otherwise(line)
    return found.join(docs.select("doc_id", "text"), "doc_id").withColumns({"snippet": cut, "caret": F.concat(F.repeat(F.lit(" "), F.col("col") - 1), F.lit("^"))}).drop("text")


def _joined(found: DataFrame, line: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, line.alias("out"))))
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    return found.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "\n").alias("body"), F.count("*").alias("n"), *counts)


def _footer() -> Column:
    plural = lambda c, w: F.concat(F.col(c).cast("string"), F.lit(f" {w}"), F.when(F.col(c) == 1, "").otherwise("s"))
    return F.concat(plural("n", "diagnostic"), F.lit(" ("), F.concat_ws(", ", plural("errors", "error"), plural("warnings", "warning"), F.concat(F.col("infos").cast("string"), F.lit(" info"))), F.lit(")"))


def text_report(docs: DataFrame, found: DataFrame, *, source: str = "input", mode: str = "auto") -> DataFrame:
    """``doc_id, report``: a line for each diagnostic, help below it, and a count."""
    head = F.format_string("%s:%d:%d: %s [%s] %s", F.lit(source), F.coalesce("line", F.lit(1)), F.coalesce("col", F.lit(1)), "severity", "rule", "message")
    line = F.concat(head, F.coalesce(F.concat(F.lit("\n  help: "), "help"), F.lit("")))
    made = _joined(with_help(found, mode), line)
    return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce(F.concat("body", F.lit("\n"), _footer()), F.lit("0 diagnostics")).alias("report"))


def pretty_report(docs: DataFrame, found: DataFrame, *, source: str = "input") -> DataFrame:
    """The same with the source line, a caret, and each rule's category at its first diagnostic."""
    rows = with_snippet(with_help(found), docs).withColumn("about", F.when(first_of(found, "rule"), F.concat(F.lit("\n   = "), "category", F.lit(": "), "name")))
    line = F.concat(F.format_string("%s [%s] %s\n --> %s:%d:%d\n  | ", "severity", "rule", "message", F.lit(source), "line", "col"), "snippet", F.lit("\n  | "), "caret", F.coalesce(F.concat(F.lit("\n   = help: "), "help"), F.lit("")), F.coalesce("about", F.lit("")))
    made = _joined(rows, line)
    return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce(F.concat("body", F.lit("\n"), _footer()), F.lit("0 diagnostics")).alias("report"))


def _span() -> Column:
    return F.when(F.col("line").isNotNull(), F.struct(F.struct("line", F.col("col").alias("column")).alias("start")))


def json_report(docs: DataFrame, found: DataFrame, *, source: str = "input") -> DataFrame:
    """``doc_id, report`` in JSON; a diagnostic without a place has an explicit null span."""
    item = F.struct(*ORDER, F.struct("rule", "name", "category", "severity", "message", "suggestion", "source_dialect", "target_dialect", _span().alias("span")).alias("d"))
    ordered = F.array_sort(F.collect_list(item))
    made = found.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["d"]).alias("diagnostics"), F.struct(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES)).alias("summary"))
    empty = F.struct(*(F.lit(0).cast("long").alias(f"{s}s") for s in SEVERITIES))
    out = docs.select("doc_id").join(made, "doc_id", "left")
    diagnostics = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("diagnostics", F.array()), lambda d: F.concat(F.substring(F.to_json(d.dropFields("span")), F.lit(1), F.length(F.to_json(d.dropFields("span"))) - 1), F.lit(',"span":'), F.coalesce(F.to_json(d["span"]), F.lit("null")), F.lit("}"))), ","), F.lit("]"))
    return out.select("doc_id", F.concat(F.lit('{"source":' + json.dumps(source) + ',"diagnostics":'), diagnostics, F.lit(',"summary":'), F.to_json(F.coalesce("summary", empty)), F.lit("}")).alias("report"))


def sarif_report(docs: DataFrame, found: DataFrame, *, source: str = "input") -> DataFrame:
    """``doc_id, report`` as SARIF 2.1.0, with all rules described."""
    rules = [{"id": r.rule, "name": r.name, "shortDescription": {"text": r.message}, "defaultConfiguration": {"level": LEVELS[r.severity]}} for r in RULES]
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": "querylens", "rules": rules}) + '}, "results": '
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")))
    place = F.array(F.struct(F.struct(F.struct(F.lit(source).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    item = F.struct(*ORDER, F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")).alias("d"))
    made = found.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"])).alias("results"))
    return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.concat(F.lit(head), F.coalesce("results", F.lit("[]")), F.lit("}]}")).alias("report"))


FORMATS = {"text": text_report, "pretty": pretty_report, "json": json_report, "sarif": sarif_report}


def report(docs: DataFrame, found: DataFrame, form: str = "text", **options) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    return FORMATS[form](docs, found, **options)


def list_rules(spark) -> DataFrame:
    return rules_table(spark).select("rule", "name", "category", "severity", "enabled", "message").orderBy("rule")


def rule_totals(spark) -> DataFrame:
    """``category, n, n_enabled``, and the totals with a null category: what a list of rules ends with."""
    return rules_table(spark).rollup("category").agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"))


def explain(name: str) -> str:
    """What a rule, by its identifier, number or name, looks for, in a few lines; ValueError if none."""
    found = next(r for r in RULES if r.rule == resolve(name))
    state = "on" if found.enabled else "off"
    return f"{found.rule} {found.name}\ncategory: {found.category}\nseverity: {found.severity}\ndefault: {state}\n\n{found.message}.\n{found.suggestion}."
