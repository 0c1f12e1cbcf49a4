"""The rules' dimension: identifier, slug, category, severity, whether on by default, and what is found."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("error", "warning", "info")


class Rule(NamedTuple):
    rule: str
    name: str
    category: str
    severity: str
    enabled: bool
    message: str
    suggestion: str


def _rules() -> list[Rule]:
    table = """
QL0001 raw-statement              raw         warning off | Statement is kept as raw text | Check it by hand
QL0100 backtick-ident             dialect-xc  warning on  | Backtick quotes outside MySQL and MariaDB | Use double quotes
QL0101 bracket-ident              dialect-xc  warning on  | Bracket quotes outside SQL Server | Use double quotes
QL0102 double-colon-cast          dialect-xc  info    on  | Cast written with :: | Use CAST(x AS type)
QL0103 on-duplicate-key           dialect-xc  error   on  | ON DUPLICATE KEY UPDATE outside MySQL and MariaDB | Use ON CONFLICT or MERGE
QL0104 returning-in-mysql         dialect-xc  warning on  | RETURNING in MySQL | Query the rows separately
QL0200 target-lacks-returning     pre-flight  warning on  | The target has no RETURNING for this statement | It is dropped in translation
QL0201 target-lacks-duplicate-key pre-flight  error   on  | The target has no ON DUPLICATE KEY UPDATE | Write the upsert the target's way
QL0202 target-lacks-on-conflict   pre-flight  error   on  | The target has no ON CONFLICT | Write the upsert the target's way
QL0203 target-lacks-sequence      pre-flight  warning on  | The target has no CREATE SEQUENCE | Use an identity column
QL0204 target-lacks-raw           pre-flight  error   on  | Raw text is passed to a target that can't run it | Rewrite it by hand
QL0205 target-quote-style         pre-flight  info    off | Quote style differs in the target | Nothing is reported yet
QL0300 comma-join                 joins       warning on  | FROM lists several relations | Use explicit joins
QL0301 cross-join-no-where        joins       warning on  | CROSS JOIN without WHERE | Add a condition
QL0302 natural-join               joins       warning on  | NATURAL JOIN depends on column names | Name the columns
QL0303 join-without-condition     joins       error   on  | Join without ON or USING | Add a condition
QL0304 join-tautology             joins       error   on  | Join condition is always true | Compare columns
QL0305 using-quoted               joins       info    on  | Quoted name in USING | Quoting makes it case-sensitive
QL0306 full-outer-in-mysql        joins       error   on  | FULL OUTER JOIN in MySQL or MariaDB | Use a union of outer joins
QL0307 comma-and-join             joins       warning on  | FROM mixes commas and joins | Use explicit joins
QL0400 not-in-subquery            subquery    warning on  | NOT IN over a subquery that may hold nulls | Use NOT EXISTS
QL0401 in-subquery                subquery    info    on  | IN over a subquery | EXISTS may be clearer
QL0402 scalar-subquery            subquery    info    on  | Scalar subquery in the select list | Join instead
QL0403 order-in-subquery          subquery    warning on  | ORDER BY in a subquery without LIMIT | Drop it
QL0404 correlated-subquery        subquery    info    on  | Subquery in WHERE refers to qualified columns | Join instead
QL0500 select-star                perf        info    on  | SELECT * | Name the columns
QL0501 select-star-of             perf        info    off | SELECT t.* | Name the columns
QL0502 leading-wildcard           perf        warning on  | Pattern begins with % | No index serves it
QL0503 function-on-column         perf        warning on  | Function of a column in a comparison | Compare the bare column
QL0504 distinct-over-join         perf        info    on  | DISTINCT over a join | Check the join's keys
QL0505 count-nullable             perf        info    on  | COUNT of a column leaves nulls out | COUNT(*) counts rows
QL0506 string-compare             perf        info    off | Column compared with a string | Mind implicit conversion
QL0507 or-across-columns          perf        info    on  | OR over different columns | UNION may use both indexes
QL0600 equals-null                correctness error   on  | Comparison with NULL | Use IS NULL
QL0601 update-all                 correctness error   on  | UPDATE without WHERE | Add a condition
QL0602 delete-all                 correctness error   on  | DELETE without WHERE | Add a condition
QL0603 and-or-mixed               correctness warning on  | AND and OR without parentheses | Add parentheses
QL0604 order-by-position          correctness info    on  | ORDER BY position | Name the column
QL0605 having-without-group       correctness warning on  | HAVING without GROUP BY | Use WHERE
QL0606 group-by-position          correctness info    on  | GROUP BY position | Name the column
QL0701 derived-without-alias      style       warning on  | Derived table without alias | Name it
QL0704 limit-without-order        style       info    on  | LIMIT without ORDER BY | Order the rows
QL0801 float-for-money            ddl         warning on  | Floating point for an amount | Use DECIMAL
QL0802 varchar-without-length     ddl         warning on  | VARCHAR without length | State the length
QL0900 unknown-column             schema      error   on  | The table has no such column | Check the name
"""
    out = []
    for line in table.strip().splitlines():
        head, message, suggestion = (x.strip() for x in line.split("|"))
        rule, name, category, severity, enabled = head.split()
        out.append(Rule(rule, name, category, severity, enabled == "on", message, suggestion))
    return out


RULES = _rules()


def rules_table(spark: SparkSession) -> DataFrame:
    """45 rows, whatever the corpus."""
    return spark.createDataFrame([(*r, SEVERITIES.index(r.severity)) for r in RULES], "rule string, name string, category string, severity string, enabled boolean, message string, suggestion string, severity_rank int")


def resolve(name: str) -> str:
    """A rule by its identifier, its number with or without leading zeros, or its name; ValueError if none."""
    for r in RULES:
        number = r.rule[2:]
        if name in (r.rule, r.name, number, number.lstrip("0")):
            return r.rule
    raise ValueError(f"unknown rule: {name}")


def selected(enable: list[str] = (), disable: list[str] = (), *, verbose: bool = False) -> set[str]:
    """The rules to run: the defaults without ``disable``, then with ``enable``, which wins."""
    rules = {r.rule for r in RULES if r.enabled} - {resolve(x) for x in disable}
    return rules | {resolve(x) for x in enable} | ({"QL0001"} if verbose else set())
