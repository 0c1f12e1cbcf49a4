"""The dialects, their names and what they support: six rows, whatever the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Dialects and their other names.
DIALECTS = {"mysql": (), "mariadb": ("maria",), "postgres": ("postgresql", "pg"), "mssql": ("tsql", "sqlserver"), "sqlite": (), "generic": ()}

CAPABILITIES = ("returning_insert", "returning_update", "returning_delete", "create_sequence", "on_duplicate_key", "on_conflict", "raw_native")

#: What each dialect supports.
SUPPORTED = {
    "mysql": {"on_duplicate_key"},
    "mariadb": {"returning_insert", "returning_update", "returning_delete", "create_sequence", "on_duplicate_key", "raw_native"},
    "postgres": {"returning_insert", "returning_update", "returning_delete", "create_sequence", "on_conflict"},
    "mssql": {"create_sequence"},
    "sqlite": {"returning_insert", "returning_update", "returning_delete", "on_conflict"},
    "generic": {"returning_insert", "returning_update", "returning_delete", "create_sequence", "on_duplicate_key", "on_conflict"},
}


def dialect_name(name: str) -> str:
    """The dialect that a name or alias stands for, in any case; ValueError if none."""
    for known, aliases in DIALECTS.items():
        if name.lower() in (known, *aliases):
            return known
    raise ValueError(f"unknown dialect: {name}")


def dialect_caps(spark: SparkSession) -> DataFrame:
    rows = [(d, *(c in SUPPORTED[d] for c in CAPABILITIES)) for d in DIALECTS]
    return spark.createDataFrame(rows, "dialect string, " + ", ".join(f"{c} boolean" for c in CAPABILITIES))
