"""Translation between dialects: statements printed again, with a warning for whatever is lost.

Only what a target can't run is changed: a RETURNING clause that it lacks is dropped. Sequences it
lacks and raw statements for any target but MariaDB are kept as they are, with a warning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.plans.dialects import dialect_caps
from querylens.sources.work import stored

from .tokens import MARK, running, statements

#: The warnings' codes; the third is reserved and never given.
CODES = ("RETURNING_DROPPED", "SEQUENCE_DROPPED", "ON_DUPLICATE_KEY_UNSUPPORTED", "RAW_PASSTHROUGH")


def rewritten(docs: DataFrame) -> DataFrame:
    """Statements with ``sql`` as the target runs it, ``code`` of the warning if any, and what was dropped."""
    s = statements(docs).where("status = 'ok'")
    goal = dialect_caps(docs.sparkSession)  # six rows
    goal = goal.withColumnsRenamed({c: f"to_{c}" for c in goal.columns})
    s = s.join(F.broadcast(goal), F.col("target") == F.col("to_dialect"), "left")
    lacks = F.coalesce(F.when(F.col("kind") == "INSERT", ~F.col("to_returning_insert")).when(F.col("kind") == "UPDATE", ~F.col("to_returning_update")).when(F.col("kind") == "DELETE", ~F.col("to_returning_delete")), F.lit(False))
    # RETURNING outside all parentheses, the statement's last clause: what stands before it stays.
    words = F.split("shape", MARK)
    depth = running(F.transform(words, lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0)))
    places = F.filter(F.transform(F.arrays_zip(words.alias("w"), depth.alias("d")), lambda x, i: F.when((F.upper(x["w"]) == "RETURNING") & (x["d"] == 0), i)), lambda i: i.isNotNull())
    s = s.withColumn("at", F.when(~F.col("is_raw") & lacks & F.contains(F.upper("shape"), F.lit("RETURNING")), F.get(places, F.lit(0))))
    drop = F.col("at").isNotNull()
    kept = F.regexp_replace(F.array_join(F.slice("toks", 1, F.get("starts", F.col("at")) - 1), ""), r"\A\s+|\s+\z", "")
    sequence = ~F.col("is_raw") & (F.col("kind") == "CREATE") & F.regexp_like(F.upper("sql"), F.lit(r"\ACREATE\s+SEQUENCE\b")) & ~F.coalesce("to_create_sequence", F.lit(True))
    raw = F.col("is_raw") & (F.col("target") != "mariadb")
    code = F.when(raw, "RAW_PASSTHROUGH").when(drop, "RETURNING_DROPPED").when(sequence, "SEQUENCE_DROPPED")
    return s.select("doc_id", "target", "stmt", F.when(drop, kept).otherwise(F.col("sql")).alias("sql"), code.alias("code"), "is_raw", "raw_reason")


def emit(parts: DataFrame) -> DataFrame:
    """``doc_id, sql``: each document's statements in order, with ``;`` and a new line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("stmt", "sql")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["sql"]), ";\n").alias("sql"))


def translate(docs: DataFrame, target: str | None = None, *, strict: bool = False) -> DataFrame:
    """``doc_id, sql, codes, exit_code`` of each document; in strict mode a warning leaves no text and exit code 3."""
    docs = docs if target is None else docs.withColumn("target", F.lit(target))
    parts = stored(rewritten(docs), "rewritten")
    codes = parts.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = docs.select("doc_id").join(emit(parts), "doc_id", "left").join(codes, "doc_id", "left")
    failed = F.col("sql").isNull()
    warned = F.size(F.coalesce("codes", F.array())) > 0
    code = F.when(failed, 1).when(warned, 3 if strict else 0).otherwise(0)
    return out.select("doc_id", (F.when(~warned, F.col("sql")) if strict else F.col("sql")).alias("sql"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), code.alias("exit_code"))


def warnings(docs: DataFrame) -> DataFrame:
    """``doc_id, stmt, code, message`` of what translation loses."""
    message = F.when(F.col("code") == "RETURNING_DROPPED", "RETURNING was dropped").when(F.col("code") == "SEQUENCE_DROPPED", "CREATE SEQUENCE is kept as it is").otherwise(F.concat(F.lit("raw text is kept as it is: "), "raw_reason"))
    return rewritten(docs).where("code is not null").select("doc_id", "stmt", "code", message.alias("message"))
