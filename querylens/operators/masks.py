"""Texts up to their numbers: what is found in a text once holds for all that differ from it in digits alone.

A text's *mask* has its distinct runs of digits numbered in the order of their first use, so equal runs stay
equal and different ones different, within numbers, names and literals alike. Where pieces, statements and
words end, what they are, which names are equal and which rules they break don't depend on what a run is; names
and places do, and get their own runs back by :func:`unmasked`. Logs and generated statements have few masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.sources.work import stored

from .tokens import MARK, let, statements

#: The number of the first run; no keyword or type holds such a number.
FIRST = 1001
#: Longer texts, those of more distinct runs and those that name types by their digits are their own masks.
LONGEST, RUNS = 4_000, 64
BY_DIGITS = r"(?i)FLOAT[0-9]"
CUT = r"[0-9]++|[^0-9]++"


def mask_of(text: Column) -> Column:
    """``mask, runs`` of a text; a text that is its own mask has no runs."""
    is_run = lambda x: F.substring(x, 1, 1).between("0", "9")
    own = F.struct(text.alias("mask"), F.array().cast("array<string>").alias("runs"))

    def numbered(cut: Column) -> Column:
        def of(runs: Column) -> Column:
            mask = F.array_join(F.transform(cut, lambda x: F.when(is_run(x), (F.array_position(runs, x) + (FIRST - 1)).cast("string")).otherwise(x)), "")
            return F.when(F.size(runs) > RUNS, own).otherwise(F.struct(mask.alias("mask"), runs.alias("runs")))

        return let(F.array_distinct(F.filter(cut, is_run)), of)

    return F.when((F.length(text) > LONGEST) | F.regexp_like(text, F.lit(BY_DIGITS)), own).otherwise(let(F.regexp_extract_all(text, F.lit(CUT), F.lit(0)), numbered))


def unmasked(part: Column, runs: Column) -> Column:
    """A part of a mask with the text's own runs."""
    back = F.transform(F.regexp_extract_all(part, F.lit(CUT), F.lit(0)), lambda x: F.coalesce(F.get(runs, x.try_cast("int") - FIRST), x))
    return F.when(F.size(runs) == 0, part).otherwise(F.array_join(back, ""))


def masked(docs: DataFrame, *, numbers: bool = True) -> DataFrame:
    """``doc_id, dialect, target, mid, mask, runs`` of frames of SQL text; without ``numbers`` each text is its own mask."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, " ")
    m = mask_of(text) if numbers else F.struct(text.alias("mask"), F.array().cast("array<string>").alias("runs"))
    t = docs.select("doc_id", "dialect", "target", F.explode(F.array(m)).alias("m")).select("doc_id", "dialect", "target", "m.*")
    none = F.lit(MARK)
    return t.withColumn("mid", F.sha2(F.concat_ws(MARK, F.coalesce("dialect", none), F.coalesce("target", none), "mask"), 256))


def distinct_masks(texts: DataFrame) -> DataFrame:
    """Frames of SQL text: each mask of :func:`masked` once, with its ``mid`` as doc_id."""
    return texts.select(F.col("mid").alias("doc_id"), "dialect", "target", F.col("mask").alias("text")).distinct()


def statement_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, dialect, target, stmt, kind, is_raw, raw_reason, status``: of :func:`statements` what doesn't depend on numbers."""
    texts = masked(docs)
    facts = stored(statements(distinct_masks(texts)).select(F.col("doc_id").alias("mid"), "stmt", "kind", "is_raw", "raw_reason", "status"), "facts")
    return texts.join(facts, "mid").select("doc_id", "dialect", "target", "stmt", "kind", "is_raw", "raw_reason", "status")
