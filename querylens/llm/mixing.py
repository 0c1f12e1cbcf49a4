"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1,
repeating, and share ``share`` of all sizes by weight; no target exceeds ``most`` times its source's
size, and what is cut off is shared again by weight. A source with target/size = r takes floor(r)
certain whole copies of each document; the words still due are sampled with unequal probabilities:
document i is included with probability min(1, c * importance_i), where c makes the expected words
what is due. Importance is the size by default, so that long documents are likelier than short ones;
those whose probability reaches 1 are certain once more, and only the others are drawn. They rank by
the odds u / (1 - u) of a uniform from the document's hash, divided by p / (1 - p), and the lowest are
taken until their words come nearest to what is due.

The uniform depends on the seed and the document's id, so reruns agree. Documents without an id are
named by their text's hash and, where they are read from files, their place in them. Null and empty
texts have size 0 and take nothing; very long ones are rows as others. Repeated rows are rows of their
own and rank by the text's hash; empty tables give empty results; other columns, whatever their
names, are kept by :func:`mix`.

Ranks are never sorted within a whole source: sizes are summed by 1,024 rank bins, the bin in which
a source's due amount falls is split into 1,024 again, and only rows of that last bin are ordered.
What comes out is one row for each source; whether a document is taken then follows from its own row.
Sources are as many rows as names: the shares are found by sums over their caps, in a table of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored, text_or_empty
from .exact_dedup import from_files

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
BINS = 1024


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Targets are min(most * size, level * weight) with the one level at which they add up; sources in
    order of most * size / weight are capped until the level of the others stays below their cap.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    due = F.sum("source_size").over(everything) if share == 1 else F.sum("source_size").over(everything) * share
    t = t.withColumn("left_over", due - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(after))
    fits = F.col("left_over") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    t = t.withColumn("nth", F.row_number().over(order))
    t = t.withColumn("level", F.min_by(F.struct("left_over", "weight_left"), F.when(fits, F.col("nth"))).over(everything))
    shared = (F.col("weight") * F.col("level.left_over")).cast("double") / F.col("level.weight_left")
    target = F.when(fits, shared).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, importance: str | None) -> DataFrame:
    """``row`` (all columns of ``docs``), ``source, name, id, hash, size, worth`` of each row."""
    text = text_or_empty()
    size = F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")
    worth = F.lit(None).cast("double") if importance is None else F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(1e-6))
    place = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")) if from_files(docs) else F.lit("")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.xxhash64(text).cast("string"), place))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", name.alias("name"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("hash"), size.alias("size"), worth.alias("worth"))
    return rows.withColumn("worth", F.coalesce("worth", F.col("size").cast("double")))


def _level(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, c, sure`` of each source with words due: the factor of importance, and the words of documents whose probability is 1.

    Documents are summed by importance first, of which there are as many as sizes; down the importances,
    all above one that the factor of the rest leaves below 1 are certain.
    """
    by = rows.where("size > 0").groupBy("source", "worth").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("worth")).alias("weighted"))
    due = plan.where("due > 0").select(F.col("source").alias("d_source"), "due")
    by = by.join(due, by["source"].eqNullSafe(F.col("d_source"))).drop("d_source")
    down = Window.partitionBy("source").orderBy(F.desc("worth"))
    by = by.withColumns({"above": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weighted").over(Window.partitionBy("source").orderBy("worth"))})
    by = by.withColumn("c", (F.col("due") - F.col("above")) / F.col("rest"))
    # The first importance that is not certain; from there on none is.
    open_ = by.where("c * worth < 1").groupBy("source").agg(F.max_by(F.struct("c", F.col("above").alias("sure")), "worth").alias("found"))
    return open_.select("source", "found.c", "found.sure")


def _ranked(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Each row with its source's plan as ``p``: its rank in (0, 1) by Pareto's odds, its coarse and fine bin; those of probability 1 have no rank."""
    plan = plan.select(F.struct(*plan.columns).alias("p"))
    rows = sized.join(plan, sized["source"].eqNullSafe(F.col("p.source")))
    rows = rows.withColumn("chance", F.least(F.coalesce(F.col("p.c"), F.lit(1.0)) * F.col("worth"), F.lit(1.0)))
    p = F.greatest(F.col("chance"), F.lit(1e-12))
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256), 1, 13), 16, 10).cast("long")  # 52 bits
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u * (1 - p)) / ((1 - u) * p)
    rows = rows.withColumn("rank", F.when((F.col("chance") < 1) & (F.col("size") > 0), odds / (1 + odds)))
    rows = rows.withColumns({"coarse": F.floor(F.col("rank") * BINS), "fine": F.floor(F.col("rank") * BINS * BINS)})
    return rows.withColumn("key", F.struct("rank", "id", "hash"))


def _with(plan: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("source", "f_source")
    return plan.join(found, plan["source"].eqNullSafe(F.col("f_source")), "left").drop("f_source")


def _crossing(binned: DataFrame, by: str, start) -> DataFrame:
    """For each source the first bin that its due amount doesn't cover, and the words before it."""
    binned = binned.where(F.col(by).isNotNull()).groupBy("source", by).agg(F.sum("size").alias("words"), F.first("p.due").alias("due"), F.first(start).alias("start"))
    binned = binned.withColumn("up_to", F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy(by)))
    return binned.where("up_to > due").groupBy("source").agg(F.min(by).alias("at"), F.min_by(F.col("up_to") - F.col("words"), by).alias("words"))


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 8, importance: str | None = None) -> DataFrame:
    """A row for each source: ``source, source_size, target``, its certain copies, and where its sample ends.

    importance: a column of positive numbers that inclusion probabilities are proportional to; sizes if None.
    """
    rows = stored(_sized(docs, importance).drop("row"), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("certain", F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("long"))
    plan = stored(plan.withColumn("due", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))), "mix-due")
    plan = stored(_with(plan, _level(rows, plan)).withColumn("sure", F.coalesce("sure", F.lit(0))), "mix-level")
    # Tables of one row for each source: Spark joins them by their size, broadcast while they are small.
    coarse = _crossing(_ranked(rows, plan, seed), "coarse", F.col("p.sure").cast("double"))
    plan = stored(_with(plan, coarse.withColumnsRenamed({"at": "cut", "words": "cut_words"})), "mix-cut")
    fine = _crossing(_ranked(rows, plan, seed).where("coarse = p.cut"), "fine", F.col("p.cut_words"))
    plan = stored(_with(plan, fine.withColumnsRenamed({"at": "edge", "words": "edge_words"})), "mix-edge")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = _ranked(rows, plan, seed).where("fine = p.edge").withColumn("so_far", F.col("p.edge_words") + running - F.col("size") / 2)
    last = edge.where("so_far <= p.due").groupBy("source").agg(F.max("key").alias("last"))
    return stored(_with(plan, last), "mix-plan")


def with_copies(docs: DataFrame, plan: DataFrame, *, most: int = 3, seed: int = 8, importance: str | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, the plan of its source as ``p``, ``chance``, and ``copies``: how often the mix takes the row."""
    rows = _ranked(_sized(docs, importance), plan, seed)
    at = F.col("p.cut").isNull() | (F.col("coarse") < F.col("p.cut")) | ((F.col("coarse") == F.col("p.cut")) & (F.col("fine") < F.coalesce("p.edge", F.lit(BINS * BINS))))
    drawn = at | ((F.col("fine") == F.col("p.edge")) & F.coalesce(F.col("key") <= F.col("p.last"), F.lit(False)))
    sampled = (F.col("p.due") > 0) & ((F.col("chance") >= 1) | drawn)
    copies = F.least(F.col("p.certain") + F.coalesce(sampled, F.lit(False)).cast("long"), F.lit(most))
    return rows.select("row", "size", "p", "chance", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it, with the same columns."""
    plan = mix_plan(docs, **options)
    kept = {k: v for k, v in options.items() if k in ("most", "seed", "importance")}
    rows = with_copies(docs, plan, **kept).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
