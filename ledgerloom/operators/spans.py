"""Ownership of token intervals: overlaps, islands, coverage, references and nesting.

A span is (doc_id, page, row, word_start, word_end), half open; keys = its first three columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("doc_id", "page", "row")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def overlapping(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds clash: whether a span shares a word with another of its row. By the furthest end before and the nearest begin
    after it, not by a self join, so a crowded row costs a sort."""
    order = W.partitionBy(*keys).orderBy("word_start", "word_end")
    before = F.max("word_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min("word_start").over(order.rowsBetween(1, W.unboundedFollowing))
    return spans.withColumn("clash", F.coalesce(before > F.col("word_start"), F.lit(False)) | F.coalesce(after < F.col("word_end"), F.lit(False)))


def islands(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Overlapping or touching spans of a row as one: (keys, word_start, word_end, spans)."""
    order = W.partitionBy(*keys).orderBy("word_start", "word_end")
    reach = F.max("word_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.coalesce((F.col("word_start") > reach), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return s.groupBy(*keys, "_island").agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"), F.count("*").alias("spans")).drop("_island")


def coverage(expected: DataFrame, claimed: DataFrame, on: list[str]) -> DataFrame:
    """(on, gap): expected without a claim is missing, a claim that nothing expects is foreign, one claimed twice repeated."""
    e = expected.select(*on).distinct().withColumn("_e", F.lit(1))
    c = claimed.groupBy(*on).agg(F.count("*").alias("_c"))
    both = e.join(c, on, "full")
    gap = F.when(F.col("_c").isNull(), "missing").when(F.col("_e").isNull(), "foreign").when(F.col("_c") > 1, "repeated")
    return both.withColumn("gap", gap).where("gap is not null").select(*on, "gap")


def contained(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds inside: whether an inner span lies within some outer span of its row. Of the outer spans that begin no later the
    one that reaches furthest tells, so both are read in one order and a crowded row costs a sort."""
    own = [c for c in inner.columns if c not in (*keys, "word_start", "word_end")]
    both = inner.withColumn("_outer", F.lit(0)).unionByName(outer.select(*keys, "word_start", "word_end", F.lit(1).alias("_outer")), allowMissingColumns=bool(own))
    order = W.partitionBy(*keys).orderBy("word_start", F.desc("_outer")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(F.col("_outer") == 1, F.col("word_end"))).over(order)
    return both.withColumn("inside", F.coalesce(reach >= F.col("word_end"), F.lit(False))).where("_outer = 0").drop("_outer")


def references(controls: DataFrame) -> DataFrame:
    """(doc_id, control, ref, problem) of controls (doc_id, control, begin, end, refs): a reference must exist and end where
    its control begins, which, as begin < end, leaves no cycle."""
    each = controls.select("doc_id", "control", "begin", F.explode("refs").alias("ref"))
    owners = controls.select("doc_id", F.col("control").alias("ref"), F.col("end").alias("_end"))
    problem = F.when(F.col("_end").isNull(), "control_reference_missing").when(F.col("_end") != F.col("begin"), "control_reference_order")
    return each.join(owners, ["doc_id", "ref"], "left").withColumn("problem", problem).where("problem is not null").select("doc_id", "control", "ref", "problem")


def crossing(intervals: DataFrame) -> DataFrame:
    """Adds crosses: begins inside another interval of its document and ends beyond it; nesting is allowed.

    intervals (doc_id, control, begin, end). A control has few intervals a document, so the self join stays small.
    """
    b = intervals.select("doc_id", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    hit = intervals.join(b, "doc_id").where("_b < begin and begin < _e and _e < end").select("doc_id", "control").distinct().withColumn("_x", F.lit(True))
    return intervals.join(hit, ["doc_id", "control"], "left").withColumn("crosses", F.coalesce("_x", F.lit(False))).drop("_x")


def independent_intervals(controls: DataFrame) -> DataFrame:
    """(doc_id, independent): distinct non-empty sets of members; repeats of one interval prove nothing more."""
    sets = controls.where(F.size("members") > 0).select("doc_id", F.array_sort(F.array_distinct("members")).alias("m"))
    return sets.groupBy("doc_id").agg(F.count_distinct("m").alias("independent"))
