"""Mixing sources to target weights by entropy balancing.

The document rates that stay closest to 1 in relative entropy, while each source's words come to its target and no rate
passes a ceiling, are r = min(CEILING, exp(lambda_s * x)) with x the document's size over its source's mean. The
multipliers solve a convex dual by Newton steps, kept inside a bracket; each step is one aggregation over the counts of
documents of one source and size. Rates are then rounded into copies: whole parts for sure, and one more where the
fraction beats a hash of the document by the margin at which the source meets its target. That margin is found by two
passes of histograms, so that no source, however hot, is sorted or held in one place. What a source then still lacks,
less than a document, is filled with the largest documents that fit.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
nothing; repeated rows with one id are rounded alike up to the last filling, rows without an id each by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm._base import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
STEPS = 40
#: Share of a target by which the rates may miss it; rounding meets it better anyway.
TOLERANCE = 1e-4
BINS = 1024
REPAIRS = 3
#: Sources of which what is known is small enough to be sent to every executor; more are joined by source.
FEW_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target: share of all words by weight, what passes the ceiling shared anew by weight.

    One row a source. The level at which the rest is shared is found over the sources in order of ceiling per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * ceiling)
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level rises from source to source as long as they reach their ceilings and falls after: the highest holds.
    per = per.withColumn("shared", F.max("level").over(every))
    return per.select("source", "source_size", F.least("most", F.col("shared") * F.col("weight")).alias("target"))


def _same(a: DataFrame, b: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join on the source, null included; b has a row a source and is sent to every executor if they are few."""
    other = b.withColumnRenamed("source", "_source")
    return a.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def rate(ceiling: float) -> Column:
    """The rate of a document, from the columns size, mean, lam, full."""
    return F.when(F.col("full"), F.lit(ceiling)).otherwise(F.least(F.lit(ceiling), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean")))))


def multipliers(sizes: DataFrame, goals: DataFrame, few: bool, ceiling: float = CEILING, steps: int = STEPS) -> DataFrame:
    """source, lam, mean, full (a source that reaches its ceiling): the solution of the dual, a row a source."""
    counts = cut(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    words, squares = F.sum(F.col("n") * F.col("size")), F.sum(F.col("n") * F.col("size") * F.col("size").cast("double"))
    # tilt: the mean of x by words, for a first guess of lambda.
    means = counts.groupBy("source").agg((words / F.sum("n")).alias("mean"), (squares * F.sum("n") / (words * words.cast("double"))).alias("tilt"))
    lam = _same(goals, means, few).select("source", "target", "mean", (F.col("target") >= F.col("source_size") * ceiling).alias("full"), (F.log(F.col("target") / F.col("source_size")) / F.col("tilt")).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("off"))
    lam = cut(lam)
    for _ in range(steps):
        here = _same(counts, lam, few)
        r, words = rate(ceiling), F.col("n") * F.col("size")
        sums = here.groupBy("source").agg(
            F.sum(words * r).alias("got"),
            F.sum(F.when(r < ceiling, words * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        lam = _same(lam, sums, few)
        over = F.col("got") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.when(F.col("slope") > 0, over / F.col("slope"))
        lam = cut(lam.select("source", "target", "mean", "full", F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.when(F.col("full"), 0.0).otherwise(F.abs(over) / F.greatest("target", F.lit(1.0))).alias("off")))
        if (lam.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return lam.select("source", "lam", "mean", "full")


def _margin(rows: DataFrame, low: Column, width: Column, need: str) -> tuple[DataFrame, Column]:
    """Of each source, the bin in which the words of documents in ascending place pass `need`: bin and words before it."""
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("place") - low) / width * BINS))).cast("int")
    bins = rows.groupBy("source", place.alias("bin")).agg(F.sum("size").alias("held"), F.first(need).alias("need"))
    up = F.sum("held").over(W.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("up", up).where(F.col("up") >= F.col("need"))
    return bins.groupBy("source").agg(F.min("bin").alias("bin"), F.min_by(F.col("up") - F.col("held"), "bin").alias("before"), F.min_by("held", "bin").alias("held")), place


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate: one row for each row of docs; with row, a column that no two
    rows share, that too."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    passed = [F.col(f"`{row}`").alias("row")] if row else [F.monotonically_increasing_id().alias("row")]
    sizes = cut(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), *passed))
    goals = cut(targets(sizes, weights, share, ceiling))
    few = goals.count() <= FEW_SOURCES
    solved = _same(goals, multipliers(sizes, goals, few, ceiling), few, "left")
    rows = _same(sizes, solved, few)
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate(ceiling)))
    whole = F.least(F.floor("rate"), F.lit(int(ceiling)))
    # Place 0 to 1: documents of which the fraction most beats the hash come first.
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit("round"))).otherwise(F.xxhash64("doc_id", F.lit("round")))
    chance = F.call_function("shiftrightunsigned", draw, F.lit(11)) / float(1 << 53)
    rows = rows.withColumns({"whole": whole.cast("long"), "place": (F.lit(1.0) - (F.col("rate") - whole) + chance) / 2})
    rows = cut(rows.select("row", "doc_id", "source", "size", "source_size", "target", "rate", "whole", "place"))
    can = (F.col("whole") < int(ceiling)) & (F.col("size") > 0)
    short = cut(rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")))
    open_ = _same(rows.where(can).select("source", "size", "place"), short, few)
    first, bin1 = _margin(open_, F.lit(0.0), F.lit(1.0), "need")
    first = cut(first)
    inner = _same(open_, first.select("source", F.col("bin").alias("b1"), "before"), few).where(bin1 == F.col("b1")).withColumn("left", F.col("need") - F.col("before"))
    second, bin2 = _margin(inner, F.col("b1") / BINS, F.lit(1.0 / BINS), "left")
    near = second.select("source", F.col("bin").alias("cut2"))
    margins = first.select("source", F.col("bin").alias("b1"))
    margins = _same(margins, near, few, "left")
    named = _same(_same(rows, margins, few, "left"), short, few, "left")
    inside = (bin1 < F.col("b1")) | ((bin1 == F.col("b1")) & ((bin2 < F.col("cut2"))))
    # Without a margin the documents that can be taken once more don't suffice: all are, if anything is short.
    more = can & F.coalesce(inside, F.col("need") > 0)
    copies = F.col("whole") + more.cast("long")
    out = cut(named.select("row", "doc_id", "source", "size", "source_size", "target", "rate", "place", copies.alias("copies")))
    for _ in range(REPAIRS):
        # The bin of the margin was left out, so a source may be short by up to a document: the largest that fits is added.
        short = out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("left")) & (F.col("copies") < int(ceiling))
        pick = _same(out, short, few).where(fits).groupBy("source").agg(F.max(F.struct("size", F.xxhash64("doc_id").alias("h"), "row")).alias("p"))
        pick = pick.select(F.col("p.row").alias("row"), F.lit(1).cast("long").alias("_more"))
        out = cut(out.join(F.broadcast(pick) if few else pick, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0))).drop("_more"))
    return out.select(*([F.col("row").alias(row)] if row else []), "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
