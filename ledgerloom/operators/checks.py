"""Exact arithmetic over ledgers: chains, checkpoints, totals, order and evidence. Decimals only; overflow raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.lexical import CENTS, exact_cents


def _doc():
    return W.partitionBy("doc_id")


def exact_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(CENTS)


def economic_order(tx: DataFrame, descending: Column | bool = False) -> DataFrame:
    """Adds idx, from 0 in economic order."""
    up = F.row_number().over(_doc().orderBy("doc_order")) - 1
    down = F.count("*").over(_doc()) - 1 - up
    flag = F.lit(descending) if isinstance(descending, bool) else descending
    return tx.withColumn("idx", F.when(flag, down).otherwise(up).cast("int"))


def running_chain(tx: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, links, mismatches, closing_ok): each printed balance against the last printed one (or the opening) plus
    what moved since. tx has idx, amount, balance_after; bounds has opening and closing, either may be null."""
    t = tx.join(bounds.select("doc_id", "opening", "closing"), "doc_id", "left")
    order = _doc().orderBy("idx")
    t = t.withColumn("cum", F.sum("amount").over(order).cast(CENTS))
    earlier = F.last(F.when(F.col("balance_after").isNotNull(), F.struct(F.col("balance_after").alias("b"), F.col("cum").alias("c"))), True)
    t = t.withColumns({"_p": earlier.over(order.rowsBetween(W.unboundedPreceding, -1)), "_l": earlier.over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "_all": F.sum("amount").over(_doc()).cast(CENTS)})
    expected = F.when(F.col("_p").isNotNull(), F.col("_p.b") + F.col("cum") - F.col("_p.c")).otherwise(F.col("opening") + F.col("cum"))
    linked = F.col("balance_after").isNotNull() & expected.isNotNull()
    t = t.withColumns({"_linked": linked, "_bad": linked & (expected != F.col("balance_after")), "_first": linked & (F.col("idx") == 0) & F.col("opening").isNotNull()})
    closing = F.when(F.col("_l").isNotNull() & F.col("closing").isNotNull(), F.col("_l.b") + F.col("_all") - F.col("_l.c") == F.col("closing"))
    return t.groupBy("doc_id").agg(
        F.count_if("_linked").cast("int").alias("links"), F.count_if("_bad").cast("int").alias("mismatches"),
        F.bool_and(closing).alias("closing_ok"), F.bool_or("_first").alias("first_linked"),
    )


def checkpoint_links(tx: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, links, conflicts, mismatches): consecutive cuts reconcile with what moved between them.

    points has after (movements before the cut) and balance; several at one cut must agree.
    """
    cuts = points.groupBy("doc_id", "after").agg(F.min("balance").alias("low"), F.max("balance").alias("high"))
    cum = tx.select("doc_id", (F.col("idx") + 1).alias("after"), F.sum("amount").over(_doc().orderBy("idx")).cast(CENTS).alias("cum"))
    c = cuts.join(cum, ["doc_id", "after"], "left").withColumn("cum", F.coalesce("cum", F.lit(0).cast(CENTS)))
    order = _doc().orderBy("after")
    moved = F.col("cum") - F.lag("cum").over(order)
    c = c.withColumns({"_moved": moved, "_step": F.col("low") - F.lag("low").over(order), "_bad": F.col("low") != F.col("high")})
    return c.groupBy("doc_id").agg(
        F.count_if(F.col("_step").isNotNull() & (F.col("_moved") == F.col("_step"))).cast("int").alias("links"),
        F.count_if("_bad").cast("int").alias("conflicts"),
        F.count_if(F.col("_step").isNotNull() & (F.col("_moved") != F.col("_step"))).cast("int").alias("mismatches"),
    )


def boundary_points(tx: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, after, balance, kind): opening at 0, closing at n, each printed balance after its movement."""
    n = tx.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    opening = bounds.where("opening is not null").select("doc_id", F.lit(0).alias("after"), F.col("opening").alias("balance"), F.lit("opening_balance").alias("kind"))
    closing = bounds.where("closing is not null").join(n, "doc_id").select("doc_id", F.col("n").alias("after"), F.col("closing").alias("balance"), F.lit("closing_balance").alias("kind"))
    running = tx.where("balance_after is not null").select("doc_id", (F.col("idx") + 1).alias("after"), F.col("balance_after").alias("balance"), F.lit("running_balance").alias("kind"))
    return opening.unionByName(closing).unionByName(running)


def daily_points(tx: DataFrame, days: DataFrame) -> DataFrame:
    """(doc_id, day, after, balance, absent): a day's balance cuts after all movements up to it; a day without any is a
    violation. Counts per day and a running sum stand for the theta count."""
    per = tx.groupBy("doc_id", F.col("posting_date").alias("day")).agg(F.count("*").alias("n"))
    upto = per.withColumn("after", F.sum("n").over(_doc().orderBy("day")).cast("int")).select("doc_id", "day", "after")
    return days.join(upto, ["doc_id", "day"], "left").withColumn("absent", F.col("after").isNull())


def opening_closing(tx: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, total, reconciled): null unless both balances are known."""
    total = tx.groupBy("doc_id").agg(exact_sum(F.col("amount")).alias("total"))
    return bounds.join(total, "doc_id").select("doc_id", "total", (F.col("opening") + F.col("total") == F.col("closing")).alias("reconciled"))


def credit_debit(tx: DataFrame) -> DataFrame:
    """(doc_id, credits, debits): zero counts as a credit."""
    return tx.groupBy("doc_id").agg(exact_sum(F.when(F.col("amount") >= 0, F.col("amount"))).alias("credits"), exact_sum(F.when(F.col("amount") < 0, F.col("amount"))).alias("debits"))


def flow_subtotals(members: DataFrame, flows: DataFrame) -> DataFrame:
    """(doc_id, flow, printed, total, members, ok) of flows (doc_id, flow, printed) and members (doc_id, flow, amount)."""
    sums = members.groupBy("doc_id", "flow").agg(exact_sum(F.col("amount")).alias("total"), F.count("*").cast("int").alias("members"))
    joined = flows.join(sums, ["doc_id", "flow"], "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return joined.withColumn("ok", (F.col("members") > 0) & F.coalesce(F.col("total") == F.col("printed"), F.lit(False)))


def subtotal_bounds(members: DataFrame) -> DataFrame:
    """Adds within: after each member the running magnitude isn't above the printed subtotal and its sign agrees."""
    order = W.partitionBy("doc_id", "flow").orderBy("idx")
    run = F.sum("amount").over(order).cast(CENTS)
    return members.withColumn("run", run).withColumn("within", (F.abs("run") <= F.abs("printed")) & (F.signum(F.col("amount").cast("double")) * F.signum(F.col("printed").cast("double")) >= 0))


def chronology(tx: DataFrame) -> DataFrame:
    """(doc_id, ascending, descending, chronology): what the dates in document order allow; null if neither."""
    step = F.datediff("posting_date", F.lag("posting_date").over(_doc().orderBy("doc_order")))
    s = tx.withColumn("_s", step).groupBy("doc_id").agg(F.coalesce(F.bool_and(F.col("_s") >= 0), F.lit(True)).alias("ascending"), F.coalesce(F.bool_and(F.col("_s") <= 0), F.lit(True)).alias("descending"))
    return s.withColumn("chronology", F.when(F.col("ascending"), "ascending").when(F.col("descending"), "descending"))


def evidence(tx: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row a document: tri-state flags, link counts, support and the level of reconciliation."""
    chain, both = running_chain(tx, bounds), opening_closing(tx, bounds)
    e = chain.join(both, "doc_id", "full")
    state = lambda c: F.when(c, "verified").otherwise("not_available")
    e = e.select(
        "doc_id", F.coalesce("links", F.lit(0)).alias("running_links"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
        state(F.coalesce("links", F.lit(0)) > 0).alias("running_verified"), state(F.coalesce("first_linked", F.lit(False))).alias("first_movement"),
        state(F.coalesce("reconciled", F.lit(False))).alias("opening_closing"),
        F.coalesce(~F.col("reconciled"), F.lit(False)).alias("total_mismatch"), F.coalesce(~F.col("closing_ok"), F.lit(False)).alias("closing_mismatch"),
    )
    level = F.when(F.col("opening_closing") == "verified", "opening_closing").when(F.col("running_verified") == "verified", "partial_running_chain").otherwise("none")
    return e.withColumns({"reconciliation_level": level, "supported": level != "none"})


def violations(statements: DataFrame) -> DataFrame:
    """Adds violations: the names of all domain rules that a statement with nested transactions breaks.

    Its columns: period_begin, period_end, opening, closing, txs array(struct(posting_date, description, amount)).
    """
    any_ = lambda f: F.exists("txs", f)
    checks = {
        "period_reversed": F.col("period_begin") > F.col("period_end"),
        "no_transactions": F.coalesce(F.size("txs"), F.lit(0)) <= 0,
        "date_outside_period": any_(lambda t: (t["posting_date"] < F.col("period_begin")) | (t["posting_date"] > F.col("period_end"))),
        "blank_description": any_(lambda t: F.coalesce(F.trim(t["description"]) == "", F.lit(True))),
        "amount_not_cents": any_(lambda t: ~exact_cents(t["amount"])),
        "balance_not_cents": F.coalesce(~exact_cents(F.col("opening")), F.lit(False)) | F.coalesce(~exact_cents(F.col("closing")), F.lit(False)),
    }
    return statements.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))


DIAGNOSTICS = {"ambiguous": "insufficient_evidence", "unsupported": "unsupported_structure", "invalid": "contradiction"}


def verdict(e: DataFrame) -> DataFrame:
    """(doc_id, status): contradicted arithmetic is invalid, without an independent control it is ambiguous."""
    bad = (F.col("mismatches") > 0) | F.col("total_mismatch") | F.col("closing_mismatch")
    return e.withColumn("status", F.when(bad, "invalid").when(~F.col("supported"), "ambiguous").otherwise("success"))


def record_differences(a: DataFrame, b: DataFrame, on: str = "doc_id") -> DataFrame:
    """(on, only_a, only_b): how many whole rows of a document one side alone has, null equal to null (JN-15). Rows are
    counted on either side and the counts compared, so repeated rows count and nothing is joined row by row."""
    side = lambda df, x: df.select(*a.columns, F.lit(x).alias("_s"))
    counts = side(a, 1).unionByName(side(b, -1)).groupBy(*a.columns).agg(F.sum("_s").alias("_d"))
    return counts.groupBy(on).agg(F.sum(F.greatest("_d", F.lit(0))).cast("long").alias("only_a"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).cast("long").alias("only_b"))


def context_conflicts(declared: DataFrame, supplied: DataFrame, names: list[str], on: str = "doc_id") -> DataFrame:
    """(on, conflicts, names): what is supplied must equal what is declared or stand alone (JN-16); conflicts are the names
    that differ, and each name has the value that is known."""
    s = supplied.select(on, *[F.col(n).alias(f"_{n}") for n in names])
    both = declared.join(s, on, "full")
    differ = [F.when(F.col(n) != F.col(f"_{n}"), F.lit(n)) for n in names]
    return both.select(on, F.array_compact(F.array(*differ)).alias("conflicts"), *[F.coalesce(n, f"_{n}").alias(n) for n in names])


def structural_keys(readings: DataFrame) -> DataFrame:
    """(doc_id, reading, key): equal for readings that say the same of the same words (SCH-18), however their rows are cut.

    readings: doc_id, reading, at, posting_date, description, amount, balance_after, economic, tokens (array of spans).
    """
    own = F.struct("at", "posting_date", "description", "amount", "balance_after", "economic", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    whole = readings.groupBy("doc_id", "reading").agg(F.array_sort(F.collect_list(own)).alias("own"))
    return whole.select("doc_id", "reading", F.sha2(F.to_json("own", {"ignoreNullFields": "false"}), 256).alias("key"))


def daily_last(tx: DataFrame, day: str = "posting_date", order: str = "doc_order", balance: str = "balance_after") -> DataFrame:
    """(doc_id, day, last): the balance after a day's last movement, which the day's printed balance must equal (AGG-5)."""
    return tx.groupBy("doc_id", F.col(day).alias("day")).agg(F.max_by(balance, order).alias("last"))


def daily_mismatches(tx: DataFrame, printed: DataFrame) -> DataFrame:
    """(doc_id, day, problem) of printed (doc_id, day, balance): a day without movements is empty, another balance differs."""
    both = printed.join(daily_last(tx), ["doc_id", "day"], "left")
    return both.withColumn("problem", F.when(F.col("last").isNull(), "empty").when(F.col("last") != F.col("balance"), "differs")).where("problem is not null").select("doc_id", "day", "problem")
