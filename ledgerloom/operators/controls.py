"""Control topology: which movements each printed balance, subtotal and total speaks of, what it refers to, and what breaks
that order (SCH-8c, SCH-10, WIN-11, JN-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import spans

# Roles of balances, and problems from the gravest on.
BALANCES = ("opening_balance", "closing_balance", "running_balance", "daily_balance", "sparse_checkpoint")
PROBLEMS = ("control_scope_or_membership", "control_source_reused", "control_interval_domain", "circular_financial_control", "control_reference_missing", "subtotal_interval_overlap", "control_reference_order")


def balance_intervals(points: DataFrame) -> DataFrame:
    """(doc_id, control, role, begin, end, refs) of points (doc_id, control, role, after): each balance refers to the cut
    before it and covers what moved since; a closing balance refers to the opening one, where that is printed at 0.

    Of several points at one cut the first by role and name is referred to. Windows over one document's distinct cuts.
    """
    first = F.min(F.struct("role", "control"))
    cuts = points.groupBy("doc_id", "after").agg(first.alias("_f"), F.min(F.when((F.col("role") == "opening_balance") & (F.col("after") == 0), F.col("control"))).alias("_o"))
    order, doc = W.partitionBy("doc_id").orderBy("after"), W.partitionBy("doc_id")
    cuts = cuts.withColumns({"_p": F.lag("_f.control").over(order), "_at": F.lag("after").over(order), "_open": F.max("_o").over(doc)})
    p = points.join(cuts.select("doc_id", "after", "_p", "_at", "_open"), ["doc_id", "after"])
    closes = (F.col("role") == "closing_balance") & (F.col("after") > 0) & F.col("_open").isNotNull()
    ref, begin = F.when(closes, F.col("_open")).otherwise(F.col("_p")), F.when(closes, 0).otherwise(F.coalesce("_at", "after"))
    return p.select("doc_id", "control", "role", begin.cast("int").alias("begin"), F.col("after").cast("int").alias("end"), F.array_compact(F.array(ref)).alias("refs"))


def subtotal_intervals(flows: DataFrame) -> DataFrame:
    """(doc_id, control, role, begin, end, refs) of flows (doc_id, control, member): from the first movement to the last."""
    return flows.groupBy("doc_id", "control").agg(F.min("member").cast("int").alias("begin"), (F.max("member") + 1).cast("int").alias("end")).select("doc_id", "control", F.lit("subtotal").alias("role"), "begin", "end", F.array().cast("array<bigint>").alias("refs"))


def total_intervals(totals: DataFrame, movements: DataFrame) -> DataFrame:
    """(doc_id, control, role, begin, end, refs, members) of declared totals: the whole scope, with the movements of its sign.
    Zero is a credit."""
    m = movements.groupBy("doc_id").agg(F.count("*").cast("int").alias("end"), F.array_sort(F.collect_list(F.when(F.col("amount") >= 0, F.col("index")))).alias("_c"), F.array_sort(F.collect_list(F.when(F.col("amount") < 0, F.col("index")))).alias("_d"))
    t = totals.join(m, "doc_id")
    return t.select("doc_id", "control", "role", F.lit(0).alias("begin"), "end", F.array().cast("array<bigint>").alias("refs"), F.when(F.col("role") == "credit_total", F.col("_c")).otherwise(F.col("_d")).alias("members"))


def topology(controls: DataFrame, movements: DataFrame) -> DataFrame:
    """(doc_id, problem, independent): the gravest problem of a document's controls, and how many distinct sets of
    movements they speak of.

    controls: (doc_id, control, scope, role, begin, end, refs); control names the words it stands on. movements:
    (doc_id, index, source, scope), the index economic, from 0.
    """
    size = movements.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.first("scope").alias("_scope"))
    c = controls.join(size, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flag = lambda df, name: df.select("doc_id", F.lit(name).alias("problem")).distinct()
    balance, role = F.col("role").isin(*BALANCES), F.col("role")
    empty = (F.col("begin") == F.col("end")) & (~balance | (F.size("refs") > 0))
    off = (
        (F.col("begin") < 0) | (F.col("begin") > F.col("end")) | (F.col("end") > F.col("n")) | empty
        | ((role == "opening_balance") & (F.col("end") > 0)) | ((role == "closing_balance") & (F.col("end") != F.col("n"))) | ((role == "running_balance") & (F.col("end") == 0))
        | (role.isin("credit_total", "debit_total") & ((F.col("begin") != 0) | (F.col("end") != F.col("n"))))
    )
    each = controls.select("doc_id", "control", F.explode("refs").alias("ref"))
    moved = movements.select("doc_id", F.col("source").alias("control"))
    broken = spans.references(controls)
    roles = each.join(controls.select("doc_id", "control", F.col("role").alias("a")), ["doc_id", "control"]).join(controls.select("doc_id", F.col("control").alias("ref"), F.col("role").alias("b")), ["doc_id", "ref"])
    found = [
        flag(c.where((F.col("scope") != F.coalesce("_scope", "scope")) | (role == "movement")), "control_scope_or_membership"),
        flag(controls.groupBy("doc_id", "control").count().where("count > 1"), "control_source_reused"),
        flag(c.where(off), "control_interval_domain"),
        flag(controls.join(moved, ["doc_id", "control"], "left_semi"), "circular_financial_control"),
        flag(each.where("ref = control"), "circular_financial_control"),
        flag(each.join(moved.withColumnRenamed("control", "ref"), ["doc_id", "ref"], "left_semi"), "circular_financial_control"),
        flag(broken.where("problem = 'control_reference_missing'"), "control_reference_missing"),
        flag(spans.crossing(controls.where(role == "subtotal").select("doc_id", "control", "begin", "end").distinct()).where("crosses"), "subtotal_interval_overlap"),
        flag(broken.where("problem = 'control_reference_order'"), "control_reference_order"),
        flag(roles.where(~F.col("a").isin(*BALANCES) | ~F.col("b").isin(*BALANCES)), "control_reference_order"),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    rank = F.array_position(F.array(*[F.lit(p) for p in PROBLEMS]), F.col("problem"))
    worst = every.groupBy("doc_id").agg(F.min_by("problem", rank).alias("problem"))
    # An interval is the set of its movements: equal intervals prove nothing twice.
    sets = controls.where("begin < end").groupBy("doc_id").agg(F.count_distinct("begin", "end").alias("independent"))
    return controls.select("doc_id").distinct().join(worst, "doc_id", "left").join(sets, "doc_id", "left").na.fill(0, ["independent"])


def control_evidence(rows: DataFrame) -> DataFrame:
    """(doc_id, position, role, admitted, rule, members) of classified rows with is_head: a flow's subtotal needs members, a
    dated balance and a checkpoint are declared by their rows."""
    order = W.partitionBy("doc_id").orderBy("position")
    closes = F.col("kind").isin("flow", "date_heading")
    before = F.sum(F.col("is_head").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    r = rows.withColumns({"_before": before, "_all": F.sum(F.col("is_head").cast("int")).over(W.partitionBy("doc_id"))})
    marks = r.withColumn("_next", F.first(F.when(closes, F.col("_before")), True).over(order.rowsBetween(1, W.unboundedFollowing)))
    members = F.when(F.col("kind") == "flow", F.coalesce("_next", "_all") - F.col("_before")).when(F.col("kind") == "checkpoint", F.col("_before")).otherwise(0)
    role = F.when(F.col("kind") == "flow", "subtotal").when((F.col("kind") == "date_heading") & (F.size("amounts") > 0), "daily_balance").when(F.col("kind") == "checkpoint", "sparse_checkpoint")
    m = marks.withColumns({"role": role, "members": members.cast("long")}).where("role is not null")
    rule = F.when(F.col("role") == "subtotal", F.when(F.col("members") > 0, "declared_flow_group").otherwise("empty_declared_flow_group")).when(F.col("role") == "daily_balance", "declared_dated_boundary").otherwise("declared_transaction_cut")
    return m.select("doc_id", "position", "role", ((F.col("role") != "subtotal") | (F.col("members") > 0)).alias("admitted"), rule.alias("rule"), "members")


def empty_headings(rows: DataFrame) -> DataFrame:
    """(doc_id, position) of date headings without a movement before the next heading or the end: an anti join of heading
    groups with groups that have one."""
    order = W.partitionBy("doc_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = rows.withColumn("_g", F.max(F.when(F.col("kind") == "date_heading", F.col("position"))).over(order)).where("_g is not null")
    moved = r.where("is_head").select("doc_id", "_g").distinct()
    return r.where("kind = 'date_heading'").join(moved, ["doc_id", "_g"], "left_anti").select("doc_id", "position")
