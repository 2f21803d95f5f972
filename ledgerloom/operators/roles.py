"""Roles of money by structure alone: isolated cells that stand in a recurring column, and balances that only the search can
tell to be the first or the last (SCH-7, SCH-8, SCH-8b, JN-8). No amount is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators.geometry import Tolerances


def observe_money(rows: DataFrame) -> DataFrame:
    """(doc_id, position, page, row, word_start, word_end): a row for each amount (SCH-8b)."""
    return rows.select("doc_id", "position", "page", "row", F.explode("amounts").alias("a")).select("doc_id", "position", "page", "row", F.col("a.start").alias("word_start"), F.col("a.end").alias("word_end"))


def boundary_roles(text: Column) -> Column:
    """Roles that a label of a balance may have: a bare "saldo" is the opening or the closing one."""
    labels, bare = lexical.balance_labels(text), F.rtrim(F.lower(text), F.lit(":")) == "saldo"
    one = lambda *names: F.array(*[F.lit(n) for n in names])
    kind = F.get(labels, 0)
    return F.when(bare, one("closing_balance", "opening_balance")).when((F.size(labels) == 1) & kind.isin("inicial", "anterior"), one("opening_balance")).when((F.size(labels) == 1) & kind.isin("final", "total"), one("closing_balance")).otherwise(F.array().cast("array<string>"))


def relational_roles(cells: DataFrame, segments: DataFrame, headings: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """(doc_id, position, cut, column, roles, refusal) of isolated money cells.

    cells: (doc_id, position, page, top, bottom, x0, x1). segments: (doc_id, seg, position, last, page, top, bottom,
    last_page, last_top, last_bottom, amounts), amounts array(struct(x0, x1)) of its first row. headings: (doc_id, position).

    The columns of a document come from one aggregation. A cell's neighbours are as-of lookups, made by a window over the
    document's cells and segments in order, without a join of the two.
    """
    two = F.size("amounts") == 2
    a, b = F.get("amounts", 0), F.get("amounts", 1)
    edge = lambda f, x: f(x)
    columns = segments.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_and(two).alias("two"),
        *[edge(f, m[side]).alias(f"{name}{side}{k}") for k, m in enumerate((a, b)) for side in ("x0", "x1") for name, f in (("lo", F.min), ("hi", F.max))],
    )
    none = lambda t: F.lit(None).cast(t)
    box = "struct<page:int,top:double,bottom:double>"
    at = segments.select("doc_id", "position", F.struct(F.col("page").cast("int").alias("page"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom")).alias("first"), F.struct(F.col("last_page").cast("int").alias("page"), F.col("last_top").cast("double").alias("top"), F.col("last_bottom").cast("double").alias("bottom")).alias("end"), F.col("position").alias("seg_at"), F.col("last").alias("seg_end"), none("int").alias("head_at"), none("struct<page:int,top:double,bottom:double,x0:double,x1:double>").alias("cell"))
    one = cells.select("doc_id", "position", none(box).alias("first"), none(box).alias("end"), none("int").alias("seg_at"), none("int").alias("seg_end"), none("int").alias("head_at"), F.struct(F.col("page").cast("int").alias("page"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1")).alias("cell"))
    heads = headings.select("doc_id", "position", none(box).alias("first"), none(box).alias("end"), none("int").alias("seg_at"), none("int").alias("seg_end"), F.col("position").cast("int").alias("head_at"), none("struct<page:int,top:double,bottom:double,x0:double,x1:double>").alias("cell"))
    every = at.withColumns({"seg_at": F.col("seg_at").cast("int"), "seg_end": F.col("seg_end").cast("int")}).unionByName(one).unionByName(heads)
    order = W.partitionBy("doc_id").orderBy("position")
    past, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    r = every.withColumns({
        "cut": F.count("seg_at").over(past), "before": F.last("end", True).over(past), "before_end": F.last("seg_end", True).over(past), "after": F.first("first", True).over(ahead), "after_at": F.first("seg_at", True).over(ahead),
        "head_past": F.max("head_at").over(past), "head_ahead": F.min("head_at").over(ahead),
    }).where("cell is not null").join(columns, "doc_id", "left")
    near = lambda o: F.coalesce((F.col(f"{o}.page") == F.col("cell.page")) & (F.least(F.abs(F.col("cell.top") - F.col(f"{o}.bottom")), F.abs(F.col(f"{o}.top") - F.col("cell.bottom"))) <= tolerances.summary_y), F.lit(False))
    spread = lambda k, side: F.greatest(F.col(f"cell.{side}"), F.col(f"hi{side}{k}")) - F.least(F.col(f"cell.{side}"), F.col(f"lo{side}{k}")) <= tolerances.row_y
    aligned = [spread(k, "x0") | spread(k, "x1") for k in (0, 1)]
    adjacent = near("before") | near("after")
    frontier = F.col("cut").isin(0) | (F.col("cut") == F.col("n"))
    between = F.coalesce(F.col("head_past") > F.col("before_end"), F.lit(False)) | F.coalesce(F.col("head_ahead") < F.col("after_at"), F.lit(False))
    refusal = (
        F.when(F.coalesce(F.col("n") < 2, F.lit(True)) | ~F.col("two"), "no_structural_owner").when(F.col("hix10") + tolerances.row_y >= F.col("lox01"), "unsupported_transaction_geometry")
        .when(aligned[0] & aligned[1], "conflicting_structural_evidence").when(~aligned[0] & ~aligned[1], "role_evidence_insufficient")
        .when(~adjacent | ~(frontier | between), "unsupported_control_structure")
    )
    roles = F.when(refusal.isNotNull(), F.array().cast("array<string>")).when(frontier, F.array(F.lit("closing_balance"), F.lit("opening_balance"))).otherwise(F.array(F.lit("sparse_checkpoint")))
    return r.select("doc_id", "position", F.when(refusal.isNull(), F.col("cut")).alias("cut"), F.when(refusal.isNull(), F.when(aligned[0], 0).otherwise(1)).cast("int").alias("column"), roles.alias("roles"), refusal.alias("refusal"))
