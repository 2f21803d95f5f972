"""Rows from positioned words, and relations between positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tolerances:
    """Distances in points; finite and not negative. Names and defaults are fixed values."""

    row_y: float = 3.0
    token_gap: float = 12.0
    summary_y: float = 30.0

    def __post_init__(self) -> None:
        for v in (self.row_y, self.token_gap, self.summary_y):
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v < float("inf"):
                raise ValueError("tolerances are finite distances of zero or more")


WORD = "struct<word_no:int,text:string,x0:double,x1:double,top:double,bottom:double>"


def reconstruct_rows(words: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """words(doc_id, page, word_no, text, x0, x1, top, bottom) -> rows(doc_id, page, row, words, text).

    A row starts where a word's centre is more than row_y below the row's first word, not below its last. So it is a fold
    over the page's words in order, which keeps where rows start; rows are then cut out of the page's array, so that words
    are shuffled once, by page. A page bounds the array, whatever the corpus.
    """
    centre = (F.col("top") + F.col("bottom")) / 2
    word = F.struct(centre.alias("centre"), "x0", "text", "word_no", "x1", "top", "bottom")
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["anchor"].isNull() | (w["centre"] - acc["anchor"] > tolerances.row_y)
        return F.when(new, F.struct(w["centre"].alias("anchor"), F.concat(acc["starts"], F.array(w["at"])).alias("starts"))).otherwise(acc)

    placed = F.transform("ws", lambda w, i: F.struct(w["centre"].alias("centre"), i.alias("at")))
    numbered = pages.withColumn("starts", F.aggregate(placed, start, step)["starts"])

    def cells(s: Column, k: Column) -> Column:
        own = F.slice("ws", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ws")) - s)
        return F.array_sort(F.transform(own, lambda w: F.struct(*[w[n].alias(n) for n in ("x0", "centre", "text", "word_no", "x1", "top", "bottom")])))

    rows = numbered.select("doc_id", "page", F.posexplode(F.transform("starts", cells)).alias("k", "ws"))
    return rows.select(
        "doc_id", "page", (F.col("k") + 1).alias("row"),
        F.transform("ws", lambda w: F.struct(w["word_no"].alias("word_no"), w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["top"].alias("top"), w["bottom"].alias("bottom"))).alias("words"),
        F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"),
    )


def _unusable(at) -> Column:
    """Whether a word, whose parts at names, is blank, has positions that aren't finite, or a box without area."""
    numbers = [at(n) for n in ("x0", "x1", "top", "bottom")]
    finite = F.lit(True)
    for n in numbers:
        finite = finite & n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return ~F.coalesce(finite & (F.trim(at("text")) != "") & (at("x1") > at("x0")) & (at("bottom") > at("top")), F.lit(False))


def invalid_words(words: DataFrame) -> DataFrame:
    """Words that no row may be built from."""
    return words.where(_unusable(F.col))


def has_invalid(words: Column) -> Column:
    """Whether a row's words hold such a one."""
    return F.exists(words, lambda w: _unusable(lambda n: w[n]))


def normalized(value: Column, size: Column) -> Column:
    return F.when((size > 0) & ~F.isnan(size), value / size)


def same_row(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column, tolerance: float) -> Column:
    return F.abs((top_a + bottom_a) / 2 - (top_b + bottom_b) / 2) <= tolerance


def aligned(x0_a: Column, x0_b: Column, tolerance: float) -> Column:
    return F.abs(x0_a - x0_b) <= tolerance


def near(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float) -> Column:
    return F.hypot(ax - bx, ay - by) <= tolerance


def number_rows(rows: DataFrame) -> DataFrame:
    """position: place of a row in its document, from 0."""
    return rows.withColumn("position", (F.row_number().over(W.partitionBy("doc_id").orderBy("page", "row")) - 1).cast("int"))
