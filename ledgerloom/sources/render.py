"""Statements rendered from accounts and movements, and layouts from recipes: positioned words to read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.lexical import CENTS, statement_money

#: Columns of a rendered page, in points, and the width of a character.
LEFT, AMOUNT, BALANCE, CHAR, LINE = 35.0, 330.0, 460.0, 6.0, 18.0


def words_from_cells(cells: DataFrame) -> DataFrame:
    """cells(doc_id, page, y, x, text) -> words; a cell's text is split at spaces, characters have one width."""
    ws = F.split("text", " ")
    c = cells.withColumn("ws", ws)
    start = F.transform("ws", lambda w, i: F.length(F.array_join(F.slice("ws", F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0))
    each = c.withColumn("at", start).select("doc_id", "page", "y", "x", F.posexplode(F.arrays_zip("ws", "at")).alias("k", "z")).where("z.ws <> ''")
    x0 = F.col("x") + F.col("z.at") * CHAR
    return each.select(
        "doc_id", "page", F.xxhash64("y", "x", "k").alias("_o"), F.col("z.ws").alias("text"), x0.alias("x0"), (x0 + F.length("z.ws") * CHAR).alias("x1"), (F.col("y") * 1.0).alias("top"), (F.col("y") + 10.0).alias("bottom"), "y", "k",
    ).withColumn("word_no", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("y", "x0")).cast("int")).select("doc_id", "page", "word_no", "text", "x0", "x1", "top", "bottom")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_order, posting_date, description, amount, balance_after, opening) of each customer with orders: finished
    orders are credits, others debits, and the account opens with the customer's balance."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    m = orders.join(customers, orders.o_custkey == customers.c_custkey)
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice").cast(CENTS)
    m = m.select(
        F.col("o_custkey").cast("long").alias("doc_id"), F.row_number().over(order).alias("doc_order"), F.col("o_orderdate").cast("date").alias("posting_date"),
        F.concat(F.lit("PEDIDO "), F.regexp_replace("o_orderpriority", "[^A-Z]", "")).alias("description"),
        F.when(F.col("o_orderstatus") == "F", price).otherwise(-price).cast(CENTS).alias("amount"), F.col("c_acctbal").cast(CENTS).alias("opening"), F.col("o_orderkey").alias("key"),
    )
    run = F.sum("amount").over(W.partitionBy("doc_id").orderBy("doc_order"))
    return m.withColumn("balance_after", (F.col("opening") + run).cast(CENTS))


def bounds(m: DataFrame) -> DataFrame:
    """(doc_id, opening, closing, period_begin, period_end) of movements."""
    return m.groupBy("doc_id").agg(F.first("opening").alias("opening"), F.max_by("balance_after", "doc_order").alias("closing"), F.min("posting_date").alias("period_begin"), F.max("posting_date").alias("period_end"))


def _day(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


#: What a faulty statement lacks or breaks, by doc_id modulo 8.
FAULTS = {0: "balance", 1: "no_closing", 2: "no_controls", 3: "unreadable"}


def statement_cells(m: DataFrame, faults: bool = False) -> DataFrame:
    """One page a statement: period, opening and closing lines, then a dated row with amount and running balance."""
    b = bounds(m)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in FAULTS.items() for x in kv]), F.pmod(F.col("doc_id"), F.lit(8)).cast("int")) if faults else F.lit(None).cast("string")
    cell = lambda y, x, text: F.struct(F.lit(y).alias("y") if isinstance(y, float) else y.alias("y"), F.lit(x).alias("x"), text.alias("text"))
    h = b.withColumn("fault", kind)
    bare = F.coalesce(F.col("fault") == "no_controls", F.lit(False))
    head = F.array_compact(F.array(
        cell(40.0, LEFT, F.concat(F.lit("Período: "), _day(F.col("period_begin")), F.lit(" a "), _day(F.col("period_end")))),
        F.when(~bare, cell(60.0, LEFT, F.concat(F.lit("Saldo inicial: "), statement_money(F.col("opening"))))),
        F.when(~bare & F.coalesce(F.col("fault") != "no_closing", F.lit(True)), cell(80.0, LEFT, F.concat(F.lit("Saldo final: "), statement_money(F.col("closing"))))),
    ))
    top = h.select("doc_id", F.explode(head).alias("c"))
    r = m.withColumn("fault", kind)
    y = (F.lit(100.0) + F.col("doc_order") * LINE)
    wrong = F.when((F.col("fault") == "balance") & (F.col("doc_order") == 1), F.col("balance_after") + F.lit("0.01").cast(CENTS)).otherwise(F.col("balance_after"))
    printed = F.when((F.col("fault") == "unreadable") & (F.col("doc_order") == 1), F.lit("R$ 1 234,5")).otherwise(statement_money(F.col("amount")))
    row = F.array_compact(F.array(
        cell(y, LEFT, F.concat_ws(" ", _day(F.col("posting_date")), "description")), cell(y, AMOUNT, printed),
        F.when(F.coalesce(F.col("fault") != "no_controls", F.lit(True)), cell(y, BALANCE, statement_money(wrong))),
    ))
    body = r.select("doc_id", F.explode(row).alias("c"))
    return top.unionByName(body).select("doc_id", F.lit(1).alias("page"), "c.y", "c.x", "c.text")


def grouped_cells(m: DataFrame) -> DataFrame:
    """Dates as headings of their own, rows of description and amount below."""
    d = m.withColumn("first_of_day", F.row_number().over(W.partitionBy("doc_id", "posting_date").orderBy("doc_order")) == 1)
    y = F.lit(100.0) + F.col("doc_order") * 2 * LINE
    head = d.where("first_of_day").select("doc_id", (y - LINE).alias("y"), F.lit(LEFT).alias("x"), _day(F.col("posting_date")).alias("text"))
    body = d.select("doc_id", y.alias("y"), F.explode(F.array(F.struct(F.lit(LEFT).alias("x"), F.col("description").alias("text")), F.struct(F.lit(AMOUNT).alias("x"), statement_money(F.col("amount")).alias("text")))).alias("c")).select("doc_id", "y", "c.x", "c.text")
    return head.unionByName(body).withColumn("page", F.lit(1)).select("doc_id", "page", "y", "x", "text")


def recipe_cells(spark: SparkSession, path: str) -> DataFrame:
    """Layout recipes, one JSON file a document: {"pages": [[{"y", "cells": [[x, text], ...]}]]}."""
    raw = spark.read.schema("pages array<array<struct<y:double,cells:array<array<string>>>>>").option("multiLine", True).json(path)
    doc = F.col("_metadata.file_path")
    pages = raw.select(F.xxhash64(doc).alias("doc_id"), F.posexplode("pages").alias("p", "rows")).select("doc_id", (F.col("p") + 1).alias("page"), F.explode("rows").alias("r"))
    return pages.select("doc_id", "page", F.col("r.y").alias("y"), F.explode("r.cells").alias("c")).select("doc_id", "page", "y", F.get("c", 0).cast("double").alias("x"), F.get("c", 1).alias("text"))
