"""Queries of the line layouts: statements rendered as text pages from orders, read back line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import layouts
from ledgerloom.plans.queries import M, dec, query
from ledgerloom.sources import files, render


def _pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text) of lines (doc_id, page, at, text), with blank lines and margins between them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: F.concat(F.lit("  "), x["text"], F.lit(" \n"))), "\n")
    return lines.groupBy("doc_id", "page").agg(joined.alias("text"))


def _day(c: str) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def _marked(amount: Column) -> Column:
    return F.concat(lexical.display_money(F.abs(amount)), F.when(amount < 0, " D").otherwise(" C"))


def _at(k: int, text: Column, page: int = 1) -> Column:
    return F.struct(F.lit(page).alias("page"), F.lit(float(k)).alias("at"), text.alias("text"))


def demo_lines(m: DataFrame) -> DataFrame:
    """Of accounts with id 0 by 9 a line is odd, with 1 the closing balance lacks, with 2 a date is impossible."""
    b = render.bounds(m).withColumn("k", F.pmod("doc_id", F.lit(9)))
    head = [_at(1, F.lit(layouts.DEMO_HEADERS[0])), _at(2, F.lit(layouts.DEMO_HEADERS[1])), _at(3, F.concat(F.lit("Periodo: "), _day("period_begin"), F.lit(" a "), _day("period_end"))), _at(4, F.concat(F.lit(layouts.DEMO_OPENING), _marked(F.col("opening"))))]
    end = F.when(F.col("k") != 1, _at(10**6, F.concat(F.lit(layouts.DEMO_CLOSING), _marked(F.col("closing")))))
    odd = F.when(F.col("k") == 0, _at(10**5, F.lit("01/01/2027 compra R$ 1,00 C"))).when(F.col("k") == 2, _at(10**5, F.lit("31/02/2027 COMPRA R$ 1,00 C")))
    frame = b.select("doc_id", F.explode(F.array_compact(F.array(*head, odd, end))).alias("c")).select("doc_id", "c.*")
    body = m.select("doc_id", (F.col("doc_order") % 2 * 0 + 1).cast("int").alias("page"), (F.col("doc_order") + 10.0).alias("at"), F.concat_ws("  ", _day("posting_date"), "description", _marked(F.col("amount"))).alias("text"))
    return files.text_lines(_pages(frame.unionByName(body)))


@query(M + """, t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'line' WHEN 1 THEN 'balance' WHEN 2 THEN 'date' END AS refusal, count(*) AS n, sum(amount)::DECIMAL(18,2) AS total, min(opening) AS opening, min(posting_date) AS period_begin, max(posting_date) AS period_end, min(description) AS low FROM m GROUP BY 1)
SELECT doc_id, refusal, CASE WHEN refusal IS NULL THEN n END AS n_tx, CASE WHEN refusal IS NULL THEN total END AS total, opening, period_begin, period_end, CASE WHEN refusal IS NULL THEN low END AS least_description FROM t""")
def demo_layout(spark, sf_dir):
    heads, tx = layouts.read_demo(demo_lines(render.movements(spark, sf_dir)))
    sums = tx.groupBy("doc_id").agg(F.count("posting_date").alias("n_tx"), F.sum("amount").alias("total"), F.min("description").alias("least_description"))
    return heads.join(sums, "doc_id", "left").select("doc_id", "refusal", "n_tx", *dec("total", "opening"), "period_begin", "period_end", "least_description")


def digital_lines(m: DataFrame) -> DataFrame:
    """Two pages an account, the second from the third movement on. By 9: 0 a day's balance differs, 1 the last day is empty,
    2 a footer lacks, 3 a second symbol stands in a description, 4 a movement before any day."""
    month = lambda c: F.get(F.array(*[F.lit(x) for x in lexical.MONTHS]), F.month(c) - 1)
    heading = lambda c, money: F.concat_ws(" ", F.dayofmonth(c).cast("string"), F.lit("de"), month(c), F.lit("de"), F.year(c).cast("string"), F.lit("Saldo do dia:"), money, F.lit("Valor Saldo por transação"))
    m = m.withColumns({"k": F.pmod("doc_id", F.lit(9)), "page": F.when(F.col("doc_order") < 3, 1).otherwise(2)})
    b = render.bounds(m).withColumn("k", F.pmod("doc_id", F.lit(9)))
    zero = F.lit("R$ 0,00")
    head = [
        _at(1, F.lit("Solicitado em: 02/03/2027 - 9h30")), _at(2, F.lit("CLIENTE")), _at(3, F.concat(F.lit("CPF 0 Instituição: Banco Inter Agência: 0001-9, Conta: "), F.col("doc_id").cast("string"), F.lit("-5"))),
        _at(4, F.concat(F.lit("Período: "), _day("period_begin"), F.lit(" até "), _day("period_end"))), _at(5, F.lit(layouts.DIGITAL_SUMMARY_HEAD)), _at(6, F.concat_ws(" ", lexical.statement_money(F.col("closing")), zero, zero)),
        F.when(F.col("doc_id") % 2 == 0, _at(7, F.lit(layouts.DIGITAL_SEPARATOR))), F.when(F.col("k") == 4, _at(8, F.lit("ANTES R$ 1,00 R$ 1,00"))), F.when(F.col("k") == 1, _at(10**5, heading("period_end", lexical.statement_money(F.col("closing"))), 2)),
    ]
    foot = [F.when((F.col("k") != 2) | F.lit(p == 1), _at(10**6, F.lit(layouts.DIGITAL_FOOTER), p)) for p in (1, 2)] + [_at(10**6 + 1, F.lit("SAC 0800 000 Ouvidoria 0800 001"), p) for p in (1, 2)]
    frame = b.select("doc_id", F.explode(F.array_compact(F.array(*head, *foot))).alias("c")).select("doc_id", "c.*")
    day = W.partitionBy("doc_id", "posting_date")
    m = m.withColumns({"first": F.row_number().over(day.orderBy("doc_order")) == 1, "end": F.max_by("balance_after", "doc_order").over(day)})
    printed = F.when((F.col("k") == 0) & (F.col("doc_order") == 1), F.col("end") + F.lit("0.01").cast(lexical.CENTS)).otherwise(F.col("end"))
    days = m.where("first").select("doc_id", "page", (F.col("doc_order") + 9.5).alias("at"), heading("posting_date", lexical.statement_money(printed)).alias("text"))
    what = F.when((F.col("k") == 3) & (F.col("doc_order") == 1), F.lit("TAXA R$ 2,00 EXTRA")).otherwise(F.col("description"))
    moves = m.select("doc_id", "page", (F.col("doc_order") + 10.0).alias("at"), F.concat_ws("  ", what, lexical.statement_money(F.col("amount")), lexical.statement_money(F.col("balance_after"))).alias("text"))
    return files.text_lines(_pages(frame.unionByName(days).unionByName(moves)))


@query(M + """, t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'daily_balance' WHEN 1 THEN 'empty_group' WHEN 2 THEN 'footer' WHEN 3 THEN 'column' WHEN 4 THEN 'line' END AS refusal, count(*) AS n, sum(amount)::DECIMAL(18,2) AS total, sum(date_diff('day', DATE '2000-01-01', posting_date))::BIGINT AS days, arg_max(balance_after, doc_order) AS closing FROM m GROUP BY 1)
SELECT doc_id, refusal, CASE WHEN refusal IS NULL THEN n END AS n_tx, CASE WHEN refusal IS NULL THEN total END AS total, CASE WHEN refusal IS NULL THEN days END AS days, closing, '0001-9' AS branch_id, doc_id || '5' AS account_id FROM t""")
def digital_layout(spark, sf_dir):
    heads, tx = layouts.read_digital(digital_lines(render.movements(spark, sf_dir)))
    sums = tx.groupBy("doc_id").agg(F.count("balance_after").alias("n_tx"), F.sum("amount").alias("total"), F.sum(F.date_diff("posting_date", F.lit("2000-01-01").cast("date"))).alias("days"))
    return heads.join(sums, "doc_id", "left").select("doc_id", "refusal", "n_tx", *dec("total"), "days", *dec("closing"), "branch_id", "account_id")


@query("SELECT DISTINCT o_custkey::BIGINT AS doc_id, CASE o_custkey % 4 WHEN 0 THEN 'demo' WHEN 1 THEN 'digital' END AS layout FROM orders JOIN customer ON o_custkey = c_custkey")
def layout_detection(spark, sf_dir):
    """Accounts with id 2 by 4 have the bank's name in a description alone, with 3 the headers on other lines."""
    m = render.movements(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(4))
    demo, digital = demo_lines(m), digital_lines(m)
    moved = demo.where(k == 3).withColumn("line", F.col("line") + 1).unionByName(demo.where(k == 3).select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("line"), F.lit("OUTRO").alias("text")).distinct())
    named = digital.where((k == 2) & ~((F.col("page") == 1) & (F.col("line") == 3))).withColumn("text", F.concat(F.col("text"), F.lit(" Banco Inter Agência: 1 Conta: 2")))
    return layouts.detect(demo.where(k == 0).unionByName(digital.where(k == 1)).unionByName(moved).unionByName(named))
