"""Queries of the whole way with all its readings: columns, orders, labels above values, frames and refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import export, reports
from ledgerloom.plans import application
from ledgerloom.plans.queries import M, dec, query
from ledgerloom.plans.statements import analyze
from ledgerloom.sources import render


def varied_cells(m):
    """By id modulo 12: 0 plain; 1 the balance left of the movement; 2 the newest row first; 3 two opening balances; 4 money in
    the header without a label; 5 and 10 a contact footer; 6 the closing balance below its label; 7 dates as headings and no control;
    8 a second row without a date; 9 a description that names a balance; 11 a wrong balance."""
    b = render.bounds(m).withColumn("k", F.pmod("doc_id", F.lit(12)))
    k = F.col("k")
    cell = lambda y, x, text: F.struct((F.lit(y) if isinstance(y, float) else y).cast("double").alias("y"), F.lit(x).alias("x"), text.alias("text"))
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    money = lambda c: lexical.statement_money(F.col(c))
    b = b.join(m.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    end = F.lit(160.0) + F.col("n") * 40.0
    head = [
        cell(40.0, 35.0, F.concat(F.lit("Período: "), day("period_begin"), F.lit(" a "), day("period_end"))), F.when(k != 7, cell(60.0, 35.0, F.concat(F.lit("Saldo inicial: "), money("opening")))),
        F.when(~k.isin(6, 7), cell(80.0, 35.0, F.concat(F.lit("Saldo final: "), money("closing")))), F.when(k == 6, cell(80.0, 35.0, F.lit("Saldo final"))), F.when(k == 6, cell(98.0, 35.0, money("closing"))),
        F.when(k == 3, cell(110.0, 35.0, F.concat(F.lit("Saldo anterior: "), lexical.statement_money(F.col("opening") + 1)))), F.when(k == 4, cell(110.0, 35.0, F.concat(F.lit("Limite "), money("closing")))),
        F.when(k == 5, cell(end, 35.0, F.lit("Fale conosco"))), F.when(k == 5, cell(end + 20, 35.0, F.lit("SAC e Ouvidoria"))),
        F.when(k == 10, cell(end, 35.0, F.lit("Fale conosco"))), F.when(k == 10, cell(end + 20, 35.0, F.lit("SAC e Ouvidoria"))),
    ]
    frame = b.select("doc_id", F.explode(F.array_compact(F.array(*head))).alias("c"))
    r = m.join(b.select("doc_id", "n", "k"), "doc_id")
    at = F.when(k == 2, F.col("n") - F.col("doc_order")).otherwise(F.col("doc_order"))
    y = F.lit(120.0) + at * 40.0
    dated = ~k.isin(7) & ~((k == 8) & (F.col("doc_order") == 2))
    what = F.when((k == 9) & (F.col("doc_order") == 1), F.lit("Saldo bloqueado")).otherwise(F.col("description"))
    after = F.when((k == 11) & (F.col("doc_order") == F.col("n")), F.col("balance_after") + F.lit("0.01").cast(lexical.CENTS)).otherwise(F.col("balance_after"))
    row = [
        F.when(k == 7, cell(y - 20, 35.0, day("posting_date"))), F.when(dated, cell(y, 35.0, day("posting_date"))), cell(y, 110.0, what), F.when(k == 1, cell(y, 330.0, money("balance_after"))).otherwise(cell(y, 330.0, money("amount"))),
        F.when(k == 1, cell(y, 460.0, money("amount"))).when(k != 7, cell(y, 460.0, lexical.statement_money(after))),
    ]
    body = r.select("doc_id", F.explode(F.array_compact(F.array(*row))).alias("c"))
    return frame.unionByName(body).select("doc_id", F.lit(1).alias("page"), "c.*")


@query(M + """, t AS (SELECT doc_id, CASE WHEN doc_id % 12 = 8 AND count(*) < 2 THEN 0 ELSE doc_id % 12 END AS k, count(*) AS n, sum(amount)::DECIMAL(18,2) AS total FROM m GROUP BY 1),
s AS (SELECT *, CASE k WHEN 3 THEN 'financial_declarations' WHEN 4 THEN 'monetary_role_domain_empty' WHEN 8 THEN 'date_attribution' WHEN 9 THEN 'transaction_segmentation' END AS capability FROM t)
SELECT doc_id, CASE k WHEN 3 THEN 'invalid' WHEN 4 THEN 'unsupported' WHEN 7 THEN 'ambiguous' WHEN 8 THEN 'unsupported' WHEN 9 THEN 'unsupported' WHEN 11 THEN 'invalid' ELSE 'success' END AS status, capability,
CASE WHEN capability IS NULL THEN n END AS n_tx, CASE WHEN capability IS NULL THEN total END AS total, CASE WHEN capability IS NULL AND k <> 11 THEN CASE WHEN k = 1 THEN 1 ELSE 0 END END::BIGINT AS swap FROM s""")
def reading_verdicts(spark, sf_dir):
    v = analyze(render.words_from_cells(varied_cells(render.movements(spark, sf_dir)))).verdicts
    return v.select("doc_id", "status", "capability", F.col("n_tx").cast("long").alias("n_tx"), *dec("total"), F.col("swap").cast("long").alias("swap"))


@query(M + """, t AS (SELECT doc_id, doc_id % 12 AS k, count(*) AS n FROM m GROUP BY 1)
SELECT doc_id, '{"constraints":[],"locations":' || CASE WHEN n > 8 THEN '[' || (SELECT string_agg('{"page":1,"row":' || i || '}', ',' ORDER BY i) FROM range(1, 9) r(i)) || ']' ELSE '[' || (SELECT string_agg('{"page":1,"row":' || i || '}', ',' ORDER BY i) FROM range(1, 9) r(i) WHERE i <= n) || ']' END || ',"omitted_locations":' || greatest(n - 8, 0) || ',"status":"invalid"}' AS report FROM t""")
def diagnostic_json(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    results = m.groupBy("doc_id").agg(F.collect_list(F.struct(F.lit(1).alias("page"), F.col("doc_order").cast("int").alias("row"))).alias("locations")).withColumns({"status": F.lit("invalid"), "constraints": F.array().cast("array<struct<count:int,name:string>>")})
    return reports.diagnose(results)


KINDS = M + """, t AS (SELECT doc_id, CASE WHEN doc_id % 12 = 8 AND count(*) < 2 THEN 0 ELSE doc_id % 12 END AS k, count(*) AS n, count(DISTINCT posting_date) AS d FROM m GROUP BY 1),
s AS (SELECT *, CASE WHEN k IN (3, 11) THEN 'invalid' WHEN k IN (4, 8, 9) THEN 'unsupported' WHEN k = 7 THEN 'ambiguous' ELSE 'success' END AS status FROM t)
"""


@query(KINDS + "SELECT doc_id, status, CASE WHEN status = 'success' THEN 'ready' ELSE 'not_approved' END AS readiness, CASE WHEN status = 'success' THEN n END AS transactions FROM s")
def convert_documents(spark, sf_dir):
    done = application.convert(render.words_from_cells(varied_cells(render.movements(spark, sf_dir))), export.Profile("999", "1"))
    return done.select("doc_id", "status", "readiness", F.size(F.regexp_extract_all("payload", F.lit("<STMTTRN>"), F.lit(0))).cast("long").alias("transactions")).withColumn("transactions", F.when(F.col("transactions") >= 0, F.col("transactions")))


@query(KINDS + """SELECT doc_id, '{"approved":' || (status = 'success') || ',"blocking_capabilities":' || CASE k WHEN 3 THEN '["financial_declarations"]' WHEN 4 THEN '["monetary_role_domain_empty"]' WHEN 8 THEN '["date_attribution"]' WHEN 9 THEN '["transaction_segmentation"]' ELSE '[]' END
|| ',"diagnostic":' || CASE status WHEN 'invalid' THEN '"contradiction"' WHEN 'unsupported' THEN '"unsupported_structure"' WHEN 'ambiguous' THEN '"material_ambiguity"' ELSE 'null' END || ',"export_readiness":"' || CASE WHEN status = 'success' THEN 'ready' ELSE 'not_approved' END || '"' AS report FROM s""")
def diagnose_documents(spark, sf_dir):
    """The report up to the constraints, whose counts depend on ties of dates."""
    done = application.diagnose(render.words_from_cells(varied_cells(render.movements(spark, sf_dir))), export.Profile("999", "1"))
    return done.select("doc_id", F.substring_index("report", ',"pruned_constraints"', 1).alias("report"))
