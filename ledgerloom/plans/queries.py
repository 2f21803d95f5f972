"""The registered queries of the ledger engine, each with the SQL that gives the same rows from the base tables.

Statements are rendered from orders (see sources.render) and read back; the SQL never sees the rendered text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import checks, corpus, export, frames, geometry, reports, search, spans, statement
from ledgerloom.plans.statements import analyze, read_rows
from ledgerloom.sources import files, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D = "decimal(18,2)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return t.select(*columns) if columns else t


def big(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def dec(*names: str) -> list:
    return [F.col(n).cast(D).alias(n) for n in names]


M = """WITH m0 AS (
  SELECT o_custkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS doc_order,
    o_orderdate::DATE AS posting_date, 'PEDIDO ' || regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS description,
    (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS amount,
    c_acctbal::DECIMAL(18,2) AS opening, o_orderkey AS key
  FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, (opening + sum(amount) OVER (PARTITION BY doc_id ORDER BY doc_order ROWS UNBOUNDED PRECEDING))::DECIMAL(18,2) AS balance_after FROM m0)
"""


# Scalar functions


@query("SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total, count(*) AS n FROM orders GROUP BY 1")
def money_roundtrip(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    text = lexical.display_money(F.col("o_totalprice").cast(lexical.CENTS))
    return o.withColumn("amount", lexical.money(text)["amount"]).groupBy("o_orderstatus").agg(F.sum("amount").cast(D).alias("total"), F.count("amount").alias("n"))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM orders GROUP BY 1")
def money_marker_sign(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    text = F.concat(lexical.display_money(F.col("o_totalprice").cast(lexical.CENTS)), F.when(F.col("o_orderstatus") == "F", " C").otherwise(" D"))
    return o.withColumn("amount", lexical.money(text)["amount"]).groupBy("o_custkey").agg(F.sum("amount").cast(D).alias("total"))


ACCEPTED = ["0,00", "R$ 1.234,56", "-R$ 0,01", "+1,00", "12,34 C", "- 5,00 D", "1234567,89", "R$1,00"]
REJECTED = ["01,00", "1.23,45", "1,2", "1,234", "1 234,56", "-1,00 C", "+1,00 D", "US$ 1,00", "1.234.56,00", "1,00 X", "１,00", "", "R$", "1.2345,67", "1,00\n", "--1,00"]


def _values(items: list[str]) -> str:
    return ", ".join("('" + t.replace("'", "''") + "')" for t in items)


@query(f"SELECT r_regionkey::BIGINT AS r_regionkey, t AS text, ok AS accepted FROM region CROSS JOIN (SELECT t, true AS ok FROM (VALUES {_values(ACCEPTED)}) a(t) UNION ALL SELECT t, false FROM (VALUES {_values(REJECTED)}) b(t))")
def money_reject(spark, sf_dir):
    r = load(spark, sf_dir, "region", "r_regionkey").withColumn("text", F.explode(F.array(*[F.lit(t) for t in ACCEPTED + REJECTED])))
    return r.select(*big("r_regionkey"), "text", lexical.money(F.col("text")).isNotNull().alias("accepted"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
def date_forms(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("d", F.col("o_orderdate").cast("date"))
    month = F.get(F.array(*[F.lit(m) for m in lexical.MONTHS]), F.month("d") - 1)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" de ", F.dayofmonth("d").cast("string"), month, F.year("d").cast("string"))).otherwise(F.concat_ws(" ", F.dayofmonth("d").cast("string"), F.upper(F.substring(month, 1, 3)), F.year("d").cast("string")))
    return o.select("o_orderkey", lexical.parse_date(text).alias("d"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'do dia' WHEN 2 THEN 'inicial,disponível' ELSE '' END AS labels FROM nation")
def balance_labels(spark, sf_dir):
    n = load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    text = F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit(" SALDO FINAL: 1"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("Saldo do  dia "), "n_name")).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("saldo inicial e Saldo DISPONÍVEL "), "n_name")).otherwise(F.concat(F.lit("saldos finais "), "n_name"))
    text = F.replace(text, F.lit("do  dia"), F.lit("do dia"))
    return n.select(*big("n_nationkey"), F.array_join(lexical.balance_labels(text), ",").alias("labels"))


@query("SELECT o_custkey, min(o_orderdate::DATE) AS period_begin, max(o_orderdate::DATE) AS period_end, o_custkey % 5 = 0 AS ambiguous FROM orders GROUP BY 1")
def period_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    long_ = lambda c: F.concat_ws(" de ", F.dayofmonth(c).cast("string"), F.get(F.array(*[F.lit(m) for m in lexical.MONTHS]), F.month(c) - 1), F.year(c).cast("string"))
    numeric = F.concat(F.lit("Período: "), F.date_format("a", "dd/MM/yyyy"), F.lit(" a "), F.date_format("b", "dd/MM/yyyy"))
    written = F.concat(F.lit("PERÍODO: "), long_("a"), F.lit(" até "), long_("b"))
    text = F.when(F.col("o_custkey") % 5 == 0, F.concat(written, F.lit(" saldo 1,00"))).when(F.col("o_custkey") % 2 == 0, numeric).otherwise(F.concat(written, F.lit(" valores em R$")))
    p = lexical.period(text)
    return o.select("o_custkey", p["begin"].alias("period_begin"), p["end"].alias("period_end"), p["ambiguous"].alias("ambiguous"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN 'BRL' END AS code, c_nationkey % 3 = 2 AS conflict FROM customer GROUP BY 1, 2, 3")
def currency_scope(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_nationkey", "c_custkey")
    seen = F.when(F.col("c_nationkey") % 3 == 0, "brl").when((F.col("c_nationkey") % 3 == 2), F.when(F.col("c_custkey") % 2 == 0, "BRL").otherwise("USD")).otherwise("BRL")
    c = c.withColumn("code", lexical.currency(seen))
    declared = F.when(F.col("c_nationkey") % 3 == 2, lexical.currency(F.lit(" usd "), strict=False))
    g = c.groupBy("c_nationkey").agg(F.collect_set("code").alias("codes"))
    r = lexical.resolve_currency(F.array_union("codes", F.array_compact(F.array(declared, F.when(F.col("c_nationkey") % 3 == 2, F.lit("BRL"))))))
    return g.select(*big("c_nationkey"), r["code"].alias("code"), r["conflict"].alias("conflict"))


# Rows, kinds and segments


@query(M + "SELECT doc_id, doc_order AS row, key || ' ' || description AS text FROM m")
def row_reconstruct(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    y = F.lit(20.0) + F.col("doc_order") * render.LINE
    cells = m.select("doc_id", F.lit(1).alias("page"), F.explode(F.array(F.struct(y.alias("y"), F.lit(35.0).alias("x"), F.col("key").cast("string").alias("text")), F.struct((y + F.col("doc_order") % 4 - 1).alias("y"), F.lit(330.0).alias("x"), F.col("description").alias("text")))).alias("c")).select("doc_id", "page", "c.y", "c.x", "c.text")
    rows = geometry.reconstruct_rows(render.words_from_cells(cells))
    return rows.select("doc_id", *big("row"), "text")


@query(M + "SELECT doc_id, sum(k)::BIGINT AS regions FROM (SELECT doc_id, 2 AS k FROM m UNION ALL SELECT DISTINCT doc_id, 2 FROM m) GROUP BY 1")
def money_regions_per_row(spark, sf_dir):
    rows = read_rows(render.words_from_cells(render.statement_cells(render.movements(spark, sf_dir))))
    return rows.groupBy("doc_id").agg(F.sum(F.size("amounts")).alias("regions"))


@query(M + "SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'content' AS kind, count(*) AS n FROM m UNION ALL SELECT 'period', count(DISTINCT doc_id) FROM m UNION ALL SELECT 'balance_declaration', 2 * count(DISTINCT doc_id) FROM m) GROUP BY 1")
def row_kinds(spark, sf_dir):
    rows = read_rows(render.words_from_cells(render.statement_cells(render.movements(spark, sf_dir))))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query(M + "SELECT doc_id, doc_order, posting_date, description, amount FROM m")
def date_forward_fill(spark, sf_dir):
    rows = read_rows(render.words_from_cells(render.grouped_cells(render.movements(spark, sf_dir))))
    tx = statement.transactions(statement.segments(rows.where("in_area")), "grouped")
    return tx.select("doc_id", *big("doc_order"), "posting_date", "description", *dec("amount"))


@query(M + "SELECT doc_id, doc_order, description || ' REF ' || key || ' LOJA' AS description FROM m")
def segment_wrapped(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    y = F.lit(20.0) + F.col("doc_order") * 2 * render.LINE
    cell = lambda yy, x, t: F.struct(yy.alias("y"), F.lit(x).alias("x"), t.alias("text"))
    cells = m.select("doc_id", F.lit(1).alias("page"), F.explode(F.array(cell(y, 35.0, F.concat_ws(" ", F.date_format("posting_date", "dd/MM/yyyy"), "description")), cell(y, 330.0, lexical.statement_money(F.col("amount"))), cell(y + render.LINE, 101.0, F.concat(F.lit("REF "), F.col("key").cast("string"), F.lit(" LOJA"))))).alias("c")).select("doc_id", "page", "c.y", "c.x", "c.text")
    rows = statement.segments(read_rows(render.words_from_cells(cells)).where("in_area"), F.lit(101.0))
    d = statement.descriptions(rows)
    return d.select("doc_id", F.col("seg").cast("long").alias("doc_order"), "description")


FLOWS = M + "SELECT doc_id, posting_date, CASE WHEN amount >= 0 THEN 1 ELSE -1 END::BIGINT AS direction, count(*) AS members, sum(amount)::DECIMAL(18,2) AS total, true AS ok FROM m GROUP BY 1, 2, 3"


@query(FLOWS)
def direction_groups(spark, sf_dir):
    m = render.movements(spark, sf_dir).withColumn("sign", F.when(F.col("amount") >= 0, 1).otherwise(-1))
    groups = m.groupBy("doc_id", "posting_date", "sign").agg(F.sum("amount").cast(lexical.CENTS).alias("sub"))
    head = groups.select("doc_id", "posting_date", "sign", F.lit(0).alias("o"), F.lit(35.0).alias("x"), F.concat(F.date_format("posting_date", "dd/MM/yyyy"), F.when(F.col("sign") == 1, " Total de entradas").otherwise(" Total de saídas")).alias("a"), F.concat(F.when(F.col("sign") == 1, "+").otherwise("-"), lexical.statement_money(F.abs("sub"))).alias("b"))
    body = m.select("doc_id", "posting_date", "sign", F.col("doc_order").alias("o"), F.lit(35.0).alias("x"), F.col("description").alias("a"), lexical.statement_money(F.abs("amount")).alias("b"))
    lines = head.unionByName(body).withColumn("y", F.row_number().over(W.partitionBy("doc_id").orderBy("posting_date", F.desc("sign"), "o")) * render.LINE)
    cells = lines.select("doc_id", F.lit(1).alias("page"), "y", F.explode(F.array(F.struct("x", F.col("a").alias("text")), F.struct(F.lit(330.0).alias("x"), F.col("b").alias("text")))).alias("c")).select("doc_id", "page", F.col("y").cast("double").alias("y"), "c.x", "c.text")
    rows = statement.segments(read_rows(render.words_from_cells(cells)).where("in_area"))
    directed = statement.directions(statement.attribute_dates(rows, "grouped"))
    amount = F.get("amounts", 0)["money"]["amount"]
    members = directed.where("is_head").select("doc_id", F.col("group_position").alias("flow"), (amount * F.col("group_direction")).cast(lexical.CENTS).alias("amount"))
    flows = directed.where("kind = 'flow'").select("doc_id", F.col("position").alias("flow"), amount.alias("printed"), F.get("dates", 0)["value"].alias("posting_date"), F.col("flow").cast("long").alias("direction"))
    checked = checks.flow_subtotals(members, flows)
    return checked.select("doc_id", "posting_date", "direction", *big("members"), *dec("total"), "ok")


@query("SELECT c_custkey::BIGINT AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS matches, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal::DECIMAL(18,2) END AS amount FROM customer")
def label_value_binding(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").cast("long").alias("doc_id"), F.col("c_acctbal").cast(lexical.CENTS).alias("a"))
    cell = lambda y, x, t: F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), t.alias("text"))
    cells = c.select("doc_id", F.lit(1).alias("page"), F.explode(F.array_compact(F.array(cell(40.0, 100.0, F.lit("Saldo final")), cell(60.0, 100.0, lexical.statement_money(F.col("a"))), F.when(F.col("doc_id") % 3 == 0, cell(69.0, 100.0, lexical.statement_money(F.col("a")))), cell(140.0, 100.0, F.lit("R$ 7,00"))))).alias("c")).select("doc_id", "page", "c.y", "c.x", "c.text")
    rows = statement.classify(statement.tokens(geometry.reconstruct_rows(render.words_from_cells(cells))))
    return statement.labelled_values(rows).select("doc_id", *big("matches"), *dec("amount"))


@query(M + """, t AS (SELECT doc_id, doc_id % 4 AS k, count(*) AS n FROM m GROUP BY 1)
SELECT doc_id, CASE k WHEN 1 THEN 0 ELSE 2 END::BIGINT AS footer_rows, CASE k WHEN 2 THEN 'headers_differ' WHEN 3 THEN 'financial_footer' END AS refusal, CASE k WHEN 0 THEN n + 1 WHEN 1 THEN n + 8 END::BIGINT AS kept FROM t""")
def frame_strip(spark, sf_dir):
    """Three pages with a header and two contact lines each; by 4: 1 lacks a line on a page, 2 has another header on its last,
    3 has an amount beside the contact line, which the footer's height of other documents would hide."""
    m = render.movements(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(4))
    body = m.select("doc_id", (F.col("doc_order") % 3 + 1).alias("page"), (F.lit(60.0) + F.col("doc_order") * render.LINE).alias("y"), F.col("description").alias("text"))
    docs = m.select("doc_id").distinct().withColumn("page", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    line = lambda y, text: F.struct(F.lit(y).alias("y"), text.alias("text"))
    last = F.col("page") == 3
    lines = [line(20.0, F.when((k == 2) & last, "OUTRO MES").otherwise("EXTRATO MENSAL")), line(5000.0, F.when((k == 3) & last, "Fale conosco R$ 1,00").otherwise("Fale conosco")), F.when(~((k == 1) & last), line(5020.0, F.lit("SAC e Ouvidoria")))]
    frame = docs.select("doc_id", "page", F.explode(F.array_compact(F.array(*lines))).alias("c")).select("doc_id", "page", "c.y", "c.text")
    rows = geometry.reconstruct_rows(render.words_from_cells(body.unionByName(frame).withColumn("x", F.lit(35.0)))).select("doc_id", "page", "row", "text")
    found = frames.contact_footers(rows)
    # The header's height is declared, that of the footer observed; where a page differs it is taken as declared too.
    height = rows.join(found, "doc_id").withColumn("footer_rows", F.when(F.pmod("doc_id", F.lit(4)) == 3, 2).otherwise(F.col("footer_rows")))
    kept, refused = frames.strip_frames(height, F.col("footer_rows"), F.when(F.pmod("doc_id", F.lit(4)) == 1, 0).otherwise(1))
    left = kept.join(refused, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept"))
    return height.select("doc_id", F.col("footer_rows").cast("long").alias("footer_rows")).distinct().join(refused, "doc_id", "left").join(left, "doc_id", "left")


# Arithmetic


@query(M + "SELECT doc_id, coalesce(sum(amount) FILTER (amount >= 0), 0)::DECIMAL(18,2) AS credits, coalesce(sum(amount) FILTER (amount < 0), 0)::DECIMAL(18,2) AS debits FROM m GROUP BY 1")
def credit_debit_totals(spark, sf_dir):
    return checks.credit_debit(render.movements(spark, sf_dir)).select("doc_id", *dec("credits", "debits"))


@query(M + "SELECT doc_id, sum(amount)::DECIMAL(18,2) AS total, doc_id % 7 <> 0 AS reconciled FROM m GROUP BY 1")
def opening_closing(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    b = render.bounds(m).withColumn("closing", F.when(F.col("doc_id") % 7 == 0, F.col("closing") + 1).otherwise(F.col("closing")))
    return checks.opening_closing(m, b).select("doc_id", *dec("total"), "reconciled")


@query(M + """, k AS (SELECT doc_id, doc_order, CASE WHEN doc_id % 5 = 0 AND doc_order = 3 THEN 1 ELSE 0 END AS bad FROM m WHERE doc_order % 3 = 0)
SELECT d.doc_id, count(k.doc_id) AS links, coalesce(sum(CASE WHEN d.doc_id % 5 = 0 AND k.doc_order IN (3, 6) THEN 1 ELSE 0 END), 0)::BIGINT AS mismatches
FROM (SELECT DISTINCT doc_id FROM m) d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY 1""")
def running_chain(spark, sf_dir):
    m = checks.economic_order(render.movements(spark, sf_dir))
    wrong = (F.col("doc_id") % 5 == 0) & (F.col("doc_order") == 3)
    m2 = m.withColumn("balance_after", F.when(F.col("doc_order") % 3 == 0, F.when(wrong, F.col("balance_after") + 1).otherwise(F.col("balance_after"))))
    return checks.running_chain(m2.drop("opening"), render.bounds(m)).select("doc_id", *big("links", "mismatches"))


@query(M + """, n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1), p AS (SELECT doc_id, doc_order FROM m WHERE doc_order % 4 = 0)
SELECT n.doc_id, (1 + count(p.doc_order) FILTER (p.doc_order < n.n) - CASE WHEN n.doc_id % 3 = 0 AND n.n > 4 THEN 2 ELSE 0 END)::BIGINT AS links,
 (CASE WHEN n.doc_id % 3 = 0 AND n.n = 4 THEN 1 ELSE 0 END)::BIGINT AS conflicts, (CASE WHEN n.doc_id % 3 = 0 AND n.n > 4 THEN 2 ELSE 0 END)::BIGINT AS mismatches
FROM n LEFT JOIN p ON p.doc_id = n.doc_id GROUP BY n.doc_id, n.n""")
def checkpoint_links(spark, sf_dir):
    m = checks.economic_order(render.movements(spark, sf_dir))
    sparse = m.where("doc_order % 4 = 0").select("doc_id", F.col("doc_order").alias("after"), F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_order") == 4), F.col("balance_after") + 1).otherwise(F.col("balance_after")).cast(lexical.CENTS).alias("balance"), F.lit("sparse_checkpoint").alias("kind"))
    ends = checks.boundary_points(m.withColumn("balance_after", F.lit(None).cast(lexical.CENTS)), render.bounds(m))
    return checks.checkpoint_links(m, sparse.unionByName(ends)).select("doc_id", *big("links", "conflicts", "mismatches"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id::BIGINT AS doc_id, day, (sum(n) OVER (PARTITION BY user_id ORDER BY day))::BIGINT AS after, false AS absent FROM d
UNION ALL SELECT DISTINCT user_id::BIGINT, DATE '1900-01-01', NULL::BIGINT, true FROM events""")
def daily_balance(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "ts").select(F.col("user_id").cast("long").alias("doc_id"), F.col("ts").cast("date").alias("posting_date"))
    days = e.select("doc_id", F.col("posting_date").alias("day")).distinct().unionByName(e.select("doc_id", F.lit("1900-01-01").cast("date").alias("day")).distinct())
    return checks.daily_points(e, days).select("doc_id", "day", *big("after"), "absent")


@query("""SELECT user_id::BIGINT AS doc_id, ts::DATE AS day, arg_max(value, ts)::DECIMAL(18,2) AS last_value FROM events GROUP BY 1, 2""")
def daily_last_balance(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "ts", "value").select(F.col("user_id").cast("long").alias("doc_id"), F.col("ts").cast("date").alias("posting_date"), "ts", F.col("value").alias("balance_after"))
    return checks.daily_last(e, order="ts").select("doc_id", "day", *dec("last")).withColumnRenamed("last", "last_value")


@query(M + """, d AS (SELECT doc_id, posting_date AS day, row_number() OVER (PARTITION BY doc_id ORDER BY posting_date) AS k FROM m GROUP BY 1, 2)
SELECT doc_id, day, 'differs' AS problem FROM d WHERE k % 3 = 0 UNION ALL SELECT doc_id, DATE '2031-01-01', 'empty' FROM d GROUP BY 1""")
def daily_mismatches(spark, sf_dir):
    """Every third day's printed balance is a cent off, and a day is printed that has no movement."""
    m = render.movements(spark, sf_dir)
    days = checks.daily_last(m).withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("day")))
    printed = days.select("doc_id", "day", F.when(F.col("k") % 3 == 0, F.col("last") + F.lit("0.01").cast(lexical.CENTS)).otherwise(F.col("last")).alias("balance"))
    none = m.select("doc_id").distinct().select("doc_id", F.lit("2031-01-01").cast("date").alias("day"), F.lit(0).cast(lexical.CENTS).alias("balance"))
    return checks.daily_mismatches(m, printed.unionByName(none))


@query(M + """, s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN row_number() OVER w WHEN 1 THEN row_number() OVER v ELSE row_number() OVER u END AS o, posting_date
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY doc_order), v AS (PARTITION BY doc_id ORDER BY doc_order DESC), u AS (PARTITION BY doc_id ORDER BY key % 7, key)),
l AS (SELECT doc_id, posting_date, lag(posting_date) OVER (PARTITION BY doc_id ORDER BY o) AS p FROM s)
SELECT doc_id, coalesce(bool_and(posting_date >= p), true) AS ascending, coalesce(bool_and(posting_date <= p), true) AS descending FROM l GROUP BY 1""")
def chronology(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    part = W.partitionBy("doc_id")
    o = F.when(F.col("doc_id") % 3 == 0, F.col("doc_order")).when(F.col("doc_id") % 3 == 1, -F.col("doc_order")).otherwise(F.row_number().over(part.orderBy(F.col("key") % 7, "key")))
    return checks.chronology(m.withColumn("doc_order", o)).select("doc_id", "ascending", "descending")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_returnflag AS flow, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS total, count(*) AS members FROM lineitem GROUP BY 1, 2)
SELECT doc_id, flow, total, members, doc_id % 10 <> 0 AS ok FROM s""")
def flow_subtotals(spark, sf_dir):
    l_ = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_extendedprice").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("flow"), F.col("l_extendedprice").cast(lexical.CENTS).alias("amount"))
    printed = l_.groupBy("doc_id", "flow").agg(F.sum("amount").alias("p")).select("doc_id", "flow", F.when(F.col("doc_id") % 10 == 0, F.col("p") + 1).otherwise(F.col("p")).cast(lexical.CENTS).alias("printed"))
    return checks.flow_subtotals(l_, printed).select("doc_id", "flow", *dec("total"), *big("members"), "ok")


@query(M + """, x AS (SELECT doc_id, count(*) AS n, sum(amount) AS t FROM m GROUP BY 1)
SELECT doc_id, (CASE WHEN doc_id % 4 = 1 THEN 0 ELSE n END)::BIGINT AS running_links, CASE WHEN doc_id % 4 = 1 THEN 'not_available' ELSE 'verified' END AS running_verified,
 CASE WHEN doc_id % 4 IN (0, 1) THEN 'verified' ELSE 'not_available' END AS opening_closing,
 CASE WHEN doc_id % 4 IN (0, 1) THEN 'opening_closing' ELSE 'partial_running_chain' END AS reconciliation_level, true AS supported FROM x""")
def evidence_report(spark, sf_dir):
    m = checks.economic_order(render.movements(spark, sf_dir))
    b = render.bounds(m).withColumn("closing", F.when(F.col("doc_id") % 4 < 2, F.col("closing")))
    m = m.drop("opening").withColumn("balance_after", F.when(F.col("doc_id") % 4 != 1, F.col("balance_after")))
    return checks.evidence(m, b).select("doc_id", *big("running_links"), "running_verified", "opening_closing", "reconciliation_level", "supported")


@query(M + """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 1 THEN 'period_reversed' END, CASE WHEN doc_id % 6 = 2 OR (doc_id % 6 = 1) THEN 'date_outside_period' END,
 CASE WHEN doc_id % 6 = 3 THEN 'blank_description' END, CASE WHEN doc_id % 6 = 4 THEN 'amount_not_cents' END, CASE WHEN doc_id % 6 = 5 THEN 'balance_not_cents' END) AS violations FROM m GROUP BY 1""")
def domain_violations(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    kind = F.col("doc_id") % 6
    wide = "decimal(38,4)"
    tx = F.struct("posting_date", F.when((kind == 3) & (F.col("doc_order") == 1), " ").otherwise(F.col("description")).alias("description"), (F.col("amount").cast(wide) + F.when((kind == 4) & (F.col("doc_order") == 1), F.lit("0.0050").cast(wide)).otherwise(F.lit(0).cast(wide))).cast(wide).alias("amount"))
    s = m.groupBy("doc_id").agg(F.collect_list(tx).alias("txs"), F.min("posting_date").alias("a"), F.max("posting_date").alias("b"), F.first("opening").alias("o"), F.max_by("balance_after", "doc_order").alias("c"))
    s = s.select("doc_id", "txs", F.when(kind == 1, F.date_add("b", 1)).when(kind == 2, F.date_add("a", 1)).otherwise(F.col("a")).alias("period_begin"), F.when(kind == 2, F.date_add("b", 1)).otherwise(F.col("b")).alias("period_end"), (F.col("o").cast(wide) + F.when(kind == 5, F.lit("0.0001").cast(wide)).otherwise(F.lit(0).cast(wide))).alias("opening"), F.col("c").cast(wide).alias("closing"))
    return checks.violations(s).select("doc_id", F.array_join("violations", ",").alias("violations"))


# Ownership

S = """WITH s AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber::BIGINT AS row, (l_partkey % 20)::BIGINT AS word_start, (l_partkey % 20 + 1 + l_suppkey % 5)::BIGINT AS word_end, row_number() OVER () AS id FROM lineitem)
"""


def lineitem_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 20
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("long").alias("row"), start.cast("long").alias("word_start"), (start + 1 + F.col("l_suppkey") % 5).cast("long").alias("word_end"))


@query(S + """SELECT doc_id, row, count(*) AS n, count(*) FILTER (clash) AS clashes FROM (
 SELECT a.doc_id, a.row, EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.row = a.row AND b.id <> a.id AND b.word_start < a.word_end AND a.word_start < b.word_end) AS clash FROM s a) GROUP BY 1, 2""")
def span_overlaps(spark, sf_dir):
    return spans.overlapping(lineitem_spans(spark, sf_dir)).groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.count_if("clash").alias("clashes"))


@query(S + """, r AS (SELECT *, max(word_end) OVER (PARTITION BY doc_id, row ORDER BY word_start, word_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR word_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row ORDER BY word_start, word_end ROWS UNBOUNDED PRECEDING) AS i FROM r)
SELECT doc_id, row, min(word_start) AS word_start, max(word_end) AS word_end, count(*) AS spans FROM g GROUP BY doc_id, row, i""")
def span_islands(spark, sf_dir):
    return spans.islands(lineitem_spans(spark, sf_dir)).select("doc_id", "row", "word_start", "word_end", "spans")


@query("""SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS row, 'missing' AS gap FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 = 0 GROUP BY 1, 2
UNION ALL SELECT l_orderkey, l_linenumber + 100, 'foreign' FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 = 1 GROUP BY 1, 2""")
def coverage_gaps(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("row")).distinct()
    claimed = e.where((F.col("doc_id") + F.col("row")) % 5 != 0).unionByName(e.where((F.col("doc_id") + F.col("row")) % 7 == 1).select("doc_id", (F.col("row") + 100).alias("row")))
    return spans.coverage(e, claimed, ["doc_id", "row"])


CONTROLS = M + ", c AS (SELECT doc_id, doc_order AS control, doc_order - 1 AS b, doc_order AS e FROM m)"


@query(CONTROLS + """SELECT doc_id, control, ref, problem FROM (
 SELECT doc_id, control, CASE WHEN control % 5 = 0 THEN control + 1000 WHEN control % 5 = 1 AND control > 2 THEN control - 2 ELSE control - 1 END AS ref,
  CASE WHEN control % 5 = 0 THEN 'control_reference_missing' WHEN control % 5 = 1 AND control > 2 THEN 'control_reference_order' END AS problem FROM c WHERE control > 1) WHERE problem IS NOT NULL""")
def reference_integrity(spark, sf_dir):
    m = render.movements(spark, sf_dir).select("doc_id", F.col("doc_order").cast("long").alias("control"))
    ref = F.when(F.col("control") % 5 == 0, F.col("control") + 1000).when((F.col("control") % 5 == 1) & (F.col("control") > 2), F.col("control") - 2).otherwise(F.col("control") - 1)
    c = m.select("doc_id", "control", (F.col("control") - 1).alias("begin"), F.col("control").alias("end"), F.when(F.col("control") > 1, F.array(ref)).otherwise(F.array().cast("array<long>")).alias("refs"))
    return spans.references(c)


@query(M + """, i AS (SELECT doc_id, doc_order AS control, doc_order AS b, doc_order + 1 + key % 4 AS e FROM m)
SELECT a.doc_id, a.control, EXISTS (SELECT 1 FROM i x WHERE x.doc_id = a.doc_id AND x.b < a.b AND a.b < x.e AND x.e < a.e) AS crosses FROM i a""")
def subtotal_nesting(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    i = m.select("doc_id", F.col("doc_order").cast("long").alias("control"), F.col("doc_order").cast("long").alias("begin"), (F.col("doc_order") + 1 + F.col("key") % 4).cast("long").alias("end"))
    return spans.crossing(i).select("doc_id", "control", "crosses")


@query("SELECT o_custkey AS doc_id, count(DISTINCT o_orderkey % 5) AS independent FROM orders GROUP BY 1")
def independent_intervals(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    k = F.col("o_orderkey") % 5
    c = o.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(k, k + 10)).otherwise(F.array(k + 10, k)).alias("members"))
    return spans.independent_intervals(c)


# Search


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two unlabelled amounts; every third account prints the balance first, every seventh has a wrong one."""
    m = render.movements(spark, sf_dir)
    balance = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_order") == 1), F.col("balance_after") + 1).otherwise(F.col("balance_after")).cast(lexical.CENTS)
    swap = F.col("doc_id") % 3 == 0
    return m.select("doc_id", "doc_order", "posting_date", F.when(swap, balance).otherwise(F.col("amount")).alias("left_amount"), F.when(swap, F.col("amount")).otherwise(balance).alias("right_amount"))


ROLES = M + """, t AS (SELECT doc_id, doc_order, posting_date, opening, CASE WHEN doc_id % 7 = 0 AND doc_order = 1 THEN balance_after + 1 ELSE balance_after END AS bal, amount FROM m),
z AS (SELECT doc_id, opening, arg_max(balance_after, doc_order) AS closing FROM m GROUP BY 1, 2),
e AS (SELECT t.doc_id, s.swap, d.descending, doc_order, posting_date, z.opening, z.closing,
  CASE WHEN (s.swap = 0) = (t.doc_id % 3 <> 0) THEN amount ELSE bal END AS a, CASE WHEN (s.swap = 0) = (t.doc_id % 3 <> 0) THEN bal ELSE amount END AS b
  FROM t JOIN z USING (doc_id) CROSS JOIN (VALUES (0), (1)) s(swap) CROSS JOIN (VALUES (false), (true)) d(descending)),
w AS (SELECT *, lag(b) OVER o AS pb, lag(posting_date) OVER o AS pd, sum(a) OVER (PARTITION BY doc_id, swap, descending) AS total,
  last_value(b) OVER (PARTITION BY doc_id, swap, descending ORDER BY CASE WHEN descending THEN -doc_order ELSE doc_order END ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lb
  FROM e WINDOW o AS (PARTITION BY doc_id, swap, descending ORDER BY CASE WHEN descending THEN -doc_order ELSE doc_order END)),
f AS (SELECT doc_id, swap, descending, NOT bool_or(coalesce(pd > posting_date, false)) AS dates_ok, NOT bool_or(coalesce(pb, opening) + a <> b) AS chain_ok,
  bool_and(opening + total = closing AND lb = closing) AS closing_ok, string_agg(a || '/' || b, ';' ORDER BY doc_order) AS material FROM w GROUP BY 1, 2, 3)
"""


@query(ROLES + "SELECT doc_id, swap::BIGINT AS swap, descending, dates_ok, chain_ok, closing_ok FROM f")
def role_enumeration(spark, sf_dir):
    roles = search.enumerate_roles(two_columns(spark, sf_dir), render.bounds(render.movements(spark, sf_dir)))
    return roles.select("doc_id", *big("swap"), "descending", "dates_ok", "chain_ok", "closing_ok")


@query(ROLES + """, g AS (SELECT doc_id, count(DISTINCT CASE WHEN dates_ok AND chain_ok AND closing_ok THEN material END) AS survivors, bool_or(chain_ok AND closing_ok AND NOT dates_ok) AS d FROM f GROUP BY 1)
SELECT doc_id, survivors, CASE WHEN survivors > 1 THEN 'ambiguous' WHEN survivors = 1 THEN 'success' WHEN d THEN 'unsupported' ELSE 'invalid' END AS status FROM g""")
def search_verdict(spark, sf_dir):
    roles = search.enumerate_roles(two_columns(spark, sf_dir), render.bounds(render.movements(spark, sf_dir)))
    return search.search_verdict(roles).select("doc_id", *big("survivors"), "status")


@query(M + """, t AS (SELECT doc_id, count(*) AS n, count(DISTINCT posting_date) AS d, doc_id % 7 = 0 AS wrong FROM m GROUP BY 1),
v AS (SELECT *, CASE WHEN wrong THEN 3 ELSE 1 + 2 * n END + CASE WHEN d > 1 THEN 1 ELSE 3 END AS total, CASE WHEN wrong THEN 0 WHEN doc_id % 3 = 0 THEN (1 + 2 * n <= 16)::INT ELSE (1 + n <= 16)::INT END AS s FROM t)
SELECT doc_id, least(total, 16)::BIGINT AS visited, s::BIGINT AS survivors, total > 16 AS exhausted, CASE WHEN total > 16 THEN 'ambiguous' WHEN s = 1 THEN 'success' ELSE 'invalid' END AS status,
CASE WHEN total <= 16 THEN concat_ws(',', CASE WHEN d > 1 THEN 'chronology_dates:1' END, CASE WHEN NOT wrong AND n > 1 THEN 'column_role_continuity:' || (n - 1) END, 'running_balance:' || (CASE WHEN wrong THEN 2 ELSE 1 END + CASE WHEN d > 1 THEN 0 WHEN n = 1 AND NOT wrong THEN 1 ELSE 2 END)) END AS pruned FROM v""")
def search_budget(spark, sf_dir):
    """Sixteen states: of each order the root, of each row both columns, as far as the budget goes."""
    found = search.bounded_search(two_columns(spark, sf_dir), render.bounds(render.movements(spark, sf_dir)), max_states=16)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("pruned"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return search.bounded_status(found).select("doc_id", *big("visited", "survivors"), "exhausted", "status", F.when(~F.col("exhausted"), text).alias("pruned"))


@query(M + "SELECT doc_id, 0::BIGINT AS visited, true AS over_local, 'ambiguous' AS status FROM m GROUP BY 1")
def search_local_limit(spark, sf_dir):
    """Rows with three dates each have six alternatives, over the local limit of four: nothing is visited."""
    m = two_columns(spark, sf_dir)
    rows = m.withColumn("dates", F.array(F.col("posting_date"), F.date_add("posting_date", 1), F.date_add("posting_date", 2)))
    found = search.bounded_search(rows, render.bounds(render.movements(spark, sf_dir)), max_states=20)
    return search.bounded_status(found).select("doc_id", *big("visited"), "over_local", "status")


# Export

ID = "'[\"generic\",\"generic\",\"999\",\"' || doc_id || '\",\"' || posting_date || '\",\"' || description || '\",\"' || amount || '\"]'"


@query(M + f""", i AS (SELECT *, {ID} AS identity, row_number() OVER (PARTITION BY doc_id, posting_date, description, amount ORDER BY doc_order) AS occurrence FROM m)
SELECT doc_id, occurrence, sha256(identity || ':' || occurrence) AS fitid, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def fitid(spark, sf_dir):
    tx = export.transaction_ids(render.movements(spark, sf_dir), export.Profile("999", ""), F.col("doc_id"))
    return tx.groupBy("doc_id", F.col("occurrence").cast("long").alias("occurrence"), "fitid").agg(F.count("*").alias("n"))


@query(M + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY posting_date, description, amount) AS export_no, strftime(posting_date, '%Y%m%d') AS dtposted, amount::VARCHAR AS trnamt, CASE WHEN amount >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS trntype, description AS memo FROM m")
def export_rows(spark, sf_dir):
    tx = export.export_rows(render.movements(spark, sf_dir))
    return tx.select("doc_id", *big("export_no"), lexical.ofx_date(F.col("posting_date")).alias("dtposted"), lexical.ofx_money(F.col("amount")).alias("trnamt"), F.when(F.col("amount") >= 0, "CREDIT").otherwise("DEBIT").alias("trntype"), F.col("description").alias("memo"))


PAYLOAD = "'" + export.HEADER.replace("\n", "' || chr(10) || '") + """<OFX>' || chr(10) || '  <SIGNONMSGSRSV1>' || chr(10) || '    <SONRS>' || chr(10) || '      <STATUS>' || chr(10) || '        <CODE>0</CODE>' || chr(10) || '        <SEVERITY>INFO</SEVERITY>' || chr(10) || '      </STATUS>' || chr(10) || '      <DTSERVER>' || e || '</DTSERVER>' || chr(10)
|| '      <LANGUAGE>POR</LANGUAGE>' || chr(10) || '    </SONRS>' || chr(10) || '  </SIGNONMSGSRSV1>' || chr(10) || '  <BANKMSGSRSV1>' || chr(10) || '    <STMTTRNRS>' || chr(10) || '      <TRNUID>0</TRNUID>' || chr(10) || '      <STATUS>' || chr(10) || '        <CODE>0</CODE>' || chr(10)
|| '        <SEVERITY>INFO</SEVERITY>' || chr(10) || '      </STATUS>' || chr(10) || '      <STMTRS>' || chr(10) || '        <CURDEF>BRL</CURDEF>' || chr(10) || '        <BANKACCTFROM>' || chr(10) || '          <BANKID>999</BANKID>' || chr(10) || '          <ACCTID>1</ACCTID>' || chr(10)
|| '          <ACCTTYPE>CHECKING</ACCTTYPE>' || chr(10) || '        </BANKACCTFROM>' || chr(10) || '        <BANKTRANLIST>' || chr(10) || '          <DTSTART>' || b || '</DTSTART>' || chr(10) || '          <DTEND>' || e || '</DTEND>' || chr(10) || lines || chr(10) || '        </BANKTRANLIST>' || chr(10)
|| '        <LEDGERBAL>' || chr(10) || '          <BALAMT>' || closing || '</BALAMT>' || chr(10) || '          <DTASOF>' || e || '</DTASOF>' || chr(10) || '        </LEDGERBAL>' || chr(10) || '      </STMTRS>' || chr(10) || '    </STMTTRNRS>' || chr(10) || '  </BANKMSGSRSV1>' || chr(10) || '</OFX>' || chr(10)"""


@query(M + f""", i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY posting_date, description, amount) AS no, '["generic","generic","999","1","' || posting_date || '","' || description || ' \\u00e7 <&","' || amount || '"]' AS identity FROM m),
f AS (SELECT *, sha256(identity || ':' || row_number() OVER (PARTITION BY doc_id, identity)) AS fitid FROM i),
t AS (SELECT doc_id, count(*) AS n, strftime(min(posting_date), '%Y%m%d') AS b, strftime(max(posting_date), '%Y%m%d') AS e, arg_max(balance_after, doc_order) AS closing, string_agg('          <STMTTRN>' || chr(10) || '            <TRNTYPE>' || CASE WHEN amount >= 0 THEN 'CREDIT' ELSE 'DEBIT' END || '</TRNTYPE>' || chr(10) || '            <DTPOSTED>' || strftime(posting_date, '%Y%m%d') || '</DTPOSTED>' || chr(10)
 || '            <TRNAMT>' || amount || '</TRNAMT>' || chr(10) || '            <FITID>' || fitid || '</FITID>' || chr(10) || '            <MEMO>' || description || ' &#231; &lt;&amp;</MEMO>' || chr(10) || '          </STMTTRN>', chr(10) ORDER BY no) AS lines FROM f GROUP BY 1)
SELECT doc_id, n AS transactions, sha256({PAYLOAD}) AS payload_sha256 FROM t""")
def ofx_payload(spark, sf_dir):
    m = render.movements(spark, sf_dir).withColumn("description", F.concat("description", F.lit(" ç <&")))
    tx = export.export_rows(export.transaction_ids(m, export.Profile("999", "1")))
    texts = export.payload(tx, render.bounds(m).withColumn("currency", F.lit("BRL")), export.Profile("999", "1"))
    return texts.select("doc_id", F.size(F.regexp_extract_all("payload", F.lit("<FITID>"), F.lit(0))).cast("long").alias("transactions"), F.sha2("payload", 256).alias("payload_sha256"))


@query(M + """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not_approved' WHEN 1 THEN 'metadata_required' WHEN 2 THEN 'currency_unresolved' WHEN 3 THEN 'closing_balance_required' WHEN 4 THEN 'unsupported_text' ELSE 'ready' END AS readiness FROM m GROUP BY 1""")
def export_readiness(spark, sf_dir):
    k = F.col("doc_id") % 6
    s = render.bounds(render.movements(spark, sf_dir)).select(
        "doc_id", F.when(k == 0, "invalid").otherwise("success").alias("status"), F.when(k != 1, "1").alias("account"), F.when(k != 2, "BRL").alias("currency"), F.lit("BRL").alias("profile_currency"),
        F.when(k != 3, F.col("closing")).alias("closing"), F.array(F.when(k == 4, F.lit("A\x01")).otherwise(F.lit("PEDIDO"))).alias("texts"))
    return export.readiness(s).select("doc_id", "readiness")


# The whole way


STATUS = "CASE doc_id % 8 WHEN 0 THEN 'invalid' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unsupported' ELSE 'success' END"
VERDICTS = M + f", v AS (SELECT doc_id, {STATUS} AS status, CASE WHEN doc_id % 8 = 3 THEN 'monetary_token_incomplete' END AS capability, count(*) AS n, sum(amount)::DECIMAL(18,2) AS t FROM m GROUP BY 1, 2, 3)"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(render.words_from_cells(render.statement_cells(render.movements(spark, sf_dir), faults=True))).verdicts


@query(VERDICTS + "SELECT doc_id, status, capability, CASE WHEN capability IS NULL THEN n END AS n_tx, CASE WHEN capability IS NULL THEN t END AS total FROM v")
def statement_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", "status", "capability", *big("n_tx"), *dec("total"))


@query(M + "SELECT doc_id, count(*) AS movements, count(*) FILTER (amount > 0) AS credits, count(*) FILTER (amount < 0) AS debits FROM m GROUP BY 1")
def movement_summary(spark, sf_dir):
    return reports.movement_summary(render.movements(spark, sf_dir))


@query(M + """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'budget_exhausted' WHEN doc_id % 4 = 1 THEN 'material_ambiguity' WHEN doc_id % 4 = 2 THEN 'unsupported_structure' WHEN doc_id % 4 = 3 THEN 'contradiction' END AS diagnostic FROM m GROUP BY 1""")
def default_diagnostics(spark, sf_dir):
    k = F.col("doc_id") % 4
    d = render.movements(spark, sf_dir).select("doc_id").distinct()
    status = F.when(k == 1, "ambiguous").when(k == 2, "unsupported").when(k == 3, "invalid").otherwise("success")
    return d.select("doc_id", reports.default_diagnostic(status, F.col("doc_id") % 5 == 0).alias("diagnostic"))


# Corpus


@query("""SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents""")
def corpus_dedupe(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", corpus.content_hash(F.col("text")).alias("sha256"))
    return corpus.first_occurrence(d, line="doc_id").select("doc_id", "sha256", "duplicate_of")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with what a corpus report keeps of them."""
    v = verdicts(spark, sf_dir)
    ok = F.col("status") == "success"
    return v.select(
        "doc_id", "status", F.when(F.col("capability").isNotNull(), "monetary_inventory").alias("stage"), F.when(F.col("status") == "ambiguous", "insufficient_evidence").alias("diagnostic"),
        F.array_compact(F.array("capability")).alias("blockers"),
        F.array_compact(F.array(F.lit("observed:dates"), F.when(F.col("status") != "unsupported", "observed:money_regions"), F.when(ok, "verified:role:movement"), F.concat(F.lit("failure:"), "capability"))).alias("capabilities"),
    )


@query(VERDICTS + "SELECT s AS status, count(v.doc_id) AS documents FROM (VALUES ('success'), ('ambiguous'), ('unsupported'), ('invalid')) k(s) LEFT JOIN v ON v.status = k.s GROUP BY 1")
def status_totals(spark, sf_dir):
    return corpus.status_totals(verdicts(spark, sf_dir))


CODES = ", c AS (SELECT CASE status WHEN 'unsupported' THEN 'monetary_token_incomplete' WHEN 'ambiguous' THEN 'insufficient_evidence' ELSE status END AS code, CASE WHEN status = 'unsupported' THEN 'monetary_inventory' ELSE 'analysis' END AS stage FROM v WHERE status <> 'success')"


@query(VERDICTS + CODES + "SELECT code, count(*) AS documents, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM c GROUP BY 1")
def failure_clusters(spark, sf_dir):
    return corpus.ranked(corpus.failure_clusters(outcomes(spark, sf_dir)), "code").select("code", "documents", *big("rank"))


@query(VERDICTS + CODES + "SELECT stage || ' + ' || code AS combination, count(*) AS documents FROM c GROUP BY 1")
def stage_combinations(spark, sf_dir):
    return corpus.stage_combinations(outcomes(spark, sf_dir))


@query(VERDICTS + """, k AS (SELECT status, unnest(list_filter([ 'observed:dates', CASE WHEN status <> 'unsupported' THEN 'observed:money_regions' END, CASE WHEN status = 'success' THEN 'verified:role:movement' END, 'failure:' || capability], lambda x: x IS NOT NULL)) AS capability FROM v)
SELECT capability, count(*) AS documents, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS blocked FROM k GROUP BY 1""")
def capability_matrix(spark, sf_dir):
    return corpus.capability_matrix(outcomes(spark, sf_dir))


@query(VERDICTS + CODES + "SELECT code, documents, rank FROM (SELECT code, count(*) AS documents, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM c GROUP BY 1) WHERE rank <= 2")
def topk_constraints(spark, sf_dir):
    """The report's top two."""
    return corpus.ranked(corpus.failure_clusters(outcomes(spark, sf_dir)), "code", top=2).select("code", "documents", *big("rank"))


@query("SELECT event_id::BIGINT AS event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown_' || sha256(event_type) END AS code FROM events")
def technical_codes(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "event_type")
    return e.select(*big("event_id"), corpus.technical_code(F.col("event_type"), ("click", "view")).alias("code"))


@query("""SELECT c_custkey::BIGINT AS line, c_custkey % 6 IN (0, 5) AS valid, CASE WHEN c_custkey % 6 IN (0, 5) THEN c_name END AS corpus_id FROM customer""")
def manifest_lines(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name")
    name = F.concat(F.lit('"corpus_id":"'), "c_name", F.lit('"'))
    k = F.col("c_custkey") % 6
    extra = F.when(k == 1, ',"other":1').when(k == 2, ',"schema_version":"1"').when(k == 3, F.concat(F.lit(","), name)).when(k == 4, ',"notes":5').when(k == 5, ',"schema_version":1,"sha256":null').otherwise("")
    lines = c.select(F.col("c_custkey").cast("long").alias("line"), F.concat(F.lit("{"), name, extra, F.lit("}")).alias("raw"))
    return files.parse_manifest(lines).select("line", "valid", "corpus_id")
