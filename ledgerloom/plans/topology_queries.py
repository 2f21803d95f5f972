"""Queries of the coverage ledger, control topology and structural roles, with SQL over the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import checks, controls, geometry, ledger, roles, spans, statement
from ledgerloom.plans.queries import M, load, query
from ledgerloom.sources import render


def _span(row, start, end):
    return [F.lit(1).alias("page"), row.alias("row"), F.lit(start).alias("word_start"), F.lit(end).alias("word_end")]


@query("""SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 3 END::BIGINT AS word_start, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END::BIGINT AS word_end FROM orders""")
def text_spans(spark, sf_dir):
    """The first word by its middle characters, the second and third across their gap, and the gap alone."""
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    text = F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit("bcde \t fgh ij"))
    k = F.col("o_orderkey") % 3
    s = ledger.text_span(text, F.when(k == 0, 3).when(k == 1, 11).otherwise(7), F.when(k == 0, 5).when(k == 1, 15).otherwise(10))
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), s["word_start"].cast("long").alias("word_start"), s["word_end"].cast("long").alias("word_end"))


@query("SELECT o_orderkey::BIGINT AS doc_id, o_orderkey % 4 = 3 AS missing, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus || ' ' || substr(o_orderpriority, 1, 1) END AS text FROM orders")
def source_tokens(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = o.select(F.col("o_orderkey").cast("long").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("row"), F.array(F.lit("x"), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tokens"))
    found = rows.select("doc_id", "page", "row", F.lit(1).alias("word_start"), F.when(F.col("doc_id") % 4 == 3, 4).otherwise(3).alias("word_end"))
    return ledger.source_tokens(found, rows).select("doc_id", "missing", F.array_join("tokens", " ").alias("text"))


@query(M + """SELECT DISTINCT doc_id, CASE doc_id % 13 WHEN 0 THEN 'region_repeated' WHEN 1 THEN 'region_overlap' WHEN 2 THEN 'claim_foreign' WHEN 3 THEN 'claim_repeated' WHEN 4 THEN 'claim_owner' WHEN 5 THEN 'region_unclaimed'
  WHEN 6 THEN 'movement_mismatch' WHEN 7 THEN 'balance_mismatch' WHEN 8 THEN 'field_missing' WHEN 9 THEN 'field_owner' WHEN 10 THEN 'field_overlap' WHEN 11 THEN 'field_outside' END AS problem FROM m""")
def coverage_ledger(spark, sf_dir):
    """Each account's rows own a movement and a balance; by its id one rule is broken at its first movement."""
    m = render.movements(spark, sf_dir).select("doc_id", "doc_order")
    fault = lambda k: (F.pmod("doc_id", F.lit(13)) == k) & (F.col("doc_order") == 1)
    row, tx = F.col("doc_order"), F.col("doc_order")
    spans = lambda where, s, e, *more: m.where(where).select("doc_id", *_span(row, s, e), *more)
    claim = lambda where, s, e, role, t=tx: spans(where, s, e, F.lit(role).alias("role"), t.alias("tx"))
    field = lambda where, s, e, name: spans(where, s, e, F.lit(name).alias("field"), tx.alias("tx"))
    yes = F.lit(True)
    expected = spans(yes, 3, 4).unionByName(spans(yes, 4, 5)).unionByName(spans(fault(0), 3, 4)).unionByName(spans(fault(1), 4, 6))
    claims = claim(~fault(5) & ~fault(6), 3, 4, "movement").unionByName(claim(~fault(7), 4, 5, "running_balance")).unionByName(claim(fault(2), 7, 8, "daily_balance", F.lit(None).cast("int")))
    claims = claims.unionByName(claim(fault(3), 3, 4, "daily_balance", F.lit(None).cast("int"))).unionByName(claim(fault(1), 4, 6, "daily_balance", F.lit(None).cast("int")))
    claims = claims.unionByName(claim(fault(6), 3, 4, "subtotal", F.lit(None).cast("int"))).unionByName(claim(fault(7), 4, 5, "closing_balance", F.lit(None).cast("int")))
    claims = claims.withColumn("tx", F.when((F.pmod("doc_id", F.lit(13)) == 4) & (F.col("row") == 1) & (F.col("role") == "movement"), F.lit(None)).otherwise(F.col("tx")))
    fields = field(yes, 0, 1, "date").unionByName(field(~fault(10), 1, 3, "description")).unionByName(field(fault(10), 1, 4, "description")).unionByName(field(~fault(9), 3, 4, "amount")).unionByName(field(fault(9), 4, 5, "amount"))
    fields = fields.unionByName(field(yes, 4, 5, "balance")).unionByName(field(~fault(8), 3, 4, "direction")).unionByName(field(~fault(11), 0, 5, "evidence")).unionByName(field(fault(11), 1, 5, "evidence"))
    moves = m.select("doc_id", tx.alias("tx"), F.lit(True).alias("has_balance"))
    return ledger.verified(m.select("doc_id").distinct(), ledger.problems(expected, claims, moves, fields))


@query("""SELECT o_orderkey::BIGINT AS doc_id, o_orderkey % 2 = 0 AS owned, '0/1-2 0/3-4 1/0-1' AS ordered FROM orders""")
def role_lookup(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").cast("long").alias("doc_id"))
    span = lambda r, s, e: F.struct(F.lit(1).alias("page"), F.lit(r).alias("row"), F.lit(s).alias("word_start"), F.lit(e).alias("word_end"))
    found = o.select("doc_id", *_span(F.lit(0), 3, 4), ledger.canonical(F.array(span(1, 0, 1), span(0, 3, 4), span(0, 1, 2), span(0, 3, 4))).alias("all"))
    claims = found.select(*ledger.SPAN, F.when(F.col("doc_id") % 2 == 0, "closing_balance").otherwise("movement").alias("role"))
    text = F.array_join(F.transform("all", lambda s: F.format_string("%d/%d-%d", s["row"], s["word_start"], s["word_end"])), " ")
    return ledger.has_role(found, claims, "closing_balance").select("doc_id", "owned", text.alias("ordered"))


def _points(m):
    """Control 0 opens an account, each third movement's balance is printed, and the last closes it."""
    n = m.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    own = F.array(F.struct(F.lit(0).cast("long").alias("control"), F.lit("opening_balance").alias("role"), F.lit(0).alias("after")), F.struct((F.col("n") + 1000).cast("long").alias("control"), F.lit("closing_balance").alias("role"), F.col("n").alias("after")))
    ends = n.where("doc_id % 5 <> 0").select("doc_id", F.explode(own).alias("p")).select("doc_id", "p.*")
    return ends.unionByName(m.where("doc_order % 3 = 0").select("doc_id", F.col("doc_order").cast("long").alias("control"), F.lit("sparse_checkpoint").alias("role"), F.col("doc_order").cast("int").alias("after")))


@query(M + """, n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT doc_id, doc_order AS control, 'sparse_checkpoint' AS role, CASE WHEN doc_order > 3 OR doc_id % 5 <> 0 THEN doc_order - 3 ELSE doc_order END AS b, doc_order AS e, CASE WHEN doc_order > 3 OR doc_id % 5 <> 0 THEN (doc_order - 3)::VARCHAR ELSE '' END AS refs FROM m WHERE doc_order % 3 = 0
  UNION ALL SELECT doc_id, 0, 'opening_balance', 0, 0, '' FROM n WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, n + 1000, 'closing_balance', 0, n, '0' FROM n WHERE doc_id % 5 <> 0)
SELECT doc_id, control::BIGINT AS control, role, b::BIGINT AS begin, e::BIGINT AS "end", refs FROM s""")
def control_intervals(spark, sf_dir):
    c = controls.balance_intervals(_points(render.movements(spark, sf_dir)))
    return c.select("doc_id", "control", "role", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query(M + """, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (amount >= 0) AS c, count(*) FILTER (amount < 0) AS d FROM m GROUP BY 1),
k AS (SELECT *, CASE WHEN n < 4 THEN 9 ELSE doc_id % 9 END AS k FROM n)
SELECT doc_id, CASE k WHEN 0 THEN 'control_source_reused' WHEN 1 THEN 'control_interval_domain' WHEN 2 THEN 'circular_financial_control' WHEN 3 THEN 'control_reference_missing' WHEN 4 THEN 'subtotal_interval_overlap' WHEN 5 THEN 'control_reference_order' WHEN 6 THEN 'control_scope_or_membership' END AS problem, c::BIGINT AS credits, d::BIGINT AS debits FROM k""")
def control_topology(spark, sf_dir):
    """Opening, closing and totals of each account; by its id a fault is added to accounts of four movements or more."""
    m = render.movements(spark, sf_dir)
    n = m.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    moves = m.select("doc_id", (F.col("doc_order") - 1).alias("index"), (F.lit(10**6) + F.col("doc_order")).cast("long").alias("source"), F.lit("main").alias("scope"), "amount")
    totals = controls.total_intervals(n.select("doc_id", F.explode(F.array(F.struct(F.lit(2001).cast("long").alias("control"), F.lit("credit_total").alias("role")), F.struct(F.lit(2002).cast("long").alias("control"), F.lit("debit_total").alias("role")))).alias("t")).select("doc_id", "t.*"), moves)
    ends = controls.balance_intervals(_points(m).where("role <> 'sparse_checkpoint'"))
    shape = lambda control, role, begin, end, *refs: F.struct(F.lit(control).cast("long").alias("control"), F.lit(role).alias("role"), F.lit(begin).alias("begin"), end.cast("int").alias("end"), F.array(*[F.lit(r).cast("long") for r in refs]).cast("array<bigint>").alias("refs"))
    k = F.when(F.col("n") < 4, 9).otherwise(F.pmod("doc_id", F.lit(9)))
    faulty = n.withColumn("k", k).withColumn("c", F.when(k == 0, F.array(shape(2001, "subtotal", 0, F.lit(1)))).when(k == 1, F.array(shape(3001, "running_balance", 0, F.lit(0)))).when(k == 2, F.array(shape(3002, "sparse_checkpoint", 1, F.lit(2), 3002)))
        .when(k == 3, F.array(shape(3003, "sparse_checkpoint", 1, F.lit(2), 7777))).when(k == 4, F.array(shape(3004, "subtotal", 0, F.lit(2)), shape(3005, "subtotal", 1, F.lit(3)))).when(k == 5, F.array(shape(3006, "sparse_checkpoint", 2, F.lit(3), 2001)))
        .when(k == 6, F.array(shape(3007, "sparse_checkpoint", 0, F.lit(1)))))
    added = faulty.where("c is not null").select("doc_id", "k", F.explode("c").alias("c")).select("doc_id", F.when(F.col("k") == 6, "other").otherwise("main").alias("scope"), "c.*")
    plain = totals.drop("members").unionByName(ends).withColumn("scope", F.lit("main"))
    verdict = controls.topology(plain.unionByName(added), moves.drop("amount"))
    sizes = totals.groupBy("doc_id").agg(F.max(F.when(F.col("role") == "credit_total", F.size("members"))).cast("long").alias("credits"), F.max(F.when(F.col("role") == "debit_total", F.size("members"))).cast("long").alias("debits"))
    return verdict.join(sizes, "doc_id").select("doc_id", "problem", "credits", "debits")


@query(M + """, d AS (SELECT doc_id, posting_date, count(*) AS n, min(doc_order) AS o, dense_rank() OVER (PARTITION BY doc_id ORDER BY posting_date) AS k FROM m GROUP BY 1, 2)
SELECT doc_id, count(*) FILTER (k % 4 = 0) AS empty, (count(*) FILTER (k % 4 <> 0))::BIGINT AS daily, (count(*) FILTER (k % 4 = 3))::BIGINT AS flows, coalesce(sum(n) FILTER (k % 4 = 3), 0)::BIGINT AS members FROM d GROUP BY 1""")
def control_evidence(spark, sf_dir):
    """Each fourth day of an account is a bare heading, each third of four a day with a flow; other days print a balance."""
    m = render.movements(spark, sf_dir)
    from pyspark.sql import Window as W

    k = F.dense_rank().over(W.partitionBy("doc_id").orderBy("posting_date"))
    m = m.withColumn("k", k)
    money = "array<struct<start:int,end:int>>"
    one, no = F.array(F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"))).cast(money), F.array().cast(money)
    days = m.groupBy("doc_id", "posting_date", "k").agg(F.min("doc_order").alias("o"))
    heads = days.select("doc_id", (F.col("o") * 3 - 2).alias("position"), F.lit("date_heading").alias("kind"), F.lit(False).alias("is_head"), F.when(F.col("k") % 4 == 0, no).otherwise(one).alias("amounts"))
    flows = days.where("k % 4 = 3").select("doc_id", (F.col("o") * 3 - 1).alias("position"), F.lit("flow").alias("kind"), F.lit(False).alias("is_head"), one.alias("amounts"))
    body = m.where("k % 4 <> 0").select("doc_id", (F.col("doc_order") * 3).alias("position"), F.lit("content").alias("kind"), F.lit(True).alias("is_head"), one.alias("amounts"))
    rows = heads.unionByName(flows).unionByName(body)
    e = controls.control_evidence(rows).where("admitted").groupBy("doc_id").agg(F.count_if(F.col("role") == "daily_balance").alias("daily"), F.count_if(F.col("role") == "subtotal").alias("flows"), F.coalesce(F.sum(F.when(F.col("role") == "subtotal", F.col("members"))), F.lit(0)).alias("members"))
    gaps = controls.empty_headings(rows).groupBy("doc_id").agg(F.count("*").alias("empty"))
    return m.select("doc_id").distinct().join(gaps, "doc_id", "left").join(e, "doc_id", "left").na.fill(0).select("doc_id", "empty", "daily", "flows", "members")


@query("""SELECT c_custkey::BIGINT AS doc_id, CASE c_custkey % 9 WHEN 3 THEN 'no_structural_owner' WHEN 4 THEN 'unsupported_transaction_geometry' WHEN 5 THEN 'conflicting_structural_evidence' WHEN 6 THEN 'role_evidence_insufficient' WHEN 7 THEN 'unsupported_control_structure' WHEN 8 THEN 'no_structural_owner' END AS refusal,
CASE c_custkey % 9 WHEN 0 THEN 'closing_balance,opening_balance' WHEN 1 THEN 'closing_balance,opening_balance' WHEN 2 THEN 'sparse_checkpoint' ELSE '' END AS roles, CASE c_custkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 END::BIGINT AS cut, CASE c_custkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END::BIGINT AS "column" FROM customer""")
def relational_roles(spark, sf_dir):
    """Three movements in two columns and one cell: above, below, at a date group within; and each way to be refused."""
    c = load(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").cast("long").alias("doc_id"), F.pmod("c_custkey", F.lit(9)).alias("k"))
    k = F.col("k")
    y = lambda position: position * 10.0
    pair = F.when(k == 4, F.array(F.struct(F.lit(300.0).alias("x0"), F.lit(360.0).alias("x1")), F.struct(F.lit(355.0).alias("x0"), F.lit(420.0).alias("x1")))).when(k == 8, F.array(F.struct(F.lit(300.0).alias("x0"), F.lit(360.0).alias("x1")))).otherwise(F.array(F.struct(F.lit(300.0).alias("x0"), F.lit(360.0).alias("x1")), F.struct(F.lit(400.0).alias("x0"), F.lit(460.0).alias("x1"))))
    places = F.when(k == 3, F.array(F.lit(5))).otherwise(F.array(F.lit(5), F.lit(10), F.lit(15)))
    seg = c.select("doc_id", pair.alias("amounts"), F.explode(places).alias("position")).select("doc_id", (F.col("position") / 5).cast("int").alias("seg"), "position", F.col("position").alias("last"), F.lit(1).alias("page"), y(F.col("position")).alias("top"), (y(F.col("position")) + 8).alias("bottom"), F.lit(1).alias("last_page"), y(F.col("position")).alias("last_top"), (y(F.col("position")) + 8).alias("last_bottom"), "amounts")
    at = F.when(k == 0, 3).when(k == 1, 17).when(k == 2, 13).when(k == 7, 13).otherwise(3)
    x0 = F.when(k == 2, 300.0).when(k == 5, 300.0).when(k == 6, 200.0).otherwise(401.0)
    x1 = F.when(k == 2, 350.0).when(k == 5, 460.0).when(k == 6, 250.0).otherwise(470.0)
    cells = c.select("doc_id", at.alias("position"), F.lit(1).alias("page"), y(at).alias("top"), (y(at) + 8).alias("bottom"), x0.alias("x0"), x1.alias("x1"))
    heads = c.where("k = 2").select("doc_id", F.lit(12).alias("position"))
    r = roles.relational_roles(cells, seg, heads)
    return r.select("doc_id", "refusal", F.array_join("roles", ",").alias("roles"), F.col("cut").cast("long").alias("cut"), F.col("column").cast("long").alias("column"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'closing_balance,opening_balance' WHEN 1 THEN 'opening_balance' WHEN 2 THEN 'closing_balance' ELSE '' END AS roles FROM nation")
def boundary_roles(spark, sf_dir):
    n = load(spark, sf_dir, "nation", "n_nationkey")
    text = F.element_at(F.array(F.lit("SALDO:"), F.lit("Saldo Anterior"), F.lit("saldo final:"), F.lit("Saldo bloqueado")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.array_join(roles.boundary_roles(text), ",").alias("roles"))


@query(M + "SELECT doc_id, (2 * count(*) + 2)::BIGINT AS amounts, (2 * count(*))::BIGINT AS in_rows FROM m GROUP BY 1")
def money_observations(spark, sf_dir):
    rows = statement.tokens(geometry.reconstruct_rows(render.words_from_cells(render.statement_cells(render.movements(spark, sf_dir)))))
    return roles.observe_money(rows).groupBy("doc_id").agg(F.count("*").alias("amounts"), F.count_if(F.col("row") > 3).alias("in_rows"))


@query(M + "SELECT doc_id, doc_order, CASE WHEN doc_order % 3 = 2 THEN '2031-01-02' ELSE posting_date || ',2031-01-02' END AS dates FROM m WHERE doc_order > 1")
def date_alternatives(spark, sf_dir):
    """Rows after an account's first, which is a heading; every third has no date of its own."""
    m = render.movements(spark, sf_dir)
    dates = "array<struct<start:int,end:int,value:date>>"
    one = lambda v: F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), v.alias("value"))).cast(dates)
    first = F.col("doc_order") == 1
    own = F.when(first, one(F.lit("2031-01-02").cast("date"))).when(F.col("doc_order") % 3 == 2, F.array().cast(dates)).otherwise(one(F.col("posting_date")))
    rows = m.select("doc_id", F.col("doc_order").alias("position"), F.when(first, "date_heading").otherwise("content").alias("kind"), (~first).alias("is_head"), own.alias("dates"))
    found = F.array_sort(F.collect_list(F.struct("n", F.col("date").cast("string").alias("d"))))
    return statement.date_alternatives(rows).groupBy("doc_id", F.col("position").cast("long").alias("doc_order")).agg(F.array_join(F.transform(found, lambda x: x["d"]), ",").alias("dates"))


@query("SELECT o_orderkey::BIGINT AS doc_id, o_orderkey % 4 IN (0, 1) AS inside FROM orders")
def contained_fields(spark, sf_dir):
    """A field in its row's evidence: within it, equal to it, across its end, on another row."""
    o = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").cast("long").alias("doc_id"), F.col("o_orderkey").alias("k"))
    k = F.col("k") % 4
    inner = o.select("doc_id", F.lit(1).alias("page"), F.when(k == 3, 2).otherwise(1).alias("row"), F.when(k == 1, 1).otherwise(2).alias("word_start"), F.when(k == 0, 4).when(k == 1, 6).when(k == 2, 7).otherwise(4).alias("word_end"))
    outer = o.select("doc_id", *_span(F.lit(1), 1, 6)).unionByName(o.select("doc_id", *_span(F.lit(1), 1, 3)))
    return spans.contained(inner, outer).select("doc_id", "inside")


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderkey % 5 IN (0, 1) AS financial, o_orderkey % 5 IN (2, 4) AS dated, o_orderkey % 5 = 4 AS stamp FROM orders")
def row_signals(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    text = F.element_at(F.array(F.lit("preço $ alto"), F.lit("12,3 sem símbolo"), F.lit("em 1 de maio de 2027"), F.lit("1.234 e 5"), F.lit("Extrato gerado em 01/02/2027")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), lexical.has_financial_signal(text).alias("financial"), lexical.has_date(text).alias("dated"), lexical.is_stamp(text).alias("stamp"))


@query(M + """, s AS (SELECT doc_id, doc_order, amount, sum(abs(amount)) OVER (PARTITION BY doc_id ORDER BY doc_order)::DECIMAL(18,2) AS run, sum(abs(amount)) OVER (PARTITION BY doc_id)::DECIMAL(18,2) AS total FROM m)
SELECT doc_id, count(*) FILTER (run <= CASE WHEN doc_id % 2 = 0 THEN total ELSE total / 2 END) AS within FROM s GROUP BY 1""")
def partial_subtotals(spark, sf_dir):
    """Magnitudes of an account under one printed subtotal: all of them, or half."""
    from pyspark.sql import Window as W

    m = render.movements(spark, sf_dir).withColumn("amount", F.abs("amount").cast(lexical.CENTS))
    total = F.sum("amount").over(W.partitionBy("doc_id"))
    members = m.select("doc_id", F.lit(1).alias("flow"), F.col("doc_order").alias("idx"), "amount", F.when(F.col("doc_id") % 2 == 0, total).otherwise(total / 2).alias("printed"))
    return checks.subtotal_bounds(members).groupBy("doc_id").agg(F.count_if("within").alias("within"))
