"""Queries of fingerprints, reports, record comparison and scopes, with SQL over the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import checks, corpus, fingerprint, frames, geometry, reports, statement
from ledgerloom.plans.queries import M, load, query
from ledgerloom.plans.statements import read_rows
from ledgerloom.sources import files, render

_CASES = [
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","page_count":2,"approved_role_counts":{"movement":3},"observation_errors":[]}}',
    '{"schema_version":1,"input_error":"file_missing","duplicate_of":4}',
    '{"schema_version":1,"input_error":"file_missing","duplicate_of":0}',
    '{"schema_version":"1","sha256":"%s","fingerprint":{"analysis_status":"success"}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","page_count":-1}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","budget_exhausted":0}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","currency_observations":["brl"]}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","pruned_constraints":{"x":"1"}}}',
    '{"schema_version":1,"sha256":"%s","extra":[1],"fingerprint":{"analysis_status":"invalid","diagnostic":null,"chronology_candidates":null,"currency_observations":["BRL"],"blocking_capabilities":["a","b"]}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"page_count":2}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"success","analysis_status":"success"}}',
    '{"schema_version":1,"sha256":"%s","fingerprint":{"analysis_status":"unsupported","date_mode_candidate":"grouped","pruned_constraints":{"x":1,"y":2}}}',
]


@query("""SELECT c_custkey::BIGINT AS line, c_custkey % 12 IN (0, 1, 8, 11) AS valid, CASE c_custkey % 12 WHEN 0 THEN 'success' WHEN 8 THEN 'invalid' WHEN 11 THEN 'unsupported' END AS status, CASE c_custkey % 12 WHEN 1 THEN 'file_missing' END AS input_error,
CASE c_custkey % 12 WHEN 1 THEN 4 END::BIGINT AS duplicate_of, CASE c_custkey % 12 WHEN 8 THEN 'a,b' ELSE '' END AS blockers, CASE WHEN c_custkey % 12 IN (0, 8, 11) THEN sha256(c_name) END AS sha256 FROM customer""")
def report_records(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name")
    case = F.element_at(F.array(*[F.lit(x) for x in _CASES]), (F.col("c_custkey") % len(_CASES) + 1).cast("int"))
    lines = c.select(F.col("c_custkey").cast("long").alias("line"), F.replace(case, F.lit("%s"), F.sha2("c_name", 256)).alias("raw"))
    r = files.parse_report(lines)
    return r.select("line", "valid", "status", "input_error", "duplicate_of", F.coalesce(F.array_join("blockers", ","), F.lit("")).alias("blockers"), "sha256")


@query(M + "SELECT doc_id, 1::BIGINT AS page_count, (count(*) + 3)::BIGINT AS row_count, (2 * count(*) + 2)::BIGINT AS money_region_count, (count(*) + 2)::BIGINT AS date_candidate_count, 'BRL' AS currencies, true AS opening_balance_observed, true AS closing_balance_observed FROM m GROUP BY 1")
def lexical_counts(spark, sf_dir):
    rows = statement.tokens(geometry.reconstruct_rows(render.words_from_cells(render.statement_cells(render.movements(spark, sf_dir)))))
    return fingerprint.lexical_counts(rows).withColumn("currencies", F.array_join("currency_observations", ",")).drop("currency_observations")


@query(M + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'per_transaction' ELSE 'grouped' END AS date_mode, 'signed' AS amount_mode, CASE WHEN doc_id % 2 = 0 THEN 'running_balance' ELSE 'absent' END AS balance_mode, NULL::DOUBLE AS transaction_left FROM m GROUP BY 1")
def geometry_profile(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    cells = render.statement_cells(m.where("doc_id % 2 = 0")).unionByName(render.grouped_cells(m.where("doc_id % 2 = 1")))
    return fingerprint.geometry_profile(read_rows(render.words_from_cells(cells)))


@query("""WITH e AS (SELECT o_custkey::BIGINT AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'running_balance' WHEN 'O' THEN 'closing' ELSE 'dates' END AS code, o_orderkey % 3 AS n FROM orders),
c AS (SELECT doc_id, code, count(*) AS k, sum(n)::BIGINT AS s FROM e GROUP BY 1, 2)
SELECT doc_id, string_agg(code || ':' || k, ',' ORDER BY code) AS causes, string_agg(code || ':' || s, ',' ORDER BY code) AS constraints FROM c GROUP BY 1""")
def constraint_counters(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    e = o.select(F.col("o_custkey").cast("long").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "running_balance").when(F.col("o_orderstatus") == "O", "closing").otherwise("dates").alias("code"), (F.col("o_orderkey") % 3).alias("n"))
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    both = fingerprint.counters(e, "code", "causes").join(fingerprint.counters(e, "code", "constraints", "n"), "doc_id")
    return both.select("doc_id", text("causes").alias("causes"), text("constraints").alias("constraints"))


def _prints(spark, sf_dir):
    """Fingerprints of accounts: of three, one succeeds, one is ambiguous, one lacks a capability."""
    m = render.movements(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(3))
    a = m.groupBy("doc_id").agg(F.count("*").alias("transaction_count_if_approved"), F.count("*").alias("row_count")).withColumns({
        "analysis_status": F.when(k == 0, "success").when(k == 1, "ambiguous").otherwise("unsupported"), "failure_stage": F.when(k == 1, "search"), "diagnostic": F.when(k == 1, "material_ambiguity").when(k == 2, "unsupported_structure"),
        "blocking_capabilities": F.when(k == 2, F.array(F.lit("date_attribution"), F.lit("amount_roles"), F.lit("amount_roles"))), "approved_chronology": F.lit("ascending"), "reconciliation_level": F.lit("complete"),
        "candidate_hypotheses": F.when(k == 1, 2).otherwise(1),
    })
    roles = fingerprint.counters(m.withColumn("role", F.lit("movement")), "role", "approved_role_counts")
    cuts = fingerprint.counters(m.where("doc_id % 3 = 1").withColumn("code", F.when(F.col("amount") > 0, "closing").otherwise("balance")), "code", "pruned_constraints")
    return fingerprint.project(a, roles, cuts)


@query(M + """, t AS (SELECT doc_id, doc_id % 3 AS k, count(*) AS n, count(*) FILTER (amount > 0) AS c, count(*) FILTER (amount <= 0) AS d FROM m GROUP BY 1),
j AS (SELECT *, '{"amount_mode_candidate":null,"analysis_status":"' || CASE k WHEN 0 THEN 'success' WHEN 1 THEN 'ambiguous' ELSE 'unsupported' END || '","approved_chronology":' || CASE k WHEN 0 THEN '"ascending"' ELSE 'null' END
 || ',"approved_role_counts":' || CASE k WHEN 0 THEN '{"movement":' || n || '}' ELSE '{}' END || ',"balance_mode_candidate":null,"blocking_capabilities":' || CASE k WHEN 2 THEN '["amount_roles","date_attribution"]' ELSE '[]' END
 || ',"budget_exhausted":false,"candidate_hypotheses":' || CASE k WHEN 1 THEN 2 ELSE 1 END || ',"chronology_candidates":null,"closing_balance_observed":null,"currency_observations":[],"date_candidate_count":null,"date_mode_candidate":null,"diagnostic":'
 || CASE k WHEN 1 THEN '"material_ambiguity"' WHEN 2 THEN '"unsupported_structure"' ELSE 'null' END || ',"explored_hypotheses":0,"failure_stage":' || CASE k WHEN 1 THEN '"search"' WHEN 2 THEN '"analysis"' ELSE 'null' END
 || ',"group_subtotal_candidate":null,"monetary_diagnostic_causes":{},"money_region_count":null,"observation_errors":[],"opening_balance_observed":null,"page_count":null,"positioned_text_available":null,"pruned_constraints":'
 || CASE WHEN k = 1 THEN '{' || concat_ws(',', CASE WHEN d > 0 THEN '"balance":' || d END, CASE WHEN c > 0 THEN '"closing":' || c END) || '}' ELSE '{}' END || ',"reconciliation_level":' || CASE k WHEN 0 THEN '"complete"' ELSE 'null' END
 || ',"row_count":' || n || ',"running_balance_candidate":null,"transaction_count_if_approved":' || CASE k WHEN 0 THEN n::VARCHAR ELSE 'null' END || '}' AS fp FROM t),
o AS (SELECT *, '{"analysis_status":"' || CASE k WHEN 0 THEN 'success' WHEN 1 THEN 'ambiguous' ELSE 'unsupported' END || '","blocking_capabilities":' || CASE k WHEN 2 THEN '["amount_roles","date_attribution"]' ELSE '[]' END || ',"diagnostic":'
 || CASE k WHEN 1 THEN '"material_ambiguity"' WHEN 2 THEN '"unsupported_structure"' ELSE 'null' END || ',"failure_stage":' || CASE k WHEN 1 THEN '"search"' WHEN 2 THEN '"analysis"' ELSE 'null' END || ',"monetary_diagnostic_causes":[],"pruned_constraints":'
 || CASE WHEN k = 1 THEN '[' || concat_ws(',', CASE WHEN d > 0 THEN '"balance"' END, CASE WHEN c > 0 THEN '"closing"' END) || ']' ELSE '[]' END || '}' AS out FROM j)
SELECT doc_id AS manifest_line, '{"corpus_id_hash":"' || sha256('c' || doc_id) || '","duplicate_of":null,"duration_ms":1.5,"fingerprint":' || fp || ',"input_error":null,"manifest_line":' || doc_id || ',"outcome_signature":"' || sha256(out)
 || '","schema_version":1,"sha256":"' || sha256(doc_id::VARCHAR) || '","structural_signature":"' || sha256(fp) || '"}' AS value FROM o""")
def report_sink(spark, sf_dir):
    p = _prints(spark, sf_dir)
    entries = render.movements(spark, sf_dir).select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("manifest_line"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("corpus_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(1.5).alias("duration_ms"), F.lit(None).cast("string").alias("input_error"))
    return fingerprint.report_lines(p, entries)


@query(M + """, t AS (SELECT doc_id, doc_id % 3 AS k, count(*) FILTER (amount > 0) AS c, count(*) FILTER (amount <= 0) AS d FROM m GROUP BY 1)
SELECT doc_id, CASE k WHEN 0 THEN 'verified:role:movement' WHEN 2 THEN 'failure:amount_roles,failure:date_attribution' ELSE concat_ws(',', CASE WHEN d > 0 THEN 'constraint:balance' END, CASE WHEN c > 0 THEN 'constraint:closing' END) END AS capabilities FROM t""")
def capability_incidence(spark, sf_dir):
    return fingerprint.capabilities(_prints(spark, sf_dir)).select("doc_id", F.array_join("capabilities", ",").alias("capabilities"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'chain:1' WHEN 1 THEN 'unknown_' || sha256('x y') || ':2' ELSE 'chain:1,unknown_' || sha256(n_name) || ':3' END AS codes FROM nation")
def counter_codes(spark, sf_dir):
    n = load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    k = F.col("n_nationkey") % 3
    own = F.when(k == 0, F.create_map(F.lit("chain"), F.lit(1))).when(k == 1, F.create_map(F.lit("x y"), F.lit(2))).otherwise(F.create_map(F.col("n_name"), F.lit(3), F.lit("chain"), F.lit(1)))
    out = fingerprint.counter_codes(own, ("chain",))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.array_join(F.transform(F.map_entries(out), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("codes"))


@query(M + """SELECT doc_id, doc_order, strftime(posting_date, '%d/%m/%Y') AS date, description, CASE WHEN amount >= 0 THEN 'Crédito' ELSE 'Débito' END AS kind,
'R$ ' || CASE WHEN amount < 0 THEN '-' ELSE '' END || translate(format('{:,.2f}', abs(amount)::DOUBLE), ',.', '.,') AS amount, 'R$ ' || CASE WHEN balance_after < 0 THEN '-' ELSE '' END || translate(format('{:,.2f}', abs(balance_after)::DOUBLE), ',.', '.,') AS balance FROM m""")
def review_table(spark, sf_dir):
    return reports.review_table(render.movements(spark, sf_dir)).withColumn("doc_order", F.col("doc_order").cast("long"))


@query(M + """SELECT doc_id, 'Bank: b / ' || CASE doc_id % 3 WHEN 0 THEN 'demo' WHEN 1 THEN 'digital' ELSE 'other' END || chr(10) || 'Transactions: ' || count(*) || ' (credits: ' || count(*) FILTER (amount > 0) || ', debits: ' || count(*) FILTER (amount < 0) || ')' || chr(10)
|| CASE doc_id % 3 WHEN 0 THEN 'Opening balance: ' || min(opening) || '; closing balance: unavailable' || chr(10) WHEN 1 THEN 'Balance validation: running balances and closing balance checked; opening balance unavailable' || chr(10) ELSE '' END || 'Validation: passed' AS text FROM m GROUP BY 1""")
def cli_summary(spark, sf_dir):
    m = render.movements(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(3))
    s = render.bounds(m).select("doc_id", F.lit("b").alias("bank"), F.when(k == 0, "demo").when(k == 1, "digital").otherwise("other").alias("layout"), F.when(k != 1, F.col("opening")).alias("opening"), F.lit(None).cast(lexical.CENTS).alias("closing"))
    return reports.summary_lines(s, m).select("doc_id", F.array_join("lines", "\n").alias("text"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, CASE r_regionkey WHEN 0 THEN 'O banco ou o formato deste extrato ainda não é suportado.' WHEN 1 THEN 'Os valores ou saldos do extrato não passaram na validação. O OFX não foi gerado.' ELSE 'Não foi possível processar este PDF com segurança. Verifique o arquivo e tente novamente.' END AS message FROM region")
def error_messages(spark, sf_dir):
    r = load(spark, sf_dir, "region", "r_regionkey", "r_name")
    kind = F.when(F.col("r_regionkey") == 0, "layout").when(F.col("r_regionkey") == 1, "validation").when(F.col("r_regionkey") == 2, F.col("r_name"))
    return r.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), reports.error_message(kind).alias("message"))


@query(M + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS only_a, CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END::BIGINT AS only_b FROM m GROUP BY 1")
def record_equality(spark, sf_dir):
    """Of four accounts one has another first amount, one a repeated row, two are equal but for their order."""
    m = render.movements(spark, sf_dir).select("doc_id", "posting_date", "description", "amount", F.when(F.col("doc_order") % 2 == 0, F.col("balance_after")).alias("balance_after"), "key", "doc_order")
    k, first = F.pmod("doc_id", F.lit(4)), F.col("doc_order") == 1
    b = m.withColumn("amount", F.when((k == 0) & first, F.col("amount") + 1).otherwise(F.col("amount")).cast(lexical.CENTS)).unionByName(m.where((k == 1) & first))
    return checks.record_differences(m.drop("doc_order"), b.drop("doc_order").orderBy("amount"))


@query("SELECT c_custkey::BIGINT AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'currency' WHEN 1 THEN 'account,currency' ELSE '' END AS conflicts, CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment ELSE c_name END AS account FROM customer")
def declared_context(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").withColumn("k", F.col("c_custkey") % 4)
    doc = F.col("c_custkey").cast("long").alias("doc_id")
    declared = c.select(doc, F.when(F.col("k") != 3, F.col("c_name")).alias("account"), F.lit("BRL").alias("currency"))
    supplied = c.select(doc, F.when(F.col("k").isin(1, 3), F.col("c_mktsegment")).when(F.col("k") == 0, F.col("c_name")).alias("account"), F.when(F.col("k") < 2, "USD").when(F.col("k") == 2, "BRL").alias("currency"))
    r = checks.context_conflicts(declared, supplied, ["account", "currency"])
    return r.select("doc_id", F.array_join("conflicts", ",").alias("conflicts"), "account")


@query(M + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS readings FROM m GROUP BY 1")
def structural_keys(spark, sf_dir):
    """Two readings of each account: the same words in another order, and for odd accounts another balance in the second."""
    m = render.movements(spark, sf_dir)
    span = lambda a, b: F.struct(F.lit(1).alias("page"), F.col("doc_order").alias("row"), F.lit(a).alias("word_start"), F.lit(b).alias("word_end"))
    one = m.select("doc_id", F.lit(1).alias("reading"), F.col("doc_order").alias("at"), "posting_date", "description", "amount", "balance_after", F.col("doc_order").alias("economic"), F.array(span(0, 1), span(1, 3)).alias("tokens"))
    two = one.withColumns({"reading": F.lit(2), "tokens": F.reverse("tokens"), "balance_after": F.when(F.col("doc_id") % 2 == 1, F.lit(None)).otherwise(F.col("balance_after"))})
    return checks.structural_keys(one.unionByName(two)).groupBy("doc_id").agg(F.count_distinct("key").alias("readings"))


@query(M + "SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1, 2, 5) THEN 'scope_segmentation' ELSE 'money_removed' END AS problem FROM m WHERE doc_id % 7 < 6 AND doc_id % 7 <> 4 GROUP BY 1")
def scope_partition(spark, sf_dir):
    """By 7: a row in two scopes, in none, in a scope without a name; money removed; a period removed, which is fine; financial
    text removed; all well."""
    m = render.movements(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(7))
    body = m.select("doc_id", F.lit(1).alias("page"), (F.col("doc_order") + 2).alias("row"), F.col("description").alias("text"), F.lit(True).alias("has_money"))
    head = m.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("row"), F.when(k == 4, "Período: 01/01/2027 a 02/02/2027").when(k == 5, "valor 1,2").otherwise("TITULO").alias("text"), F.lit(False).alias("has_money"))
    kept = body.where(~((k == 3) & (F.col("row") == 3)))
    first = F.col("row") == 3
    parts = kept.where(~((k == 1) & first)).select("doc_id", "page", "row", F.when((k == 2) & first, "").otherwise("main").alias("scope")).unionByName(kept.where((k == 0) & first).select("doc_id", "page", "row", F.lit("more").alias("scope")))
    return frames.scope_problems(body.unionByName(head), kept, parts)


@query("SELECT c_custkey::BIGINT AS doc_id, 4::BIGINT AS word FROM customer WHERE c_custkey % 5 = 0")
def description_separators(spark, sf_dir):
    """A flow, then a row of date-like code, a cell "PIX - ANA -" and an amount, then "SOUZA" below the cell. By 5: as said; no
    flow; the next row elsewhere; no other dash; the dash near the amount."""
    c = load(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").cast("long").alias("doc_id"), F.pmod("c_custkey", F.lit(5)).alias("k"))
    k = F.col("k")
    cell = lambda y, x, text: F.struct(F.lit(y).alias("y"), (x if not isinstance(x, float) else F.lit(x)).alias("x"), text.alias("text"))
    middle = F.when(k == 3, "PIX E ANA -").otherwise("PIX - ANA -")
    cells = F.array(
        cell(20.0, 35.0, F.when(k == 1, "nada aqui").otherwise("Total de entradas")), cell(20.0, 330.0, F.when(k == 1, "x").otherwise("+ 10,00")), cell(40.0, 35.0, F.lit("A1")), cell(40.0, 100.0, middle),
        cell(40.0, F.when(k == 4, 172.0).otherwise(330.0), F.lit("10,00")), cell(58.0, F.when(k == 2, 35.0).otherwise(100.0), F.lit("SOUZA")),
    )
    rows = statement.classify(statement.tokens(geometry.reconstruct_rows(render.words_from_cells(c.select("doc_id", F.lit(1).alias("page"), F.explode(cells).alias("c")).select("doc_id", "page", "c.*")))))
    return frames.separators(rows).select("doc_id", F.col("word").cast("long").alias("word"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents)
SELECT count(*) AS entries, count(*) FILTER (doc_id % 11 <> 0 AND n = 1) AS analyzed, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (doc_id % 11 = 0) AS input_errors FROM d""")
def batch_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("line"), corpus.content_hash(F.coalesce("text", F.lit(""))).alias("sha256"), F.when(F.col("doc_id") % 11 == 0, "file_missing").alias("input_error"))
    return corpus.batch_summary(corpus.first_occurrence(d))
