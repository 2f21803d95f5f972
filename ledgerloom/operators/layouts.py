"""Two fixed layouts read line by line: detection by header marks, one strict pattern a line, and refusals (SCH-17, FLT-6).

Every line must be accounted for: what is neither header, footer, day nor movement refuses its document. A document's lines
meet in windows by doc_id, which the document bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.functions.lexical import NUMBER, NUMERIC_DATE

# Marks and lines of the two layouts.
DEMO_HEADERS = ("BANCO SINTETICO", "EXTRATO CONTA CORRENTE")
DEMO_PERIOD = rf"\APeriodo: ({NUMERIC_DATE}) a ({NUMERIC_DATE})\z"
DEMO_MONEY = rf"R\$ {NUMBER} [CD]"
DEMO_OPENING, DEMO_CLOSING = "Saldo anterior: ", "Saldo final: "
DEMO_LINE = rf"\A({NUMERIC_DATE})\s+([A-Z][A-Z0-9 ]*?)\s+({DEMO_MONEY})\z"
DIGITAL_MONEY = rf"-?R\$\s*{NUMBER}"
DIGITAL_EMISSION = rf"\ASolicitado em: {NUMERIC_DATE} - [0-9]{{1,2}}h[0-9]{{2}}\z"
DIGITAL_BANK = r"\bBanco Inter\b"
DIGITAL_ACCOUNT = r"\A.*?\bAgência:\s*([0-9]+(?:-[0-9]+)?),?\s+Conta:\s*([0-9]+(?:-[0-9]+)?)\z"
DIGITAL_PERIOD = rf"\APeríodo:\s*({NUMERIC_DATE})\s+(?:a|até)\s+({NUMERIC_DATE})\z"
DIGITAL_SUMMARY_HEAD = "Saldo total Saldo disponível: Saldo bloqueado:"
DIGITAL_SUMMARY = rf"\A({DIGITAL_MONEY})\s+({DIGITAL_MONEY})\s+({DIGITAL_MONEY})\z"
DIGITAL_SEPARATOR = "(bloqueado + disponível)"
DIGITAL_DAY = rf"(?iu)\A([0-9]{{1,2}} de [a-zç]+ de [0-9]{{4}}) Saldo do dia:\s*({DIGITAL_MONEY})(?: Valor Saldo por transação)?\z"
DIGITAL_MOVEMENT = rf"\A(\S(?:.*?\S)?)\s+({DIGITAL_MONEY})\s+({DIGITAL_MONEY})\z"
DIGITAL_FOOTER = "Fale com a gente"


def _part(pattern: str, group: int, text: Column | str = "text") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def demo_date(text: Column) -> Column:
    """The demo layout's date: two digits, two digits, four."""
    return F.when(text.rlike(rf"\A{NUMERIC_DATE}\z"), lexical.parse_date(text))


def digital_day(text: Column) -> Column:
    """The date of a day's heading, with the month written out."""
    return lexical.parse_date(_part(DIGITAL_DAY, 1, text))


def _digital_money(text: Column) -> Column:
    """A symbol is required, white space after it optional."""
    return lexical.money(F.regexp_replace(text, r"R\$\s*", r"R\$ "))["amount"]


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds n, the place in the document, and up, the place from the end of the page."""
    doc, page = W.partitionBy("doc_id"), W.partitionBy("doc_id", "page")
    return lines.withColumns({"n": F.row_number().over(doc.orderBy("page", "line")), "up": F.row_number().over(page.orderBy(F.desc("line")))})


def _heads(lines: DataFrame) -> Column:
    """The n-th line's text of a document, by aggregation."""
    return lambda k: F.max(F.when(F.col("n") == k, F.col("text")))


def detect(lines: DataFrame) -> DataFrame:
    """(doc_id, layout): demo, digital, or null. Marks count at their own lines alone, never in a description."""
    at = _heads(lines)
    h = _numbered(lines).groupBy("doc_id").agg(*[at(k).alias(f"h{k}") for k in range(1, 6)], F.max("n").alias("lines"))
    demo = (F.col("h1") == DEMO_HEADERS[0]) & (F.col("h2") == DEMO_HEADERS[1])
    bank = F.col("h3").rlike(DIGITAL_BANK) & F.contains("h3", F.lit("Agência:")) & F.contains("h3", F.lit("Conta:")) & ~F.contains("h3", F.lit("R$"))
    digital = (F.col("lines") >= 6) & F.col("h1").rlike(DIGITAL_EMISSION) & bank & F.col("h4").rlike(DIGITAL_PERIOD) & (F.col("h5") == DIGITAL_SUMMARY_HEAD)
    return h.select("doc_id", F.when(demo, "demo").when(digital, "digital").alias("layout"))


def read_demo(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of documents of the demo layout: (doc_id, refusal, period_begin, period_end, opening, closing) and
    (doc_id, doc_order, posting_date, description, amount)."""
    own = _numbered(lines).withColumn("last", F.max("n").over(W.partitionBy("doc_id")))
    at = _heads(own)
    body = (F.col("n") > 4) & (F.col("n") < F.col("last"))
    date = demo_date(_part(DEMO_LINE, 1))
    balance = lambda text, label: F.when(text.startswith(label), lexical.strict_money(F.substring(text, F.lit(len(label) + 1), F.length(text))))
    h = own.groupBy("doc_id").agg(
        at(1).alias("h1"), at(2).alias("h2"), at(3).alias("h3"), at(4).alias("h4"), F.max("n").alias("lines"), F.max(F.when(F.col("n") == F.col("last"), F.col("text"))).alias("end"),
        F.bool_or(body & ~F.col("text").rlike(DEMO_LINE)).alias("odd"), F.bool_or(body & F.col("text").rlike(DEMO_LINE) & date.isNull()).alias("undated"),
    )
    h = h.withColumns({"period_begin": demo_date(_part(DEMO_PERIOD, 1, "h3")), "period_end": demo_date(_part(DEMO_PERIOD, 2, "h3")), "opening": balance(F.col("h4"), DEMO_OPENING), "closing": balance(F.col("end"), DEMO_CLOSING)})
    refusal = (
        F.when((F.col("lines") < 5) | (F.col("h1") != DEMO_HEADERS[0]) | (F.col("h2") != DEMO_HEADERS[1]), "header")
        .when(F.col("period_begin").isNull() | F.col("period_end").isNull(), "period").when(F.col("opening").isNull() | F.col("closing").isNull(), "balance")
        .when(F.col("odd"), "line").when(F.col("undated"), "date")
    )
    heads = h.select("doc_id", refusal.alias("refusal"), "period_begin", "period_end", "opening", "closing")
    tx = own.where(body).select("doc_id", (F.col("n") - 4).alias("doc_order"), date.alias("posting_date"), _part(DEMO_LINE, 2).alias("description"), lexical.strict_money(_part(DEMO_LINE, 3)).alias("amount"))
    return heads, tx.join(heads.where("refusal is null").select("doc_id"), "doc_id", "left_semi")


def read_digital(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of documents of the digital layout: (doc_id, refusal, period_begin, period_end, closing, branch_id, account_id) and
    (doc_id, doc_order, posting_date, description, amount, balance_after)."""
    doc = W.partitionBy("doc_id")
    own = _numbered(lines)
    footer = F.col("up") <= 2
    contact = F.col("text").rlike(r"\bSAC\b") & F.col("text").rlike(r"\bOuvidoria\b") & ~F.contains("text", F.lit("R$")) & ~F.col("text").rlike(NUMBER)
    bad_footer = ((F.col("up") == 2) & (F.col("text") != DIGITAL_FOOTER)) | ((F.col("up") == 1) & ~contact)
    head = (F.col("n") <= 6) | ((F.col("n") == 7) & (F.col("text") == DIGITAL_SEPARATOR))
    order = doc.orderBy("n")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    r = own.withColumns({"body": ~head & ~footer, "day": ~head & ~footer & F.col("text").rlike(DIGITAL_DAY)})
    r = r.withColumn("move", F.col("body") & ~F.col("day") & F.col("text").rlike(DIGITAL_MOVEMENT))
    r = r.withColumns({"group": F.sum(F.col("day").cast("int")).over(so_far), "of_day": F.last(F.when(F.col("day"), digital_day(F.col("text"))), True).over(so_far), "daily": _digital_money(_part(DIGITAL_DAY, 2)), "balance": F.when(F.col("move"), _digital_money(_part(DIGITAL_MOVEMENT, 3)))})
    groups = r.where("group > 0").groupBy("doc_id", "group").agg(F.max("daily").alias("daily"), F.count_if("move").alias("moves"), F.max_by("balance", F.when(F.col("move"), F.col("n"))).alias("end"), F.bool_or(F.col("day") & F.col("of_day").isNull()).alias("undated"))
    daily = groups.groupBy("doc_id").agg(F.bool_or(F.col("moves") == 0).alias("empty"), F.bool_or((F.col("moves") > 0) & (F.col("end") != F.col("daily"))).alias("differs"), F.bool_or("undated").alias("undated"))
    at = _heads(r)
    h = r.groupBy("doc_id").agg(
        *[at(k).alias(f"h{k}") for k in range(1, 7)], F.bool_or(bad_footer).alias("bad_footer"), F.min(F.col("up") + F.col("line") - 1).alias("shortest"),
        F.bool_or(F.col("body") & ~F.col("day") & (~F.col("move") | (F.col("group") == 0))).alias("odd"), F.bool_or(F.col("move") & F.contains(_part(DIGITAL_MOVEMENT, 1), F.lit("R$"))).alias("column"),
    )
    h = h.join(daily, "doc_id", "left").withColumns({"period_begin": demo_date(_part(DIGITAL_PERIOD, 1, "h4")), "period_end": demo_date(_part(DIGITAL_PERIOD, 2, "h4")), "closing": _digital_money(_part(DIGITAL_SUMMARY, 1, "h6")), "branch_id": _part(DIGITAL_ACCOUNT, 1, "h3"), "account_id": F.replace(_part(DIGITAL_ACCOUNT, 2, "h3"), F.lit("-"), F.lit(""))})
    missing = F.col("account_id").isNull() | F.col("closing").isNull() | (F.col("h5") != DIGITAL_SUMMARY_HEAD) | ~F.col("h1").rlike(DIGITAL_EMISSION) | F.contains("h2", F.lit("R$"))
    refusal = (
        F.when(F.col("bad_footer") | (F.col("shortest") < 2), "footer").when(F.coalesce(missing, F.lit(True)), "header").when(F.col("period_begin").isNull() | F.col("period_end").isNull(), "period")
        .when(F.col("odd"), "line").when(F.col("column"), "column").when(F.col("undated"), "date").when(F.col("empty"), "empty_group").when(F.col("differs"), "daily_balance")
    )
    heads = h.select("doc_id", refusal.alias("refusal"), "period_begin", "period_end", "closing", "branch_id", "account_id")
    tx = r.where("move").select("doc_id", F.row_number().over(order).alias("doc_order"), F.col("of_day").alias("posting_date"), _part(DIGITAL_MOVEMENT, 1).alias("description"), _digital_money(_part(DIGITAL_MOVEMENT, 2)).alias("amount"), F.col("balance").alias("balance_after"))
    return heads, tx.join(heads.where("refusal is null").select("doc_id"), "doc_id", "left_semi")
