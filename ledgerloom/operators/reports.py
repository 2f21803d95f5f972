"""Small projections of results: movement summaries, default diagnostics, bounded diagnostic JSON, files written once."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.lexical import display_money

LOCATIONS, CONSTRAINTS = 8, 10

# What a user is told of each class of error. No text of an error or document is ever added.
MESSAGES = {
    "extraction": "Não foi possível extrair texto do PDF. Use um PDF com texto selecionável e verifique se o arquivo está danificado ou protegido. PDFs digitalizados não são suportados.",
    "layout": "O banco ou o formato deste extrato ainda não é suportado.",
    "parse": "O extrato está incompleto ou não segue o formato suportado. O OFX não foi gerado.",
    "validation": "Os valores ou saldos do extrato não passaram na validação. O OFX não foi gerado.",
    "generation": "Não foi possível gerar o OFX. Os dados bancários ou identificadores necessários estão ausentes, inválidos ou inconsistentes.",
}
OTHER_MESSAGE = "Não foi possível processar este PDF com segurança. Verifique o arquivo e tente novamente."


def movement_summary(tx: DataFrame) -> DataFrame:
    """(doc_id, movements, credits, debits): strictly positive and strictly negative counts; zero is neither."""
    return tx.groupBy("doc_id").agg(F.count("*").alias("movements"), F.count_if(F.col("amount") > 0).alias("credits"), F.count_if(F.col("amount") < 0).alias("debits"))


def default_diagnostic(status: Column, exhausted: Column) -> Column:
    """A spent budget explains more than the verdict; success needs no diagnostic."""
    return (
        F.when(exhausted, "budget_exhausted").when(status == "ambiguous", "material_ambiguity").when(status == "unsupported", "unsupported_structure").when(status == "invalid", "contradiction")
    )


def diagnose(results: DataFrame) -> DataFrame:
    """(doc_id, report): JSON of codes and counts only, with at most CONSTRAINTS constraints and LOCATIONS locations.

    results: doc_id, status, constraints array(struct(count, name)), locations array(struct(page, row)).
    """
    top = F.slice(F.array_sort("constraints", lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), 1, CONSTRAINTS)
    shown = F.slice(F.array_sort("locations"), 1, LOCATIONS)
    omitted = F.greatest(F.size("locations") - LOCATIONS, F.lit(0))
    return results.select("doc_id", F.to_json(F.struct(top.alias("constraints"), shown.alias("locations"), omitted.alias("omitted_locations"), F.col("status").alias("status"))).alias("report"))


def error_message(kind: Column) -> Column:
    """The message of a class of error (FN-28)."""
    m = F
    for name, text in MESSAGES.items():
        m = m.when(kind == name, text)
    return m.otherwise(OTHER_MESSAGE)


def review_table(tx: DataFrame) -> DataFrame:
    """(doc_id, doc_order, date, description, kind, amount, balance) as a reviewer sees them (SNK-7). Zero is a credit."""
    return tx.select("doc_id", "doc_order", F.date_format("posting_date", "dd/MM/yyyy").alias("date"), "description", F.when(F.col("amount") >= 0, "Crédito").otherwise("Débito").alias("kind"), display_money(F.col("amount")).alias("amount"), F.coalesce(display_money(F.col("balance_after")), F.lit("")).alias("balance"))


def summary_lines(statements: DataFrame, tx: DataFrame) -> DataFrame:
    """(doc_id, lines): what a command prints of a conversion (SNK-6). statements: doc_id, bank, layout, opening, closing.

    Balances are told of the demo layout alone, and of the digital one that its opening balance isn't printed.
    """
    s = statements.join(movement_summary(tx), "doc_id", "left").na.fill(0, ["movements", "credits", "debits"])
    plain = lambda c: F.coalesce(F.col(c).cast("decimal(38,2)").cast("string"), F.lit("unavailable"))
    return s.select("doc_id", F.array_compact(F.array(
        F.format_string("Bank: %s / %s", "bank", "layout"), F.format_string("Transactions: %d (credits: %d, debits: %d)", "movements", "credits", "debits"),
        F.when(F.col("layout") == "demo", F.concat(F.lit("Opening balance: "), plain("opening"), F.lit("; closing balance: "), plain("closing"))),
        F.when((F.col("layout") == "digital") & F.col("opening").isNull(), F.lit("Balance validation: running balances and closing balance checked; opening balance unavailable")),
        F.lit("Validation: passed"),
    )).alias("lines"))


def single_scope(regions: Column) -> Column:
    """The only region of kind financial, else null."""
    found = F.filter(regions, lambda r: r["kind"] == "financial")
    return F.when(F.size(found) == 1, F.get(found, 0))


def write_once(path: str, contents: str) -> None:
    """Publishes a driver-side file whole or not at all; an existing one is an error."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="ascii", newline="") as f:
            f.write(contents)
        os.link(name, path)
    finally:
        os.unlink(name)
