"""Export of approved ledgers: stable transaction ids, order, readiness and the tagged payload."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.lexical import ofx_date, ofx_money, ofx_text_ok

# The header of the payload.
HEADER = "OFXHEADER:100\nDATA:OFXSGML\nVERSION:102\nSECURITY:NONE\nENCODING:USASCII\nCHARSET:NONE\nCOMPRESSION:NONE\nOLDFILEUID:NONE\nNEWFILEUID:NONE\n\n"


@dataclass(frozen=True)
class Profile:
    """Who the statement is exported for."""

    bank_id: str
    account_id: str
    account_type: str = "CHECKING"
    branch_id: str | None = None
    organization: str | None = None
    institution_id: str | None = None
    statement_bank: str = "generic"
    layout: str = "generic"


def _each(value: Column, spell) -> Column:
    """value with spell(character, code point) for each of its characters; text of plain ASCII letters is left alone."""
    letters = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))
    spelled = F.array_join(F.transform(letters, lambda c: spell(c, F.ascii(c))), "")
    return F.when(value.rlike(r"\A[ !#-%'-;=?-\[\]-~]*\z"), value).otherwise(spelled)


def json_text(value: Column) -> Column:
    """A JSON string with all but ASCII escaped, which to_json doesn't do."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
    high = lambda code: unit(F.shiftright(code - 65536, 10) + 55296)
    low = lambda code: unit((code - 65536).bitwiseAND(F.lit(1023)) + 56320)

    def spell(c: Column, code: Column) -> Column:
        named = F
        for sign, text in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            named = named.when(c == sign, text)
        return named.when(code > 65535, F.concat(high(code), low(code))).when((code > 126) | (code < 32), unit(code)).otherwise(c)

    return F.concat(F.lit('"'), _each(value, spell), F.lit('"'))


def xml_text(value: Column) -> Column:
    """Text with markup escaped and all but ASCII as numeric references."""
    return _each(value, lambda c, code: F.when(c == "&", "&amp;").when(c == "<", "&lt;").when(c == ">", "&gt;").when(code > 127, F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(c))


def _json(value: str) -> Column:
    return F.lit(json.dumps(value, ensure_ascii=True))


def transaction_ids(tx: DataFrame, profile: Profile, account: Column | None = None) -> DataFrame:
    """Adds occurrence and fitid: SHA-256 of the identity (a compact JSON array) and of how often it came before.

    account: the account id as a column, where one job exports many accounts.
    """
    acct = json_text(account.cast("string")) if account is not None else _json(profile.account_id)
    parts = [_json(profile.statement_bank), _json(profile.layout), _json(profile.bank_id), acct, F.concat(F.lit('"'), F.col("posting_date").cast("string"), F.lit('"')), json_text(F.col("description")), F.concat(F.lit('"'), ofx_money(F.col("amount")), F.lit('"'))]
    if profile.branch_id is not None:
        parts.append(_json(profile.branch_id))
    named = tx.withColumn("identity", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    # Equal rows are interchangeable, so any order among them gives the same ids.
    occurrence = F.row_number().over(W.partitionBy("doc_id", "identity").orderBy("posting_date"))
    named = named.withColumn("occurrence", occurrence)
    return named.withColumn("fitid", F.sha2(F.concat_ws(":", "identity", F.col("occurrence").cast("string")), 256)).drop("identity")


def export_rows(tx: DataFrame) -> DataFrame:
    """Adds export_no: order by date, description by code point, signed amount."""
    order = W.partitionBy("doc_id").orderBy("posting_date", "description", "amount")
    return tx.withColumn("export_no", F.row_number().over(order))


def readiness(statements: DataFrame) -> DataFrame:
    """Adds readiness: the first gate that a statement doesn't pass.

    Its columns: status, currency, profile_currency, closing, texts (array of descriptions), account.
    """
    return statements.withColumn("readiness", (
        F.when(F.col("status") != "success", "not_approved")
        .when(F.col("account").isNull(), "metadata_required")
        .when(F.col("currency").isNull(), "currency_unresolved")
        .when(F.col("profile_currency").isNotNull() & (F.col("profile_currency") != F.col("currency")), "currency_conflict")
        .when(F.col("closing").isNull(), "closing_balance_required")
        .when(F.exists("texts", lambda t: ~ofx_text_ok(t)), "unsupported_text")
        .otherwise("ready")
    ))


def _tag(name: str, value: Column, depth: int) -> Column:
    return F.concat(F.lit("  " * depth + f"<{name}>"), value, F.lit(f"</{name}>"))


def payload(tx: DataFrame, statements: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, payload): one text a statement, of tx with fitid and export_no and statements (doc_id, period_begin,
    period_end, closing, currency). The lines of one statement meet in one row; a statement bounds it."""
    line = F.concat_ws(
        "\n", F.lit("  " * 5 + "<STMTTRN>"), _tag("TRNTYPE", F.when(F.col("amount") >= 0, "CREDIT").otherwise("DEBIT"), 6), _tag("DTPOSTED", ofx_date(F.col("posting_date")), 6),
        _tag("TRNAMT", ofx_money(F.col("amount")), 6), _tag("FITID", F.col("fitid"), 6), _tag("MEMO", xml_text(F.col("description")), 6), F.lit("  " * 5 + "</STMTTRN>"),
    )
    lines = tx.select("doc_id", F.struct("export_no", line.alias("line")).alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))
    fixed = lambda depth, text: F.lit("  " * depth + text)
    known = lambda name, value, depth: [_tag(name, xml_text(F.lit(value)), depth)] if value is not None else []
    ok = [fixed(3, "<STATUS>"), fixed(4, "<CODE>0</CODE>"), fixed(4, "<SEVERITY>INFO</SEVERITY>"), fixed(3, "</STATUS>")]
    institution = [fixed(3, "<FI>"), *known("ORG", profile.organization, 4), *known("FID", profile.institution_id, 4), fixed(3, "</FI>")] if profile.organization else []
    parts = [
        fixed(0, "<OFX>"), fixed(1, "<SIGNONMSGSRSV1>"), fixed(2, "<SONRS>"), *ok, _tag("DTSERVER", ofx_date(F.col("period_end")), 3), fixed(3, "<LANGUAGE>POR</LANGUAGE>"), *institution, fixed(2, "</SONRS>"), fixed(1, "</SIGNONMSGSRSV1>"),
        fixed(1, "<BANKMSGSRSV1>"), fixed(2, "<STMTTRNRS>"), fixed(3, "<TRNUID>0</TRNUID>"), *ok, fixed(3, "<STMTRS>"), _tag("CURDEF", F.col("currency"), 4), fixed(4, "<BANKACCTFROM>"),
        *known("BANKID", profile.bank_id, 5), *known("BRANCHID", profile.branch_id, 5), *known("ACCTID", profile.account_id, 5), *known("ACCTTYPE", profile.account_type, 5), fixed(4, "</BANKACCTFROM>"),
        fixed(4, "<BANKTRANLIST>"), _tag("DTSTART", ofx_date(F.col("period_begin")), 5), _tag("DTEND", ofx_date(F.col("period_end")), 5), F.col("lines"), fixed(4, "</BANKTRANLIST>"),
        fixed(4, "<LEDGERBAL>"), _tag("BALAMT", ofx_money(F.col("closing")), 5), _tag("DTASOF", ofx_date(F.col("period_end")), 5), fixed(4, "</LEDGERBAL>"), fixed(3, "</STMTRS>"), fixed(2, "</STMTTRNRS>"), fixed(1, "</BANKMSGSRSV1>"), fixed(0, "</OFX>"),
    ]
    return statements.join(lines, "doc_id").select("doc_id", F.concat(F.lit(HEADER), F.concat_ws("\n", *parts), F.lit("\n")).alias("payload"))
