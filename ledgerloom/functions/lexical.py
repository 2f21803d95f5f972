"""Money, dates and labels of Brazilian statements as column expressions.

Java's \\s and case folding need the U and u flags for Unicode; digits are spelled out, so full-width digits stay
refused. Nothing here turns unreadable text into a value: it gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, labels and the shapes of accepted text.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
BALANCE_KINDS = ["inicial", "anterior", "final", "total", "disponível", "bloqueado", "do dia", "diário"]
NUMBER = r"(?:0|[1-9][0-9]{0,2}(?:\.[0-9]{3})*|[1-9][0-9]*),[0-9]{2}"
MONEY = rf"(?U)\A([+-]?)\s*(?:(R\$)\s*)?({NUMBER})(?:\s+([CD]))?\z"
NUMERIC_DATE = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"
LONG_DATE = r"[0-9]{1,2} de [a-zçA-ZÇ]+ de [0-9]{4}"
SHORT_DATE = r"[0-9]{1,2} [a-zçA-ZÇ]{3} [0-9]{4}"
BALANCE_LABEL = r"(?iuU)\bsaldo\s+(" + "|".join(BALANCE_KINDS) + r")\b"
PERIOD = rf"(?iuU)\Aper[ií]odo:\s*({NUMERIC_DATE})\s+(?:a|até)\s+({NUMERIC_DATE})\z"
WRITTEN_PERIOD = r"(?iuU)\A(?:período:\s*)?([0-9]{1,2} de [a-zç]+ de [0-9]{4})\s+(?:a|até)\s+([0-9]{1,2} de [a-zç]+ de [0-9]{4})(?:\s+(.*))?\z"
FLOW_LABEL = r"(?iuU)\Atotal de (entradas|saídas|créditos|débitos):?\z"
STAMP = r"(?iuU)\A(?:extrato|documento) gerado (?:em|(?:no )?dia)\b"
CURRENCY_SYMBOLS = {"R$": "BRL"}

CENTS = "decimal(38,2)"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def money(text: Column) -> Column:
    """struct(amount, sign, marker, explicit_sign, currency) of a whole money text, else null.

    sign is kept apart as a decimal has no negative zero.
    """

    def read(parts: Column) -> Column:
        sign, symbol, number, marker = (F.get(parts, k) for k in range(4))
        contradicts = ((sign == "-") & (marker == "C")) | ((sign == "+") & (marker == "D"))
        # Beyond 36 digits a decimal of cents has no room; such text is refused, never rounded.
        fits = F.length(F.translate(number, ".,", "")) <= 38
        negative = (sign == "-") | (marker == "D")
        plain = F.translate(number, ",.", ".").try_cast(CENTS)
        value = F.struct(
            F.when(negative, -plain).otherwise(plain).cast(CENTS).alias("amount"),
            F.when(negative, -1).otherwise(1).alias("sign"),
            F.nullif(marker, F.lit("")).alias("marker"),
            (sign != "").alias("explicit_sign"),
            F.when(symbol == "R$", CURRENCY_SYMBOLS["R$"]).alias("currency"),
        )
        return F.when(~contradicts & fits, value)

    return let(text, lambda t: F.when(t.rlike(MONEY), let(F.split(F.regexp_replace(t, MONEY, "$1;$2;$3;$4"), ";"), read)))


def strict_money(text: Column) -> Column:
    """The demo layout's money: symbol and marker are required, single spaces, no sign."""
    return F.when(text.rlike(rf"\AR\$ {NUMBER} [CD]\z"), money(text)["amount"])


def symbol_money(text: Column) -> Column:
    """The first layout's money: the symbol is required, a minus may lead, no marker."""
    return F.when(text.rlike(rf"\A-?R\$ {NUMBER}\z"), money(text)["amount"])


def _month(name: Column, size: int | None = None) -> Column:
    names = F.array(*[F.lit(m[:size]) for m in MONTHS])
    return F.nullif(F.array_position(names, F.lower(name)), F.lit(0))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """A whole date text in one of three spellings; impossible dates give null."""
    long_, short = r"\A([0-9]{1,2}) de ([a-zçA-ZÇ]+) de ([0-9]{4})\z", r"\A([0-9]{1,2}) ([a-zçA-ZÇ]{3}) ([0-9]{4})\z"

    def written(t: Column, pattern: str, size: int | None = None) -> Column:
        return let(_month(_found(t, pattern, 2), size), lambda m: F.when(m.isNotNull(), _date(_found(t, pattern, 3), m, _found(t, pattern, 1))))

    def read(t: Column) -> Column:
        numeric = F.try_to_date(F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)), "yyyy-MM-dd")
        return F.when(t.rlike(rf"\A{NUMERIC_DATE}\z"), numeric).when(t.rlike(long_), written(t, long_)).when(t.rlike(short), written(t, short, 3))

    return let(text, read)


def has_date(text: Column) -> Column:
    return text.rlike(NUMERIC_DATE) | text.rlike(LONG_DATE) | text.rlike(SHORT_DATE)


def is_stamp(text: Column) -> Column:
    return text.rlike(STAMP)


def has_financial_signal(text: Column) -> Column:
    """Any currency sign or digits, comma, digits: malformed money must not pass as prose."""
    return text.rlike(r"[$€£]|[0-9]+,[0-9]+")


def balance_labels(text: Column) -> Column:
    """Every kind named after "saldo", in small letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(BALANCE_LABEL), F.lit(1)), F.lower)


def is_period(text: Column) -> Column:
    return text.rlike(PERIOD) | text.rlike(WRITTEN_PERIOD)


def period(text: Column) -> Column:
    """struct(begin, end, ambiguous) of a declared period, else null. A caption with money or dates makes it ambiguous."""

    def read(p: Column) -> Column:
        begin, end, caption = parse_date(F.get(p, 0)), parse_date(F.get(p, 1)), F.get(p, 2)
        named = caption.rlike(r"(?i)\A(?:valores|valor) em R\$\z")
        odd = (caption != "") & ~named & (has_financial_signal(caption) | has_date(caption))
        return let(F.struct(begin.alias("begin"), end.alias("end")), lambda d: F.struct(d["begin"].alias("begin"), d["end"].alias("end"), (d["begin"].isNull() | d["end"].isNull() | odd).alias("ambiguous")))

    def parts(t: Column) -> Column:
        numeric = F.array(_found(t, PERIOD, 1), _found(t, PERIOD, 2), F.lit(""))
        written = F.array(*[_found(t, WRITTEN_PERIOD, k) for k in (1, 2, 3)])
        return F.when(is_period(t), let(F.when(t.rlike(PERIOD), numeric).otherwise(written), read))

    return let(text, parts)


def flow_direction(label: Column) -> Column:
    """1 or -1 of a flow's caption, else null."""
    kind = F.lower(_found(label, FLOW_LABEL, 1))
    return F.when(kind.isin("entradas", "créditos"), 1).when(kind.isin("saídas", "débitos"), -1)


def display_money(amount: Column) -> Column:
    """R$ 1.234,56 with a minus after the symbol."""
    digits = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    return F.concat(F.when(amount < 0, F.lit("R$ -")).otherwise(F.lit("R$ ")), digits)


def statement_money(amount: Column) -> Column:
    """As statements print it: an optional minus, the symbol, grouped digits."""
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("R$ "), F.translate(F.format_number(F.abs(amount), 2), ",.", ".,"))


def currency(text: Column, strict: bool = True) -> Column:
    """A three-letter code, else null; not strict: trimmed and in capitals first."""
    value = text if strict else F.upper(F.trim(text))
    return F.when(value.rlike(r"\A[A-Z]{3}\z"), value)


def resolve_currency(codes: Column) -> Column:
    """struct(code, conflict) of a set of observed and declared codes."""
    known = F.array_distinct(F.array_compact(codes))
    return F.struct(F.when(F.size(known) == 1, F.get(known, 0)).alias("code"), (F.size(known) > 1).alias("conflict"))


def exact_cents(value: Column) -> Column:
    """Whether a decimal of any scale has whole cents. By its digits, as casts and comparisons round at the widest types."""
    return value.cast("string").rlike(r"\A-?[0-9]+(\.[0-9]{1,2}0*)?\z")


def ofx_date(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd")


def ofx_money(value: Column) -> Column:
    return value.cast(CENTS).cast("string")


def ofx_text_ok(value: Column) -> Column:
    """Not blank and of XML's characters only."""
    return F.coalesce((F.trim(value) != "") & ~value.rlike(r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"), F.lit(False))
