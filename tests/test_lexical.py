"""Literal tables of accepted and refused text."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators.money_scan import scan_money


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "amount", "sign"), [("R$ 1.234,56", "1234.56", 1), ("-0,00", "0.00", -1), ("10,00 D", "-10.00", -1), ("-5,00 D", "-5.00", -1), ("+1,00", "1.00", 1), ("R$ 1,00", "1.00", 1)])
def test_money(spark, text, amount, sign):
    v = one(spark, lexical.money, text)
    assert (str(v["amount"]), v["sign"]) == (amount, sign)


@pytest.mark.parametrize("text", ["01,00", "1.23,45", "1,2", "-1,00 C", "+1,00 D", "１,00", "1,00\n", "", None, "9" * 40 + ",00"])
def test_money_refused(spark, text):
    assert one(spark, lexical.money, text) is None


@pytest.mark.parametrize(("text", "value"), [("29/02/2028", datetime.date(2028, 2, 29)), ("31/02/2027", None), ("1 de Março de 2027", datetime.date(2027, 3, 1)), ("5 DEZ 2026", datetime.date(2026, 12, 5)), ("5 de foo de 2026", None), ("1/2/2027", None), (None, None)])
def test_date(spark, text, value):
    assert one(spark, lexical.parse_date, text) == value


def test_currency(spark):
    assert one(spark, lexical.currency, "BRL") == "BRL"
    assert one(spark, lexical.currency, "brl") is None
    assert one(spark, lambda c: lexical.currency(c, strict=False), " brl ") == "BRL"


def test_cents(spark):
    d = spark.sql("select cast('1.005' as decimal(20,3)) a, cast('1.000' as decimal(20,3)) b")
    r = d.select(lexical.exact_cents(F.col("a")).alias("a"), lexical.exact_cents(F.col("b")).alias("b")).first()
    assert not r["a"]
    assert r["b"]


def row(text, gap=4.0, wide=()):
    x, x0, x1 = 20.0, [], []
    for i, w in enumerate(text.split()):
        x0.append(x)
        x1.append(x + 6 * len(w))
        x = x1[-1] + (50.0 if i in wide else gap)
    return text.split(), x0, x1


def scanned(spark, texts, x0, x1):
    """Regions and incomplete stretches of one row."""
    df = spark.createDataFrame([([*zip(texts, x0, x1, strict=True)],)], "words array<struct<text:string,x0:double,x1:double>>")
    s = df.select(scan_money(F.col("words"), 12.0).alias("s")).first()["s"]
    return [(r["start"], r["end"]) for r in s["regions"]], [(r["start"], r["end"]) for r in s["incomplete"]]


@pytest.mark.parametrize(("text", "regions", "broken"), [
    ("Loja R$ 1,00 R$ 2,00", [(1, 3), (3, 5)], []), ("Loja 1 234,56", [], [(1, 3)]), ("Loja 12,3", [], [(1, 2)]), ("Loja USD 1,00", [], [(1, 3)]), ("REF 123 +1,00", [(2, 3)], []),
    ("( 1,00 )", [], [(0, 3)]), ("Loja 1,00 C", [(1, 3)], []), ("Loja -1,00 C", [], [(1, 3)]), ("SEM VALOR", [], []),
])
def test_scan(spark, text, regions, broken):
    assert scanned(spark, *row(text)) == (regions, broken)


def test_scan_gap(spark):
    assert scanned(spark, *row("PIX - 1,00", wide=(1,))) == ([(2, 3)], [(1, 3)])


def test_scan_merges_only_what_overlaps(spark):
    assert scanned(spark, *row("1,00 12 2,00")) == ([], [(0, 3)])
    assert scanned(spark, *row("x1,2 1,00 C D")) == ([], [(0, 1), (1, 4)])
    assert scanned(spark, *row("x1,2 1,00 C D", gap=0.0)) == ([], [(0, 4)])
    assert scanned(spark, [], [], []) == ([], [])
