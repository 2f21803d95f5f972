"""Operators on small tables, and the layouts' geometry."""

import datetime
import json

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from ledgerloom.operators import checks, export, frames, geometry, reports, spans
from ledgerloom.plans.statements import analyze
from ledgerloom.sources import files, profile, render

WORDS = "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double"


def test_rows_keep_their_anchor(spark):
    words = spark.createDataFrame([(1, 1, k, f"w{k}", 10.0 * (9 - k), 10.0 * (9 - k) + 5, c - 5.0, c + 5.0) for k, c in enumerate((0.0, 2.0, 4.0, 6.0))], WORDS)
    rows = geometry.reconstruct_rows(words).orderBy("row").collect()
    assert [r["text"] for r in rows] == ["w1 w0", "w3 w2"]


def test_invalid_words(spark):
    words = spark.createDataFrame([(1, 1, 0, "a", 0.0, 5.0, 0.0, 9.0), (1, 1, 1, " ", 0.0, 5.0, 0.0, 9.0), (1, 1, 2, "b", 5.0, 5.0, 0.0, 9.0), (1, 1, 3, "c", float("nan"), 5.0, 0.0, 9.0)], WORDS)
    assert sorted(r["word_no"] for r in geometry.invalid_words(words).collect()) == [1, 2, 3]


LAYOUT = {"pages": [[
    {"y": 40, "cells": [[35, "EXTRATO FICTICIO"]]}, {"y": 60, "cells": [[35, "Período: 01/03/2027 a 03/03/2027"]]}, {"y": 80, "cells": [[35, "Saldo inicial: R$ 100,00"]]}, {"y": 100, "cells": [[35, "Saldo final: R$ 100,01"]]},
    {"y": 130, "cells": [[35, "01/03/2027 CRÉDITO ALFA"], [330, "R$ 0,01"], [460, "R$ 100,01"]]}],
    [{"y": 40, "cells": [[35, "02/03/2027 PAGAMENTO JOÃO"], [330, "-R$ 0,01"], [460, "R$ 100,00"]]}, {"y": 60, "cells": [[35, "02/03/2027 TRANSFERÊNCIA BETA"], [330, "R$ 0,01"], [460, "R$ 100,01"]]}]]}


def words_of(spark, tmp_path, layout):
    (tmp_path / "pages.json").write_text(json.dumps(layout))
    return render.words_from_cells(render.recipe_cells(spark, str(tmp_path / "pages.json")))


def test_layout_per_row(spark, tmp_path):
    a = analyze(words_of(spark, tmp_path, LAYOUT))
    v = a.verdicts.first()
    assert (v["status"], v["n_tx"], str(v["total"]), v["reconciliation_level"]) == ("success", 3, "0.01", "opening_closing")
    tx = a.transactions.orderBy("doc_order").collect()
    assert [str(t["amount"]) for t in tx] == ["0.01", "-0.01", "0.01"]
    assert [str(t["balance_after"]) for t in tx] == ["100.01", "100.00", "100.01"]
    assert tx[1]["description"] == "PAGAMENTO JOÃO"
    assert [t["posting_date"].day for t in tx] == [1, 2, 2]


def test_layout_moved_and_scaled_in_time(spark, tmp_path):
    words = words_of(spark, tmp_path, LAYOUT)
    moved = words.withColumns({"x0": F.col("x0") + 100, "x1": F.col("x1") + 100, "top": F.col("top") + 7, "bottom": F.col("bottom") + 7}).repartition(7)
    assert analyze(moved).verdicts.first()["status"] == "success"
    tight = words.withColumns({"top": F.col("top") / 20, "bottom": F.col("top") / 20 + 1})
    assert analyze(tight).verdicts.first()["status"] != "success"


def test_contradiction(spark, tmp_path):
    wrong = json.loads(json.dumps(LAYOUT).replace("R$ 100,00\"], [330", "R$ 100,00\"], [330").replace("Saldo final: R$ 100,01", "Saldo final: R$ 100,02"))
    assert analyze(words_of(spark, tmp_path, wrong)).verdicts.first()["status"] == "invalid"


def test_exact_sums_overflow_loudly(spark):
    def total(digits):
        value = "9" * digits + ".99"
        rows = spark.sql(f"select cast('{value}' as decimal(38,2)) amount union all select cast('{value}' as decimal(38,2))")
        return rows.agg(checks.exact_sum(F.col("amount")).alias("s")).first()["s"]

    assert str(total(31)) == "1" + "9" * 31 + ".98"
    with pytest.raises(ArithmeticException):
        total(36)


def test_golden_payload(spark):
    day = lambda d: datetime.date(2026, 9, d)
    tx = spark.createDataFrame([(1, 1, day(1), "CRÉDITO", "0.01"), (1, 2, day(2), "TRANSFERÊNCIA", "0.01"), (1, 3, day(2), "PAGAMENTO JOÃO", "-0.01")], "doc_id long, doc_order int, posting_date date, description string, a string").withColumn("amount", F.col("a").cast("decimal(38,2)"))
    profile = export.Profile("999", "00000001", branch_id="0001", organization="Banco Fictício", institution_id="999", statement_bank="fictitious", layout="ofx-reference")
    rows = export.export_rows(export.transaction_ids(tx, profile))
    ids = [r["fitid"] for r in rows.orderBy("export_no").collect()]
    assert ids == ["a36ac21768d25c9f0d606a82bc99fc560274b402ab8664646a8e169252d9a359", "b9aa5e91c6ed3273fadc5fee555ef5096f504adf5d2eaea9d858e451dc05847a", "676d3a9d88d5c4bdfb99215dcf80ff7ed640e60317b6385c452d200b2973ee4c"]
    s = spark.createDataFrame([(1, day(1), day(3), "BRL")], "doc_id long, period_begin date, period_end date, currency string").withColumn("closing", F.lit("1.01").cast("decimal(38,2)"))
    text = export.payload(rows, s, profile).first()["payload"]
    assert text.startswith("OFXHEADER:100\n")
    assert "        <MEMO>" not in text.split("<BANKTRANLIST>")[0]
    assert "            <MEMO>PAGAMENTO JO&#195;O</MEMO>" in text
    assert "<ORG>Banco Fict&#237;cio</ORG>" in text
    assert text.isascii()


def test_repeated_transactions_have_their_own_ids(spark):
    tx = spark.createDataFrame([(1, datetime.date(2027, 1, 1), "PIX")] * 3, "doc_id long, posting_date date, description string").withColumn("amount", F.lit("1.00").cast("decimal(38,2)"))
    assert export.transaction_ids(tx, export.Profile("1", "2")).select("fitid").distinct().count() == 3


def test_frames(spark):
    rows = spark.createDataFrame([(1, p, r, t) for p in (1, 2) for r, t in enumerate(("CABECALHO", f"linha {p}", "Fale conosco", "SAC e Ouvidoria"), 1)], "doc_id long, page int, row int, text string")
    assert frames.contact_footers(rows).first()["footer_rows"] == 2
    kept, refused = frames.strip_frames(rows, footer_rows=2, header_rows=1)
    assert sorted(r["text"] for r in kept.collect()) == ["CABECALHO", "linha 1", "linha 2"]
    assert refused.count() == 0
    paged = rows.withColumn("text", F.when(F.col("row") == 4, F.concat(F.lit("Extrato gerado em 01/01/2027 pagina "), "page", F.lit(" de 3"))).otherwise(F.col("text")))
    assert frames.strip_frames(paged, footer_rows=1)[1].first()["refusal"] == "pagination_consistency"


def test_crossing_and_references(spark):
    i = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 1, 3), (1, 3, 4, 8)], "doc_id long, control long, begin long, end long")
    assert {r["control"]: r["crosses"] for r in spans.crossing(i).collect()} == {1: False, 2: False, 3: True}
    c = i.withColumn("refs", F.when(F.col("control") == 2, F.array(F.lit(9))).when(F.col("control") == 3, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    assert {(r["control"], r["problem"]) for r in spans.references(c).collect()} == {(2, "control_reference_missing"), (3, "control_reference_order")}


def test_manifest(spark):
    raw = ['{"corpus_id":"a"}', '{"corpus_id":"a","corpus_id":"b"}', '{"nope":1}', "not json", '{"sha256":"' + "A" * 64 + '"}', '{"schema_version":2}', '{"public_or_private":"secret"}', " "]
    out = files.parse_manifest(spark.createDataFrame(list(enumerate(raw)), "line long, raw string")).orderBy("line").collect()
    assert [r["valid"] for r in out] == [True, False, False, False, True, False, False]
    assert out[4]["sha256"] == "a" * 64


def test_text_lines(spark):
    p = spark.createDataFrame([(1, 1, " a \n\n b"), (1, 2, None)], "doc_id long, page int, text string")
    assert [(r["line"], r["text"]) for r in files.text_lines(p).orderBy("line").collect()] == [(1, "a"), (2, "b")]


def test_profile_codec():
    p = profile.LayoutProfile("grouped", "signed", "running_balance", footer_rows=2, tolerances=geometry.Tolerances(token_gap=9.0))
    assert profile.LayoutProfile.from_json(p.to_json()) == p
    absent = profile.LayoutProfile.from_json('{"date_mode":"grouped","amount_mode":"group_subtotal","balance_mode":"absent","transaction_left":10,"continuation_left":12.5}')
    assert (absent.balance_column, absent.carry_date_across_pages, absent.tolerances) == (None, True, geometry.Tolerances())
    ok = '"date_mode":"grouped","amount_mode":"signed","balance_mode":"running_balance"'
    for bad in (
        "{}", "[]", "null", "{" + ok + ',"version":2}', "{" + ok + ',"version":true}', "{" + ok + ',"x":1}', "{" + ok + ',"footer_rows":-1}', "{" + ok + ',"footer_rows":true}', "{" + ok + ',"footer_rows":1,"footer_rows":1}',
        "{" + ok + ',"movement_column":1}', "{" + ok + ',"continuation_left":3}', "{" + ok + ',"transaction_left":4,"continuation_left":3}', "{" + ok + ',"trailing_note_rows":1}', "{" + ok + ',"tolerances":{"row_y":-1}}', "{" + ok + ',"tolerances":{"z":1}}',
        "{" + ok.replace("running_balance", "absent") + ',"balance_column":1}', "{" + ok.replace("signed", "group_subtotal") + "}", "{" + ok.replace("grouped", "daily") + "}",
    ):
        with pytest.raises(ValueError):
            profile.LayoutProfile.from_json(bad)


def test_write_once(tmp_path):
    reports.write_once(str(tmp_path / "a.ofx"), "x")
    with pytest.raises(FileExistsError):
        reports.write_once(str(tmp_path / "a.ofx"), "y")
    assert (tmp_path / "a.ofx").read_text() == "x"
    assert [f.name for f in tmp_path.iterdir()] == ["a.ofx"]


def test_diagnosis_is_bounded(spark):
    r = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("invalid").alias("status"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct((i % 3).alias("count"), F.concat(F.lit("c"), i.cast("string")).alias("name"))).alias("constraints"), F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.struct(F.lit(1).alias("page"), i.alias("row"))).alias("locations"))
    report = json.loads(reports.diagnose(r).first()["report"])
    assert (len(report["constraints"]), len(report["locations"]), report["omitted_locations"]) == (10, 8, 3)
    assert report["constraints"][0] == {"count": 2, "name": "c11"}


def test_escapes(spark):
    texts = ["", "plain", 'a"b\\c', "x\n\r\t\b\f\x01\x1f\x7f", "ção ß", "🙂𝒳  ", "<&>'", None, "é" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", export.json_text(F.col("t")).alias("j"), export.xml_text(F.col("t")).alias("x")).collect()
    for r in rows:
        if r["t"] is None:
            assert (r["j"], r["x"]) == (None, None)
            continue
        assert r["j"] == json.dumps(r["t"], ensure_ascii=True)
        assert r["x"] == r["t"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").encode("ascii", "xmlcharrefreplace").decode()


def test_layout_dates_and_money(spark):
    texts = ["01/02/2027", "31/02/2027", "1/2/2027", "5 de março de 2027 Saldo do dia: R$ 1,00", "R$ 1,00 C", "R$ 1,00", "-R$ 2,00", "R$  1,00 D"]
    from ledgerloom.functions import lexical
    from ledgerloom.operators import layouts

    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(layouts.demo_date(t).alias("a"), layouts.digital_day(t).alias("b"), lexical.strict_money(t).alias("c"), lexical.symbol_money(t).alias("d"))
    got = [tuple(None if v is None else str(v) for v in r) for r in df.collect()]
    none = (None, None, None, None)
    assert got == [("2027-02-01", None, None, None), none, none, (None, "2027-03-05", None, None), (None, None, "1.00", None), (None, None, None, "1.00"), (None, None, None, "-2.00"), none]


def test_geometry_relations(spark):
    words = spark.createDataFrame([(1, 1, 1, "a", 0.0, 5.0, 0.0, 9.0), (1, 1, 2, " ", 6.0, 9.0, 0.0, 9.0), (2, 1, 1, "b", float("inf"), 5.0, 0.0, 9.0), (2, 1, 2, "c", 5.0, 5.0, 0.0, 9.0), (2, 1, 3, "d", 0.0, 1.0, float("nan"), 9.0), (2, 1, 4, None, 0.0, 1.0, 0.0, 9.0)], "doc_id int, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    assert sorted((r["doc_id"], r["word_no"]) for r in geometry.invalid_words(words).collect()) == [(1, 2), (2, 1), (2, 2), (2, 3), (2, 4)]
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    r = spark.range(1).select(geometry.same_row(*lit(0, 10, 3, 13), 3.0).alias("a"), geometry.same_row(*lit(0, 10, 4, 14), 3.0).alias("b"), geometry.aligned(*lit(5, 8), 3.0).alias("c"), geometry.near(*lit(0, 0, 3, 4), 5.0).alias("d"), geometry.normalized(*lit(3, 6)).alias("e"), geometry.normalized(*lit(3, 0)).alias("f")).first()
    assert tuple(r) == (True, False, True, True, 0.5, None)


def test_single_scope(spark):
    regions = lambda *kinds: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("n")) for i, k in enumerate(kinds)])
    r = spark.range(1).select(reports.single_scope(regions("frame", "financial"))["n"].alias("a"), reports.single_scope(regions("financial", "financial"))["n"].alias("b")).first()
    assert tuple(r) == (1, None)


def test_report_text(spark):
    from ledgerloom.operators import corpus

    rows = [("success", None, [], ["dates"]), ("invalid", "contradiction", [], ["dates", "money"]), ("unsupported", "x", ["a", "b"], []), ("unsupported", "x", ["b"], ["dates"])]
    docs = spark.createDataFrame(rows, "status string, diagnostic string, blockers array<string>, capabilities array<string>")
    text = corpus.render_report(corpus.status_totals(docs), corpus.failure_clusters(docs), corpus.capability_matrix(docs)).splitlines()
    assert text[1:5] == ["AMBIGUOUS                   0", "INVALID                     1", "SUCCESS                     1", "UNSUPPORTED                 2"]
    assert text[6:10] == ["Top failure clusters", "    2  b", "    1  a", "    1  contradiction"]
    assert text[-2:] == ["    3 /     1 /     2  dates", "    1 /     0 /     1  money"]


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"\x00abc")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[-1]: (r["sha256"], r["length"]) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (hashlib.sha256(b"\x00abc").hexdigest(), 4), "b.bin": (hashlib.sha256(b"").hexdigest(), 0)}


def test_misplaced_words_refuse(spark):
    words = [(1, 1, 1, "01/02/2027", 10.0, 60.0, 10.0, 20.0), (1, 1, 2, "LOJA", 70.0, 90.0, 10.0, 20.0), (1, 1, 3, "1,00", 100.0, 120.0, 10.0, 20.0), (1, 1, 4, " ", 130.0, 135.0, 10.0, 20.0)]
    df = spark.createDataFrame(words, "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    v = analyze(df).verdicts.first()
    assert (v["status"], v["capability"], v["n_tx"]) == ("unsupported", "visual_structure", None)
