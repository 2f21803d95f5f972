"""What a user calls: conversion and diagnosis of documents as tables (SNK-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.lineage import cut
from ledgerloom.operators import export, reports
from ledgerloom.plans.statements import Analysis, analyze


def statements(analysis: Analysis, profile: export.Profile, currency: str | None = None) -> DataFrame:
    """What export asks of each document: doc_id, status, capability, account, currency, profile_currency, closing, period,
    texts, readiness. The currency is the only one that the document's amounts show, or the declared one where none does."""
    codes = F.array_compact(F.transform("amounts", lambda a: a["money"]["currency"]))
    seen = analysis.rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(codes))).alias("codes"))
    texts = analysis.transactions.groupBy("doc_id").agg(F.collect_set("description").alias("texts"))
    s = analysis.verdicts.join(analysis.context, "doc_id", "left").join(seen, "doc_id", "left").join(texts, "doc_id", "left")
    known = lexical.resolve_currency(F.array_union(F.coalesce("codes", F.array().cast("array<string>")), F.array_compact(F.array(F.lit(currency).cast("string")))))
    s = s.select("doc_id", "status", "capability", "pruned", "n_tx", F.lit(profile.account_id).alias("account"), known["code"].alias("currency"), F.lit(currency).cast("string").alias("profile_currency"), "closing", "period_begin", "period_end", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))
    return export.readiness(s)


def convert(words: DataFrame, profile: export.Profile, currency: str | None = None) -> DataFrame:
    """(doc_id, status, capability, readiness, payload): a payload for each document that is approved and ready, and for the
    others the gate that they don't pass."""
    analysis = analyze(words)
    # Read three times below.
    s = cut(statements(analysis, profile, currency))
    ready = s.where("readiness = 'ready'")
    tx = analysis.transactions.join(ready.select("doc_id"), "doc_id", "left_semi")
    payloads = export.payload(export.export_rows(export.transaction_ids(tx, profile)), ready, profile)
    return s.select("doc_id", "status", "capability", "readiness").join(payloads, "doc_id", "left")


def diagnose(words: DataFrame, profile: export.Profile) -> DataFrame:
    """(doc_id, report): bounded JSON of codes and counts, never of amounts, names or descriptions."""
    s = statements(analyze(words), profile)
    constraints = F.transform(F.map_entries(F.coalesce("pruned", F.expr("map()").cast("map<string,bigint>"))), lambda e: F.struct(e["value"].alias("count"), e["key"].alias("name")))
    most = F.slice(F.array_sort(constraints, lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).otherwise(F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))), 1, reports.CONSTRAINTS)
    report = F.struct(
        (F.col("status") == "success").alias("approved"), F.array_compact(F.array("capability")).alias("blocking_capabilities"), reports.default_diagnostic(F.col("status"), F.lit(False)).alias("diagnostic"), F.col("readiness").alias("export_readiness"),
        F.transform(most, lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"))).alias("pruned_constraints"), "status",
    )
    return s.select("doc_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
