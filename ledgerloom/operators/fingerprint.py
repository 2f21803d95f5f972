"""Structural fingerprints: what a corpus run keeps of a document's analysis, without any of its text (AGG-7, AGG-10 to 13, AGG-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators.corpus import technical_code

# The fields of a fingerprint with their types, and those that the outcome's signature holds.
FIELDS = {
    "page_count": "bigint", "positioned_text_available": "boolean", "row_count": "bigint", "date_candidate_count": "bigint", "money_region_count": "bigint",
    "currency_observations": "array<string>", "chronology_candidates": "array<string>", "analysis_status": "string", "failure_stage": "string", "diagnostic": "string",
    "blocking_capabilities": "array<string>", "candidate_hypotheses": "bigint", "explored_hypotheses": "bigint", "pruned_constraints": "map<string,bigint>",
    "monetary_diagnostic_causes": "map<string,bigint>", "opening_balance_observed": "boolean", "closing_balance_observed": "boolean", "running_balance_candidate": "boolean",
    "group_subtotal_candidate": "boolean", "transaction_count_if_approved": "bigint", "date_mode_candidate": "string", "amount_mode_candidate": "string",
    "balance_mode_candidate": "string", "approved_chronology": "string", "approved_role_counts": "map<string,bigint>", "reconciliation_level": "string",
    "budget_exhausted": "boolean", "observation_errors": "array<string>",
}
EMPTY = {"array<string>": "array()", "map<string,bigint>": "map()"}
OUTCOME = ("analysis_status", "failure_stage", "diagnostic", "blocking_capabilities", "pruned_constraints", "monetary_diagnostic_causes")


def lexical_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, page_count, row_count, money_region_count, date_candidate_count, currency_observations,
    opening_balance_observed, closing_balance_observed) of rows with amounts and dates (AGG-13)."""
    first = F.get("amounts", 0)
    label = F.when(F.size("amounts") > 0, F.array_join(F.transform(F.slice("words", F.lit(1), first["start"]), lambda w: w["text"]), " ")).otherwise(F.col("text"))
    named = F.when(F.lower(label).startswith("saldo "), lexical.balance_labels(label)).otherwise(F.array().cast("array<string>"))
    has = lambda *kinds: F.bool_or(F.exists(named, lambda k: k.isin(*kinds)))
    codes = F.array_compact(F.transform("amounts", lambda a: a["money"]["currency"]))
    return rows.groupBy("doc_id").agg(
        F.max("page").cast("long").alias("page_count"), F.count("*").alias("row_count"), F.sum(F.size("amounts")).cast("long").alias("money_region_count"), F.sum(F.size("dates")).cast("long").alias("date_candidate_count"),
        # A currency's codes are three letters: a document's set of them is small.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(codes)))).alias("currency_observations"), has("inicial", "anterior").alias("opening_balance_observed"), has("final", "total").alias("closing_balance_observed"),
    )


def counters(each: DataFrame, code: str, name: str, count: str | None = None) -> DataFrame:
    """(doc_id, name): a map from technical codes to how often a document has them, in order of the codes (AGG-10 to 12)."""
    sums = each.groupBy("doc_id", F.col(code).alias("_c")).agg((F.sum(count) if count else F.count("*")).cast("long").alias("_n"))
    return sums.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_n")))).alias(name))


def geometry_profile(rows: DataFrame) -> DataFrame:
    """(doc_id, date_mode, amount_mode, balance_mode, transaction_left) of classified rows with in_area, by flags and minima
    over a document's rows (AGG-7)."""
    move = F.col("in_area") & (F.col("kind") == "content") & (F.size("amounts") > 0)
    plain = (F.size("amounts") == 1) & ~F.get("amounts", 0)["money"]["explicit_sign"] & F.get("amounts", 0)["money"]["marker"].isNull()
    g = rows.groupBy("doc_id").agg(
        F.bool_or(F.col("in_area") & F.col("kind").isin("date_heading", "flow") & (F.size("dates") > 0)).alias("grouped"), F.bool_or(F.col("in_area") & (F.col("kind") == "flow")).alias("flow"),
        F.coalesce(F.bool_and(F.when(move, plain)), F.lit(True)).alias("plain"), F.bool_or(move & F.exists("amounts", lambda a: a["money"]["marker"].isNotNull())).alias("marked"),
        F.bool_or(move & (F.size("amounts") == 2)).alias("two"), F.min(F.when(move, F.get("words", 0)["x0"])).alias("left"),
    )
    subtotal = F.col("flow") & F.col("plain")
    return g.select(
        "doc_id", F.when(F.col("grouped"), "grouped").otherwise("per_transaction").alias("date_mode"), F.when(subtotal, "group_subtotal").when(F.col("marked"), "credit_debit_marker").otherwise("signed").alias("amount_mode"),
        F.when(F.col("two"), "running_balance").otherwise("absent").alias("balance_mode"), F.when(subtotal, F.coalesce("left", F.lit(0.0))).alias("transaction_left"),
    )


def project(analysis: DataFrame, *observed: DataFrame) -> DataFrame:
    """doc_id and the FIELDS. analysis has a row a document with some of them; each of observed adds further ones by doc_id.

    Of a document without success the stage is named, at least as analysis; what only an approved statement can tell is
    null unless it succeeded.
    """
    joined = analysis
    for o in observed:
        joined = joined.join(o, "doc_id", "left")
    approved = F.col("analysis_status") == "success"
    value: dict[str, Column] = {}
    for name, kind in FIELDS.items():
        own = F.col(name) if name in joined.columns else F.lit(None)
        if kind in EMPTY and name != "chronology_candidates":
            own = F.coalesce(own.cast(kind), F.expr(EMPTY[kind]).cast(kind))
        value[name] = own.cast(kind)
    value["failure_stage"] = F.coalesce(value["failure_stage"], F.when(~approved, "analysis"))
    for name in ("transaction_count_if_approved", "approved_chronology", "reconciliation_level"):
        value[name] = F.when(approved, value[name])
    value["approved_role_counts"] = F.when(approved, value["approved_role_counts"]).otherwise(F.expr("map()").cast("map<string,bigint>"))
    value["blocking_capabilities"] = F.array_sort(F.array_distinct(value["blocking_capabilities"]))
    for name in ("candidate_hypotheses", "explored_hypotheses"):
        value[name] = F.coalesce(value[name], F.lit(0).cast("bigint"))
    value["budget_exhausted"] = F.coalesce(value["budget_exhausted"], F.lit(False))
    return joined.select("doc_id", *[c.alias(n) for n, c in value.items()])


def as_json(*names: str) -> Column:
    """Named columns as JSON with sorted keys, nulls included; maps are built in order of their keys."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def signatures(prints: DataFrame) -> DataFrame:
    """Adds structural_signature over all fields and outcome_signature over those of the verdict, counters by name alone."""
    names = [F.map_keys(n).alias(n) if FIELDS[n].startswith("map") else F.col(n) for n in sorted(OUTCOME)]
    return prints.withColumns({"structural_signature": F.sha2(as_json(*FIELDS), 256), "outcome_signature": F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)})


def report_lines(prints: DataFrame, entries: DataFrame) -> DataFrame:
    """(manifest_line, value) of a report: one JSON object an entry, keys sorted; write.text of value is the sink (SNK-3).

    entries: doc_id, manifest_line, corpus_id, sha256, duplicate_of, duration_ms, input_error.
    """
    e = entries.join(signatures(prints), "doc_id", "left")
    out = F.struct(
        F.sha2("corpus_id", 256).alias("corpus_id_hash"), "duplicate_of", "duration_ms", F.struct(*sorted(FIELDS)).alias("fingerprint"), "input_error", "manifest_line", "outcome_signature",
        F.lit(1).alias("schema_version"), "sha256", "structural_signature",
    )
    return e.select("manifest_line", F.to_json(out, {"ignoreNullFields": "false"}).alias("value"))


def capabilities(prints: DataFrame) -> DataFrame:
    """Adds capabilities: what a document shows, may have, has proven or fails by, each once."""
    c = F.col
    flags = {
        "observed:positioned_text": c("positioned_text_available"), "observed:dates": c("date_candidate_count") > 0, "observed:money_regions": c("money_region_count") > 0, "observed:opening_balance": c("opening_balance_observed"),
        "observed:closing_balance": c("closing_balance_observed"), "candidate:running_balance": c("running_balance_candidate"), "candidate:group_subtotal": c("group_subtotal_candidate"),
    }
    lists = {"observed:currency:": c("currency_observations"), "candidate:chronology:": c("chronology_candidates"), "failure:": c("blocking_capabilities")}
    maps = {"verified:role:": "approved_role_counts", "constraint:": "pruned_constraints", "monetary_diagnostic:": "monetary_diagnostic_causes"}
    parts = [F.array_compact(F.array(*[F.when(v, n) for n, v in flags.items()], *[F.concat(F.lit(f"candidate:{m}:"), c(f"{m}_candidate")) for m in ("date_mode", "amount_mode", "balance_mode")]))]
    named = lambda n, v: F.coalesce(F.transform(v, lambda x: F.concat(F.lit(n), x)), F.array().cast("array<string>"))
    parts += [named(n, v) for n, v in lists.items()]
    parts += [named(n, F.map_keys(F.map_filter(m, lambda _, v: v > 0))) for n, m in maps.items()]
    return prints.withColumn("capabilities", F.array_sort(F.array_distinct(F.concat(*parts))))


def counter_codes(counter: Column, known: tuple[str, ...]) -> Column:
    """A map with technical codes for keys; codes that fall together can't be told apart and keep one count."""
    return F.map_from_entries(F.array_sort(F.array_distinct(F.transform(F.map_entries(counter), lambda e: F.struct(technical_code(e["key"], known).alias("key"), e["value"].alias("value"))))))
