"""The whole way from positioned words to a verdict a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.operators import checks, frames, search, statement
from ledgerloom.operators.geometry import Tolerances, has_invalid, reconstruct_rows


@dataclass
class Analysis:
    """Tables of one run, all keyed by doc_id."""

    rows: DataFrame
    transactions: DataFrame
    context: DataFrame
    verdicts: DataFrame


def read_rows(words: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """Words to classified rows with tokens and area."""
    return statement.transaction_area(statement.classify(statement.tokens(reconstruct_rows(words, tolerances), tolerances)))


def analyze(words: DataFrame, mode: str = "either", tolerances: Tolerances = Tolerances()) -> Analysis:
    """Contact footers go; what can't be read whole is refused; every reading of columns and order is then tried, and a
    single survivor with an independent control succeeds.

    Refused as unsupported are words without a place, incomplete amounts, money in the header that nobody owns, flows whose
    signs conflict, orphan rows, descriptions that aren't, and missing or competing dates. Declarations that contradict each
    other and footers that miscount pages are invalid.
    """
    # Several branches read each of these tables: they are cut, which also keeps plans from growing with every branch.
    plain = cut(reconstruct_rows(words, tolerances))
    numbered = plain.join(frames.contact_footers(plain), "doc_id", "left").withColumn("footer_rows", F.coalesce("footer_rows", F.lit(0)))
    body, refused = frames.strip_frames(numbered, F.col("footer_rows"))
    # Tables of a row a document are cut too: joined by one key they would all be one stage, whose tasks hold memory for every
    # sort, window and aggregate below at once.
    refused = cut(refused)
    read = cut(statement.transaction_area(statement.classify(statement.tokens(body.drop("footer_rows"), tolerances))))
    rows = cut(statement.bind_labels(read, tolerances))
    whole = rows.groupBy("doc_id").agg(F.bool_or(has_invalid(F.col("words"))).alias("misplaced"), (F.max(F.size("incomplete")) > 0).alias("incomplete"), F.bool_or("flow_conflict").alias("flow_conflict"), F.bool_or(~F.col("owned")).alias("unowned"))
    context = cut(statement.context(rows))
    segments = statement.segments(rows.where("in_area"), tolerances=tolerances)
    odd = cut(statement.attribute_dates(segments, mode).groupBy("doc_id").agg(F.bool_or("orphan").alias("orphan"), F.bool_or(F.col("date_error").isNotNull()).alias("undated")))
    moves = cut(statement.movements(segments, mode))
    readings = cut(search.enumerate_roles(moves, context))
    chosen = cut(search.chosen(readings))
    found = cut(search.search_verdict(readings).join(search.blocking(readings), "doc_id", "left").join(chosen, "doc_id", "left"))
    swapped = F.col("swap") == 1
    named = moves.join(chosen, "doc_id", "left")
    tx = cut(named.select(
        "doc_id", "doc_order", "posting_date", "description", F.when(swapped, F.col("right_amount")).otherwise(F.col("left_amount")).alias("amount"), F.when(swapped, F.col("left_amount")).otherwise(F.col("right_amount")).alias("balance_after"),
        F.coalesce("descending", F.lit(False)).alias("descending"), "invalid",
    ))
    facts = cut(checks.evidence(checks.economic_order(tx, F.col("descending")), context).select("doc_id", "reconciliation_level"))
    counts = tx.groupBy("doc_id").agg(F.count("*").alias("n_tx"), checks.exact_sum(F.col("amount")).alias("total"), F.bool_or(F.col("amount").isNull()).alias("unread"), F.max("invalid").alias("invalid"))
    v = whole.join(counts, "doc_id", "left").join(odd, "doc_id", "left").join(found, "doc_id", "left").join(facts, "doc_id", "left")
    v = v.join(context.select("doc_id", (F.col("opening_conflict") | F.col("closing_conflict")).alias("contradiction")), "doc_id", "left").join(refused, "doc_id", "left")
    capability = (
        F.when(F.col("misplaced"), "visual_structure").when(F.col("refusal").isNotNull(), F.when(F.col("refusal") == "pagination_consistency", "pagination_consistency").otherwise("page_frames"))
        .when(F.col("incomplete"), "monetary_token_incomplete").when(F.col("flow_conflict"), "semantic_candidates").when(F.col("unowned"), "monetary_role_domain_empty").when(F.col("n_tx").isNull() | F.col("orphan") | F.col("unread"), "transaction_segmentation")
        .when(F.col("invalid").isNotNull(), F.col("invalid")).when(F.col("undated"), "date_attribution").when(F.col("contradiction"), "financial_declarations")
    )
    v = v.withColumn("capability", capability)
    status = F.when(F.col("capability").isin("pagination_consistency", "financial_declarations"), "invalid").when(F.col("capability").isNotNull(), "unsupported").otherwise(F.col("status"))
    free = F.col("capability").isNull()
    verdicts = cut(v.select(
        "doc_id", status.alias("status"), "capability", F.when(free, F.col("n_tx")).alias("n_tx"), F.when(free, F.col("total")).alias("total"), F.when(free, F.col("reconciliation_level")).alias("reconciliation_level"),
        F.when(free, F.col("swap")).alias("swap"), F.when(free, F.col("descending")).alias("descending"), F.when(free, F.col("pruned")).alias("pruned"),
    ))
    return Analysis(rows, tx, context, verdicts)
