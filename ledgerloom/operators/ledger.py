"""The coverage ledger: which words a document's money stands on, who owns them, and what breaks that (SCH-14, FN-17, FN-26, SRT-6).

A span is (doc_id, page, row, word_start, word_end), half open. Problems are found by joins and sums over whole tables; of a
document the gravest is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import spans

SPAN = ("doc_id", "page", "row", "word_start", "word_end")
# Roles that belong to a transaction, and problems from the gravest on.
OWNED = ("movement", "running_balance")
PROBLEMS = ("region_repeated", "region_overlap", "claim_foreign", "claim_repeated", "claim_owner", "region_unclaimed", "movement_mismatch", "balance_mismatch", "field_missing", "field_owner", "field_overlap", "field_outside")


def text_span(text: Column, begin: Column, end: Column) -> Column:
    """struct(word_start, word_end) of the words that characters begin to end touch; null if they touch none."""
    pieces = F.split(text, r"\s+")
    # Where each word begins: white space runs are found by the words before them.
    gaps = F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0))
    lead = F.when(F.get(pieces, 0) == "", 1).otherwise(0)
    place = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, w: a + F.length(w)) + F.aggregate(F.slice(gaps, 1, i), F.lit(0), lambda a, g: a + F.length(g))
    touched = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (F.get(pieces, i) != "") & (place(i) < end) & (place(i) + F.length(F.get(pieces, i)) > begin))
    return F.when(F.size(touched) > 0, F.struct((F.get(touched, 0) - lead).cast("int").alias("word_start"), (F.element_at(touched, -1) + 1 - lead).cast("int").alias("word_end")))


def source_tokens(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans with tokens, or null and missing: rows (doc_id, page, row, tokens) must have every word."""
    r = found.join(rows.select("doc_id", "page", "row", F.col("tokens").alias("_own")), ["doc_id", "page", "row"], "left")
    there = F.coalesce((F.col("word_start") >= 0) & (F.col("word_start") < F.col("word_end")) & (F.col("word_end") <= F.size("_own")), F.lit(False))
    return r.withColumns({"tokens": F.when(there, F.slice("_own", F.col("word_start") + 1, F.col("word_end") - F.col("word_start"))), "missing": ~there}).drop("_own")


def canonical(found: Column) -> Column:
    """An array of spans in order of page, row and words, each once: structs compare field by field in that order."""
    return F.array_sort(F.array_distinct(found))


def has_role(found: DataFrame, claims: DataFrame, role: str) -> DataFrame:
    """Adds owned: whether a claim gives the span this role."""
    own = claims.where(F.col("role") == role).select(*SPAN).distinct().withColumn("_own", F.lit(True))
    return found.join(own, list(SPAN), "left").withColumn("owned", F.coalesce("_own", F.lit(False))).drop("_own")


def problems(expected: DataFrame, claims: DataFrame, transactions: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, problem), each problem of a document once.

    expected: the spans of all money, before any frame is taken away. claims: spans with role and tx (the transaction's
    number, null for roles of the whole document). transactions: (doc_id, tx, has_balance). fields: spans with tx and field
    (date, description, amount, balance, direction, evidence); the evidence spans are where all others must lie.
    """
    flag = lambda df, name: df.select("doc_id", F.lit(name).alias("problem")).distinct()
    gaps = spans.coverage(expected, claims, list(SPAN))
    role_of_tx = F.col("role").isin(*OWNED)
    moves = lambda role: claims.where((F.col("role") == role) & F.col("tx").isNotNull()).groupBy("doc_id", "tx").agg(F.count("*").alias("n"))
    moved = transactions.join(moves("movement"), ["doc_id", "tx"], "full").where("n is null or n <> 1 or has_balance is null")
    balanced = transactions.join(moves("running_balance"), ["doc_id", "tx"], "full").where("coalesce(n, 0) <> if(has_balance, 1, 0)")
    kinds = fields.groupBy("doc_id", "tx").agg(F.collect_set("field").alias("f"))
    whole = F.forall(F.array(*[F.lit(x) for x in ("date", "description", "amount", "direction", "evidence")]), lambda x: F.array_contains("f", x))
    lacking = transactions.join(kinds, ["doc_id", "tx"], "left").where(~F.coalesce(whole & (F.array_contains("f", "balance") == F.col("has_balance")), F.lit(False)))
    money = fields.where("field in ('amount', 'balance')").withColumn("role", F.when(F.col("field") == "amount", "movement").otherwise("running_balance"))
    unowned = money.join(claims.select(*SPAN, "role", "tx"), [*SPAN, "role", "tx"], "left_anti")
    words = fields.where("field in ('date', 'description')")
    # Prose and money of a row in one order: a clash between the two shows as a span that reaches into one of the other kind.
    both = words.select(*SPAN, F.lit(False).alias("money")).unionByName(expected.select(*SPAN, F.lit(True).alias("money")))
    hit = both.groupBy("doc_id", "page", "row").agg(F.collect_list(F.struct("word_start", "word_end", "money")).alias("s"))
    clash = hit.where(F.exists(F.filter("s", lambda a: ~a["money"]), lambda a: F.exists("s", lambda b: b["money"] & (a["word_start"] < b["word_end"]) & (b["word_start"] < a["word_end"]))))
    evidence = fields.where("field = 'evidence'").select("doc_id", "tx", "page", "row", F.col("word_start").alias("_s"), F.col("word_end").alias("_e"))
    inner = fields.where("field <> 'evidence'")
    lies = inner.join(evidence, ["doc_id", "tx", "page", "row"]).where("_s <= word_start and word_end <= _e").select(*inner.columns).distinct()
    found = [
        flag(expected.groupBy(*SPAN).count().where("count > 1"), "region_repeated"), flag(spans.overlapping(expected.distinct()).where("clash"), "region_overlap"),
        flag(gaps.where("gap = 'foreign'"), "claim_foreign"), flag(gaps.where("gap = 'repeated'"), "claim_repeated"), flag(gaps.where("gap = 'missing'"), "region_unclaimed"),
        flag(claims.where(role_of_tx != F.col("tx").isNotNull()), "claim_owner"), flag(moved, "movement_mismatch"), flag(balanced, "balance_mismatch"), flag(lacking, "field_missing"),
        flag(unowned, "field_owner"), flag(clash, "field_overlap"), flag(inner.join(lies, inner.columns, "left_anti"), "field_outside"),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, problem) of each of docs: the gravest, or null if its coverage holds."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PROBLEMS]), F.col("problem"))
    worst = found.groupBy("doc_id").agg(F.min_by("problem", rank).alias("problem"))
    return docs.select("doc_id").join(worst, "doc_id", "left")
