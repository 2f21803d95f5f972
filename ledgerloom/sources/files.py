"""Text sources with strict reading: lines, manifests and reports of JSON lines, and file hashes.

Nothing is guessed: a line that breaks its schema is kept and marked invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields of a manifest and the codes of input errors.
MANIFEST_TEXT = ("corpus_id", "local_path", "sha256", "source_url", "source_kind", "institution", "country", "region", "document_kind", "language", "public_or_private", "retrieved_at", "notes")
INPUT_ERRORS = ("manifest_invalid", "path_missing", "path_invalid", "file_missing", "file_unreadable", "hash_mismatch", "analysis_error", "file_changed")

# The fields of a report's fingerprints by what they may hold.
REPORT_COUNTS = ("page_count", "row_count", "date_candidate_count", "money_region_count", "transaction_count_if_approved")
REPORT_TOTALS = ("candidate_hypotheses", "explored_hypotheses")
REPORT_FLAGS = ("positioned_text_available", "opening_balance_observed", "closing_balance_observed", "running_balance_candidate", "group_subtotal_candidate", "budget_exhausted")
REPORT_LABELS = ("failure_stage", "diagnostic", "reconciliation_level")
REPORT_ENUMS = {
    "analysis_status": ("success", "ambiguous", "unsupported", "invalid"), "approved_chronology": ("ascending", "descending", "undeclared"), "date_mode_candidate": ("grouped", "per_transaction"),
    "amount_mode_candidate": ("signed", "credit_debit_marker", "group_subtotal"), "balance_mode_candidate": ("running_balance", "absent"),
}
REPORT_LISTS = {"blocking_capabilities": "", "observation_errors": "", "currency_observations": r"\A[A-Z]{3}\z", "chronology_candidates": r"\A(ascending|descending|undeclared)\z"}
REPORT_COUNTERS = ("pruned_constraints", "monetary_diagnostic_causes", "approved_role_counts")


def text_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): stripped lines that aren't blank, numbered from 1 within their page."""
    each = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("text", F.trim("raw")).where("text <> ''")
    return each.withColumn("line", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("k"))).select("doc_id", "page", "line", "text")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte, which Spark's file readers leave out; their names alone come to the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in store.globStatus(where) or [] for s in (store.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return [s.getPath().toString() for s in found if s.isFile() and s.getLen() == 0]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of files, empty ones included."""
    read = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, path)], "path string")
    return read.unionByName(empty.select("path", F.sha2(F.lit(b""), 256).alias("sha256"), F.lit(0).cast("long").alias("length")))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """lines(line, raw) -> line, valid, version and the text fields. Duplicate or unknown keys, another version, a quoted
    version, metadata that isn't text and malformed hashes or visibilities make a line invalid."""
    v = F.try_parse_json("raw")
    keys = F.json_object_keys("raw")
    read = lines.where(F.trim("raw") != "").withColumn("v", v)
    text = {n: F.try_variant_get(F.col("v"), f"$.{n}", "string") for n in MANIFEST_TEXT}
    typed = F.lit(True)
    for n in MANIFEST_TEXT:
        typed = typed & F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{n}", "variant")).isin("STRING", "VOID"), F.lit(True))
    version = F.try_variant_get(F.col("v"), "$.schema_version", "variant")
    numbered = version.isNull() | ((F.schema_of_variant(version) == "BIGINT") & (F.try_variant_get(F.col("v"), "$.schema_version", "int") == 1))
    known = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in (*MANIFEST_TEXT, "schema_version")]))) == 0
    hash_ok = text["sha256"].isNull() | text["sha256"].rlike(r"\A[0-9a-fA-F]{64}\z")
    seen_ok = text["public_or_private"].isNull() | text["public_or_private"].isin("public", "private")
    valid = F.col("v").isNotNull() & F.coalesce(known & typed & numbered & hash_ok & seen_ok, F.lit(False))
    return read.select("line", valid.alias("valid"), *[F.when(valid, F.lower(c) if n == "sha256" else c).alias(n) for n, c in text.items()])


def _valid_fingerprint(v: Column) -> Column:
    """Whether every known field of a record's fingerprint has its kind; unknown ones are never read."""
    at = lambda name: F.try_variant_get(v, f"$.fingerprint.{name}", "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("MISSING"))
    text = lambda name: F.try_variant_get(v, f"$.fingerprint.{name}", "string")
    unset = lambda x: kind(x).isin("MISSING", "VOID")
    count = lambda x: (kind(x) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") >= 0)
    fine = F.lit(True)
    for name in REPORT_COUNTS:
        fine = fine & (unset(at(name)) | count(at(name)))
    for name in REPORT_TOTALS:
        fine = fine & ((kind(at(name)) == "MISSING") | count(at(name)))
    for name in REPORT_FLAGS:
        fine = fine & (unset(at(name)) | (kind(at(name)) == "BOOLEAN"))
    for name in REPORT_LABELS:
        fine = fine & (unset(at(name)) | (kind(at(name)) == "STRING"))
    for name, values in REPORT_ENUMS.items():
        fine = fine & (unset(at(name)) | ((kind(at(name)) == "STRING") & text(name).isin(*values)))
    for name, pattern in REPORT_LISTS.items():
        items = F.try_variant_get(v, f"$.fingerprint.{name}", "array<string>")
        right = kind(at(name)).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(items, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))  # noqa: B023
        fine = fine & ((kind(at(name)) == "MISSING") | right | ((kind(at(name)) == "VOID") & F.lit(name == "chronology_candidates")))
    for name in REPORT_COUNTERS:
        entries = F.try_variant_get(v, f"$.fingerprint.{name}", "map<string,variant>")
        fine = fine & ((kind(at(name)) == "MISSING") | (F.startswith(kind(at(name)), F.lit("OBJECT")) & F.forall(F.map_values(entries), lambda x: F.coalesce(count(x), F.lit(False)))))
    return fine & text("analysis_status").isNotNull() & F.startswith(kind(F.try_variant_get(v, "$.fingerprint", "variant")), F.lit("OBJECT"))


def parse_report(lines: DataFrame) -> DataFrame:
    """lines(line, raw) -> line, valid, sha256, input_error, duplicate_of, status, stage, diagnostic, blockers, constraints of
    a report's records. A record with an input error needs nothing else than a duplicate's line, if it names one."""
    v = F.try_parse_json("raw")
    read = lines.where(F.trim("raw") != "").withColumn("v", v)
    get = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("MISSING"))
    error, digest, status = get("$.input_error", "string"), get("$.sha256", "string"), get("$.fingerprint.analysis_status", "string")
    version = (kind("$.schema_version") == "BIGINT") & (get("$.schema_version", "int") == 1)
    copy = kind("$.duplicate_of").isin("MISSING", "VOID") | ((kind("$.duplicate_of") == "BIGINT") & (get("$.duplicate_of", "bigint") > 0))
    failed = ~kind("$.input_error").isin("MISSING", "VOID")
    fine = F.when(failed, (kind("$.input_error") == "STRING") & error.isin(*INPUT_ERRORS) & copy).otherwise((kind("$.sha256") == "STRING") & digest.rlike(r"\A[0-9a-f]{64}\z") & _valid_fingerprint(F.col("v")))
    valid = F.coalesce(version & fine, F.lit(False))
    out = {
        "sha256": F.when(~failed, digest), "input_error": error, "duplicate_of": get("$.duplicate_of", "bigint"), "status": status, "stage": get("$.fingerprint.failure_stage", "string"), "diagnostic": get("$.fingerprint.diagnostic", "string"),
        "blockers": get("$.fingerprint.blocking_capabilities", "array<string>"), "constraints": get("$.fingerprint.pruned_constraints", "map<string,bigint>"),
    }
    return read.select("line", valid.alias("valid"), *[F.when(valid, c).alias(n) for n, c in out.items()])
