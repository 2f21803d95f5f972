"""The corpus pipeline: documents that rules reject go, of near duplicates one stays, documents with benchmark passages
go, sources are mixed to their targets, and what is left is dealt out to shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from ledgerloom.llm._base import by_row, remove, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """docs with _row, a key that no two rows share: verdicts are of rows, and an id may be missing or repeated."""
    return by_row(docs, "doc_id", "_row")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose _row is among those of kept."""
    return docs.join(kept.select("_row"), "_row", "left_semi").select(*COLUMNS)


# Defined cases of all stages: verdicts are of rows, so null and repeated ids are judged row by row and equal rows alike, but
# for near-duplicates, of which a single row stays; null and empty texts fail the quality rules; an empty table gives an
# empty table; all but the last stage return COLUMNS alone, so that other columns can't clash with a stage's own.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    docs = _rows(docs)
    return _only(docs, quality_rules.judge(docs, key="_row").where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id; rows without words are each a group."""
    docs = _rows(docs)
    return _only(docs, near_dedup.groups(docs, row="_row").where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage like an item of the benchmark."""
    docs = _rows(docs)
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), key="_row").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(found, "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    docs = _rows(docs)
    copies = mixing.mix(docs, row="_row").where("copies > 0").select("_row", "copies")
    taken = docs.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_bytes, shard and depth."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Connected components and expectation-maximisation are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what the next stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        after = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(after)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(after), after
    return docs
