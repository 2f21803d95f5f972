"""The queries of this subpackage, as __spark_entry__.py registers them, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_ids, url_filter
from ledgerloom.llm._base import shared_folder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_folder(spark, "token_ids")
    token_ids.write(table(spark, sf_dir, "documents"), folder, vocabulary, end_id)
    return token_ids.read_digests(spark, folder)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("kept", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", "n_bytes", "shard", "depth")



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_minhash_near_dedup,
        op4_url_filter,
        op5_token_ids,
        op6_suffix_dedup,
        op7_decontamination,
        op8_mixing,
        op9_quality_classifier,
        op10_sharding,
    )
}

#: Queries that SQL can express; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, r.i, array_to_string(ws[r.i:r.i + 12], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i) r),
m AS (SELECT x, min(doc_id) AS lo FROM w GROUP BY x),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM w JOIN m USING (x), LATERAL (SELECT unnest(range(13)) AS k) t WHERE lo < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p WHERE c.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op3_minhash_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[r.i:r.i + 4], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) r WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2""",
}
