"""Sharding by extendible hashing: a directory over hash prefixes, in which only oversized buckets split on another bit.

The directory is derived from sums over hash prefixes. A histogram a few bits deeper than the mean shard needs gives the
size of every prefix of every length by one aggregation with partial sums; a bucket of it gets the shortest prefix that
fits. Buckets that don't fit even at that depth are measured again some bits deeper, and they alone. All of it are
DataFrame expressions; neither documents nor the directory reach the driver.

Defined cases: rows are hashed by id and text, so equal rows share a shard; a bucket whose rows all have one hash (a
document larger than the limit, or copies) can't be split and becomes a shard of its own; null ids and texts are hashed
as null and count no bytes; an empty table gives an empty result; other columns stay unless named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import cut

LIMIT = 64 << 20
#: Bits of the histogram beyond those that shards of mean size need, and further bits for what is still too large.
SPARE, STEP, ALL = 4, 8, 64


def prefix(depth: Column | int, hashed: str = "_h") -> Column:
    """The first bits of a hash as a number; none for depth 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(hashed), (ALL - depth).cast("int")))


def directory(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """fine (prefix of high bits), depth: the least depth from low on at which the bucket fits, or null if none does.

    rows has _h and n_bytes. The directory itself has a row for each bucket of high bits in use.
    """
    fine = rows.groupBy(prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("n"), F.min("_h").alias("a"), F.max("_h").alias("b"))
    levels = fine.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    levels = levels.withColumn("p", F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", "fine", (high - F.col("d")).cast("int"))))
    sizes = levels.groupBy("d", "p").agg(F.sum("n").alias("size"), F.min("a").alias("least"), F.max("b").alias("most"))
    fits = (F.col("size") <= limit) | (F.col("least") == F.col("most"))
    found = levels.select("fine", "d", "p").join(sizes.where(fits).select("d", "p"), ["d", "p"]).groupBy("fine").agg(F.min("d").alias("depth"))
    return fine.select("fine").join(found, "fine", "left")


RESULTS = ["n_bytes", "shard", "depth"]


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, depth and shard: "b" and the bits of its prefix."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    hashed = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long"), "_h": F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))})
    sizes = hashed.select("_h", "n_bytes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(ALL, max(1, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    rest, named = sizes, hashed
    tables: list[tuple[int, DataFrame]] = []
    while True:
        table = cut(directory(rest, limit, low, high))
        tables.append((high, table))
        open_ = table.where("depth is null").select("fine")
        if high == ALL or open_.isEmpty():
            break
        rest = sizes.withColumn("fine", prefix(high)).join(open_, "fine", "left_semi").select("_h", "n_bytes")
        low, high = high + 1, min(ALL, high + STEP)
    for i, (bits, table) in enumerate(tables):
        named = named.withColumn("fine", prefix(bits)).join(table.withColumnRenamed("depth", f"_d{i}"), "fine", "left").drop("fine")
    depth = F.coalesce(*[F.col(f"_d{i}") for i in range(len(tables))], F.lit(ALL)).cast("int")
    named = named.withColumn("depth", depth)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("_h"), ALL, "0"), F.lit(1), F.col("depth")))
    return named.withColumn("shard", F.concat(F.lit("b"), bits)).select(*docs.columns, *RESULTS)


def write(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """Writes rows of assign as Parquet, a folder a shard. A shard is dealt to one task, which its limit bounds; Spark's
    writer commits the files, so a lost task is written again."""
    sharded.repartition(shard).sortWithinPartitions(shard).write.partitionBy(shard).parquet(path)
