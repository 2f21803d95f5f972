"""What the operators of this subpackage share: checkpoints, tables and text kernels on numpy."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lineage import cut as cut, shared_checkpoints

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that the numpy kernels work on at once; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of texts that Spark hands a Python worker at once, where the session has its default.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Stands for a null id where ids are compared: the smallest.
NO_DOC = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """As cut, by a written table: its columns are compressed, and readers take those alone that they need."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_in = path
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own in the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now; else they stay until the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*dfs: DataFrame) -> None:
    """Deletes the files of cut or kept tables that nothing reads any more."""
    for df in dfs:
        if "kept_in" in vars(df):
            remove(df.sparkSession, df.kept_in)
            continue
        file = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts: at Spark's default of 10,000 rows a batch and its copies take hundreds of MB of an executor."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def by_row(docs: DataFrame, key: str, row: str = "row") -> DataFrame:
    """docs with a key of each row's own: its id if no id, null included, occurs twice, else a number checkpointed with it."""
    named = docs.withColumn(row, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_DOC)))
    if named.groupBy(row).count().where("count > 1").isEmpty():
        return named
    return cut(docs.withColumn(row, F.monotonically_increasing_id()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def clean(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows of about limit bytes; a longer row stands alone."""
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the row offsets (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[raw[0] : raw[-1]], raw - raw[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MULT = 0x9E3779B97F4A7C15 | 1
#: Base of second hashes, which have nothing in common with the first ones.
SECOND = 0xD6E8FEB86659FD93 | 1
_BYTE_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word [^\\x20\\x09-\\x0D]+, and per row the index of its first word (one more than rows)."""
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if base not in _cache or len(_cache[base]) <= n:
        steps = np.full(max(n + 1, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _cache[base] = np.multiply.accumulate(steps)
    return _cache[base][: n + 1]


class Prefix:
    """Hashes of any ranges of a sequence from prefix sums of a polynomial modulo 2 ** 64; equal ranges have equal hashes."""

    def __init__(self, codes: np.ndarray, base: int = _MULT):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _powers(base, n)[:n], out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def of(self, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + np.uint64(salt))


def byte_codes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTE_CODE[_LOWER] if lower else _BYTE_CODE)[data]


def batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])
