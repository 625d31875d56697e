"""What the operators of this subpackage share: reading tables, Arrow helpers, labels to learn from."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from aspectra.functions.lineage import dropped, saved, shared_dir, swept  # noqa: F401
from aspectra.functions.workers import ship_package

#: Bounds of one Arrow batch on its way to a Python worker; a text longer than that makes a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bytes of texts that are Python objects at a time.
SLICE_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch in rows and bytes, for operators that move whole texts to Python workers; smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) not in range(1, most + 1):
            spark.conf.set(key, str(most))


def with_fields(df: DataFrame, ddl: str, without: tuple[str, ...] = ()) -> StructType:
    """The schema of df, without some columns, and with those of a DDL string behind."""
    return StructType([f for f in df.schema.fields if f.name not in without] + StructType.fromDDL(ddl).fields)


def release() -> None:
    """Gives memory that is no longer used back to the system, as Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over batches of bounded size; what fn made for a partition is given back at its end."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of a batch with their whole texts as bytes (null: empty), of about `most` bytes."""
    column = as_binary(batch.column(text_col))
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > at and size + n > most:
            yield batch.slice(at, i - at), column.slice(at, i - at).to_pylist()
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at), column.slice(at).to_pylist()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_part(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: which rows a model must not learn from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def learning_rows(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of each value of a label, those of the smallest hashes; rows: distinct (key columns, label).

    Values are counted first; of a value with many more rows only those whose hash is below its share (four
    times what is wanted) come to the window, so that a common label does not gather in one task.
    """
    keys = [c for c in rows.columns if c != label]
    hashed = rows.withColumn("_h", F.xxhash64(*keys))
    share = rows.groupBy(label).agg(F.count("*").alias("_c")).select(label, (F.least(F.lit(1.0), F.lit(4.0 * most) / F.col("_c")) * 2.0**64 - 2.0**63).alias("_most"))
    w = Window.partitionBy(label).orderBy("_h", *keys)
    low = hashed.join(share, label).where(F.col("_h") <= F.col("_most"))
    return low.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(*keys, label)


def as_binary(column: pa.Array) -> pa.Array:
    """A text column as bytes, without decoding; null becomes empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.binary()).fill_null(b"")
