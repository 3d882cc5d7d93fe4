"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that part words: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows and bytes up to which a side may be broadcast; beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: Rows of a batch that are Python objects at once; Spark's batches hold 10,000, which with whole texts is much memory for a worker.
SLICE_ROWS = 1_000
#: Bytes of a batch on its way to a Python worker, about.
BATCH_BYTES = 8 << 20
#: Rows of a batch of Parquet's reader. A task keeps one with all its texts, and Spark's 4,096 rows of whole texts are much of an executor's heap.
READ_ROWS = 256


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't blanks; null has none. Native."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only where Spark runs within one process may a folder of this machine stand in."""
    if current := spark.sparkContext.getCheckpointDir():
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows go to the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(df: DataFrame) -> Column:
    """Bytes of a row, about."""

    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(c)))
        return F.lit(8)

    return sum(map(of, df.schema.fields), F.lit(8)).cast("long")


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its rows and bytes, counted here, are within the bounds; else the plain side, which is joined by shuffle.

    rows: their number or its bound, where it is known and rows are of fixed width.
    """
    n, size = (rows, 0) if rows is not None else df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that Spark hands to Python workers, and the rows of those that it reads, from here on in this session: whole texts are large rows, and both sides hold a batch."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = re.match(r"\d+", spark.conf.get(key))
        if now is None or int(now[0]) > most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """One slice of an Arrow batch in, one out (or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if (out := function(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]
