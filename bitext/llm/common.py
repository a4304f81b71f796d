"""Shared helpers of the training-data operators: tables, scratch tables, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time (the arrays take some 40 times as much).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for a written table, in the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps neither recompute it nor depend
    on the executors that made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: Column | None = None) -> DataFrame:
    """Deal rows out evenly before work that is heavy per row (one long row group is one task otherwise)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, by) if by is not None else df.repartition(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and its rows' offsets in them. Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Cut a record batch into slices with about ``most`` bytes of text (one row at least)."""
    if batch.num_rows:
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty segments give 0."""
    run = np.zeros(len(values) + 1, dtype=np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def words(raw: np.ndarray, at: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split rows of bytes into words, the runs without gap bytes. Returns word starts, word ends (byte positions)
    and, for each row, the number of words before it (one more entry than rows). Words never cross rows."""
    inside = ~is_gap
    begins = inside.copy()
    begins[1:] &= is_gap[:-1]
    edge = at[1:-1][at[1:-1] < len(raw)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= is_gap[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def distinct_slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte slices and the distinct slices that the codes number."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and offsets[-1] == ends[-1] - starts[0]:
        data = raw[starts[0] : ends[-1]]  # they lie end to end
    else:
        data = raw[flat_ranges(starts, lengths)]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def first_values(rows: DataFrame, value: str, most: int) -> DataFrame:
    """The rows with the smallest ``value`` (long): as many whole values as make at most ``most`` rows. Where the last
    value starts is found from the rows per value, so that no task sends more than belongs to the result."""
    run = F.sum("count").over(Window.orderBy("v"))  # a row per value
    fits = rows.groupBy(F.col(value).alias("v")).count().select("v", run.alias("upto")).where(F.col("upto") <= most)
    last = fits.agg(F.max("v")).first()[0]
    return rows.where(F.col(value) <= F.lit(last)) if last is not None else rows.limit(0)
