"""Parallel-text files: one sentence per line, paired by line number.

Sink (A3): both sides come from one positioned table, range-partitioned and
sorted on ``pos`` per split, so part files concatenated in name order give
the lines in ``pos`` order; ``\\n`` and ``\\r`` are removed first (X10).

Scan (A2): the line number of a row is the number of lines in earlier files
and blocks plus its place in its block, both known without moving a line
(``positions.file_position``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.functions.text import py_strip
from bitext.operators.corpus import clean_text
from bitext.operators.positions import file_position


def write_parallel_text(
    splits: DataFrame, base: str, num_partitions: int | None = None, mode: str = "overwrite"
) -> None:
    """Write ``<base>/src/split=<s>/part-*`` and ``<base>/tgt/split=<s>/...``.

    ``splits`` has ``split, pos, src, tgt``. Rows are cleaned of line breaks so
    one record is exactly one line on both sides.
    """
    ordered = (
        splits.select("split", "pos", clean_text("src").alias("src"), clean_text("tgt").alias("tgt"))
        .repartitionByRange(*([num_partitions] if num_partitions else []), "split", "pos")
        .sortWithinPartitions("split", "pos")
    )
    for side in ("src", "tgt"):
        ordered.select("split", "pos", F.col(side).alias("value")).sortWithinPartitions("split", "pos").drop(
            "pos"
        ).write.mode(mode).partitionBy("split").text(f"{base}/{side}")


def read_lines(spark: SparkSession, path: str, group_cols: list[str] | None = None) -> DataFrame:
    """A2 (one side): ``(line_no, text)`` with 0-based file-order line numbers
    (per ``group_cols`` if the folder is partitioned, e.g. by split)."""
    raw = spark.read.text(path).select(
        *(group_cols or []),
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return file_position(raw, group_cols, pos_col="line_no")


def read_parallel_text(spark: SparkSession, base: str, strip: bool = True) -> DataFrame:
    """A2: join the two sides on (split, line_no); lines are stripped like the
    reference's reader."""
    src = read_lines(spark, f"{base}/src", ["split"]).withColumnRenamed("text", "src")
    tgt = read_lines(spark, f"{base}/tgt", ["split"]).withColumnRenamed("text", "tgt")
    out = src.join(tgt, ["split", "line_no"])
    if strip:
        out = out.withColumn("src", py_strip("src")).withColumn("tgt", py_strip("tgt"))
    return out.select("split", "line_no", "src", "tgt")
