"""Dense 0-based positions without a single-task global window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead: range-partition on the ordering, number rows inside each partition,
count rows per (partition, group), turn the counts into offsets on that small
table, and join the offsets back. The count table has at most
``partitions + groups`` rows; it is broadcast only when that is checked.

The range-partitioned rows are written once as a Parquet table in the shared
checkpoint folder before they are counted. Two separately planned range
exchanges sample their bounds with different seeds, so counting and numbering
must read the same materialised rows; the written table also cuts lineage
and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.session import scratch_path

# Hex digits of an md5 key used as its bucket: 16^4 = 65536 uniform buckets.
MD5_BUCKET_DIGITS = 4

# Broadcast the offsets table only below this many rows.
BROADCAST_MAX_ROWS = 2_000_000


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking its row count (one action)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def dense_position(
    df: DataFrame,
    order_cols: list[str | Column],
    group_cols: list[str] | None = None,
    pos_col: str = "pos",
    count_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``pos_col`` = 0-based rank of each row within ``group_cols`` by
    ``order_cols`` (which must be a total order). Optionally ``count_col`` =
    size of the row's group.

    Work is spread over ``num_partitions`` range partitions, so one group
    holding a third of all rows still spans many tasks.
    """
    spark = df.sparkSession
    group_cols = list(group_cols or [])
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(c) for c in group_cols] + order
    n = _num_partitions(df, num_partitions)
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    path = scratch_path(spark, "positions")
    ranged.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)

    gkeys = ["_pid"] + group_cols
    counts = rows.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    if count_col:
        total_w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
        offsets = offsets.withColumn(count_col, F.sum("_cnt").over(total_w))
    offsets = offsets.drop("_cnt")
    # Without groups the table has at most ``n`` rows (a proven bound);
    # with groups its size is checked first.
    offsets = F.broadcast(offsets) if not group_cols else broadcast_if_small(offsets)
    out = rows.join(offsets, on=gkeys, how="inner").withColumn(
        pos_col, (F.col("_mid") - F.col("_first") + F.col("_off")).cast("long")
    )
    return out.drop("_pid", "_mid", "_first", "_off")


def md5_bucket(key: Column, digits: int = MD5_BUCKET_DIGITS) -> Column:
    """Order-preserving uniform bucket of a lowercase hex md5 string."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def bucketed_position(
    df: DataFrame,
    bucket_cols: list[str],
    order_cols: list[str],
    group_cols: list[str] | None = None,
    pos_col: str = "pos",
    count_col: str | None = None,
    max_offset_rows: int = BROADCAST_MAX_ROWS,
    offsets_bound: int | None = None,
) -> DataFrame:
    """Dense 0-based positions when the order has a deterministic,
    order-preserving bucket (the ordering is ``bucket_cols`` then
    ``order_cols``, a total order): md5-prefix buckets of a shuffle key,
    (file, block) for file lines.

    Position = rows in earlier buckets of the group (cumulative counts on a
    table of one row per (group, bucket), broadcast after a size check) +
    ``row_number`` inside the bucket. Both passes compute the same buckets
    from the data, so nothing is sampled or materialised; one shuffle places
    each bucket in one task, and buckets are small by construction (uniform
    hash prefix, or one file block). ``offsets_bound`` is a proven bound on
    the number of (group, bucket) rows (e.g. 16^4 md5 buckets without
    groups); below ``max_offset_rows`` it skips the size check."""
    group_cols = list(group_cols or [])
    counts = df.groupBy(*group_cols, *bucket_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    order_b = [F.col(c) for c in bucket_cols]
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy(*order_b)
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if count_col:
        total_w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
        offsets = offsets.withColumn(count_col, F.sum("_cnt").over(total_w))
    offsets = offsets.drop("_cnt")
    if offsets_bound is not None and offsets_bound <= max_offset_rows:
        offsets = F.broadcast(offsets)
    else:
        offsets = broadcast_if_small(offsets, max_offset_rows)
    inner = Window.partitionBy(*group_cols, *bucket_cols).orderBy(*[F.col(c) for c in order_cols])
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    out = ranked.join(offsets, [*group_cols, *bucket_cols]).withColumn(
        pos_col, (F.col("_off") + F.col("_rn") - 1).cast("long")
    )
    return out.drop("_rn", "_off")


def file_position(df: DataFrame, group_cols: list[str] | None = None, pos_col: str = "pos") -> DataFrame:
    """Dense 0-based positions of a scan's rows in file order, per ``group_cols``, without a shuffle of the rows.

    ``df`` has ``_file``, ``_block`` and ``_row`` (``_metadata.file_path``, ``_metadata.file_block_start`` and
    ``monotonically_increasing_id()`` of the scan). A task reads a file's block from its start to its end, so a row's
    position is the rows of earlier blocks plus its distance from the block's first row. The blocks are counted by a scan
    without any text column. Files come in the order of their folder, then by name, shorter names first (part numbers
    beyond 99,999 have more digits). A row outside its block's counted range, as after a file changed between the two
    scans, fails."""
    group_cols = list(group_cols or [])
    key = [*group_cols, "_file", "_block"]
    blocks = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    name, folder = F.substring_index("_file", "/", -1), F.regexp_replace("_file", "/[^/]*$", "")
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy(folder, F.length(name), name, "_block")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if_small(blocks.withColumn("_before", before))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key]
    inside = F.col("_row") - F.col("_first")
    moved = F.raise_error(F.lit("a file's blocks changed while its rows were numbered")).cast("long")
    position = F.when(inside.between(F.lit(0), F.col("_n") - 1), F.col("_before") + inside).otherwise(moved)
    kept = [F.col(f"r.{c}") for c in df.columns if c not in ("_file", "_block", "_row")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    rows = df.alias("r").join(offsets.select(*key, F.col("_first"), "_n", "_before").alias("o"), on)
    return rows.select(*kept, position.cast("long").alias(pos_col))
