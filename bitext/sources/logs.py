"""Metric-log sinks and scans: per-run ``metrics.csv``, scalar logs, run scan.

Layout: one directory per run, ``<base>/<model_name>_<YYYYmmdd>_<HHMMSS>``.
The sink writes all runs in one job with ``partitionBy`` (directory
``run_dir=<name>``); the scan accepts that and the plain ``<name>/metrics.csv``
layout, and takes the run from ``_metadata.file_path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: the epoch CSV header, in order ---------------------------
METRICS_COLUMNS = ["epoch", "train_loss", "val_loss", "learning_rate", "epoch_time_sec"]
# ---------------------------------------------------------------------------
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("epoch_time_sec", T.DoubleType()),
    ]
)


def run_dir_name(model_name: Column, start_ts: Column) -> Column:
    """``<model_name>_<YYYYmmdd>_<HHMMSS>`` (logger timestamp format)."""
    return F.concat_ws("_", model_name, F.date_format(start_ts, "yyyyMMdd_HHmmss"))


def write_metrics_csv(epochs: DataFrame, base: str, mode: str = "append") -> None:
    """A5: append epoch rows under each run's directory, header included.
    ``epochs`` needs ``run_dir`` plus METRICS_COLUMNS."""
    (
        epochs.select("run_dir", *METRICS_COLUMNS)
        .repartition("run_dir")
        .sortWithinPartitions("run_dir", "epoch")
        .write.mode(mode)
        .option("header", True)
        .partitionBy("run_dir")
        .csv(base)
    )


def run_name_from_dir(dir_name: Column) -> Column:
    """Split on '_'; with more than 3 parts keep parts[1:-2] joined
    by '_', else the whole name."""
    parts = F.split(dir_name, "_", -1)
    n = F.size(parts)
    return F.when(n > 3, F.array_join(F.slice(parts, 2, n - 3), "_")).otherwise(dir_name)


def _dir_of(path: Column) -> Column:
    segs = F.split(path, "/", -1)
    n = F.size(segs)
    parent = F.element_at(segs, n - 1)
    grand = F.element_at(segs, F.greatest(n - 2, F.lit(1)))
    d = F.when(parent == "metrics.csv", grand).otherwise(parent)
    return F.regexp_replace(d, "^[^=/]*=", "")


def scan_runs(spark: SparkSession, base: str, latest_only: bool = True) -> DataFrame:
    """Every run's metrics with ``run`` (P13) and ``run_dir``; when two
    directories give the same run name, the latest directory wins."""
    raw = (
        spark.read.schema(METRICS_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(base)
        .select(*METRICS_COLUMNS, F.col("_metadata.file_path").alias("_path"))
    )
    df = raw.withColumn("run_dir", _dir_of(F.col("_path"))).withColumn("run", run_name_from_dir(F.col("run_dir")))
    if latest_only:
        w = Window.partitionBy("run")
        df = df.withColumn("_latest", F.max("run_dir").over(w)).where(F.col("run_dir") == F.col("_latest"))
    return df.select("run", "run_dir", *METRICS_COLUMNS)


def write_scalars(scalars: DataFrame, path: str) -> None:
    """A6 sink: append (run, tag, step, value) rows as Parquet by run."""
    scalars.write.mode("append").partitionBy("run").parquet(path)
