"""Checkpoint registry (A8): an append-only table of a run's checkpoints.

A version is ``run, epoch, global_step, val_loss, best_before, best_after,
improved, config`` (X7: the best before this epoch and after it are both kept).
Versions are written in numbered commits, each in a folder of its own
(``commit=<n>``): a commit that is written again replaces itself, so a job that
is repeated after a failure changes nothing. Where two commits hold the same
(run, epoch), the later one counts, as a file that a restarted run overwrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.operators.runs import best_checkpoint, resolve_checkpoints

SCHEMA = (
    "run string, epoch int, global_step long, val_loss double, best_before double, best_after double, "
    "improved boolean, config map<string, string>, commit long"
)
VERSION = ["run", "epoch", "global_step", "val_loss", "best_before", "best_after", "improved", "config"]


def checkpoint_versions(epochs: DataFrame, steps: DataFrame, configs: DataFrame) -> DataFrame:
    """The versions that training would save: one for each epoch in ``epochs(run, epoch, val_loss)``, with the
    ``global_step`` of ``steps(run, epoch, global_step)`` and the run's ``configs(exp_name, ..)`` row as a map of its
    values as strings. Epochs without steps and runs without a config have null there."""
    keys = [c for c in configs.columns if c != "exp_name"]
    entries = [x for c in keys for x in (F.lit(c), F.col(c).cast("string"))]
    config = configs.select(F.col("exp_name").alias("run"), F.create_map(*entries).alias("config"))
    rows = best_checkpoint(epochs).join(steps.select("run", "epoch", "global_step"), ["run", "epoch"], "left")
    return rows.join(config, "run", "left").select(*VERSION)


def write_versions(versions: DataFrame, path: str, commit: int) -> None:
    """Append ``versions`` as commit number ``commit``, which must be larger than those of other writers; writing the
    same commit again replaces it alone. A registry is small (a row for each epoch), so a commit is one file."""
    versions.select(*VERSION).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/commit={int(commit)}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Each (run, epoch) as its last commit has it."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = F.max_by(F.struct(*[F.col(c) for c in [*VERSION[2:], "commit"]]), "commit").alias("v")
    return rows.groupBy("run", "epoch").agg(last).select("run", "epoch", "v.*")


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """What each run's evaluation loads: ``resolve_checkpoints`` over the registry at ``path``, with the chosen
    version's step, losses, commit and config."""
    return resolve_checkpoints(read_versions(spark, path)).select(
        "run",
        "latest_epoch",
        "best_epoch",
        "best_val_loss",
        "resolved_epoch",
        "resolved_kind",
        F.col("version.global_step").alias("resolved_step"),
        F.col("version.best_before").alias("resolved_best_before"),
        F.col("version.commit").alias("resolved_commit"),
        F.col("version.config").alias("config"),
    )
