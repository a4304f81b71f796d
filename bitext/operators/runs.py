"""Training-run tables: epoch roll-ups, losses, checkpoints, comparison.

Inputs are step logs ``(run, epoch, batch, step, loss, n_tokens,
learning_rate, ts)`` and epoch logs ``(run, epoch, train_loss, val_loss,
learning_rate, epoch_time_sec)``. Everything groups by run (and epoch);
windows are partitioned by run over epoch rows, which are few per run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.text import py_strip

# --- Fixed values: the reference's defaults ---------------------------------
QUIT_WORDS = ["q", "exit"]
REPORT_EPOCH = 10  # comparison row: 10th epoch, or the last if fewer
PPL_CAP = 100.0  # exp(loss) only below this, else +inf
# Base configuration ("sanity" mode) used by the overlay.
BASE_CONFIG = {
    "batch_size": 96,
    "accumulation_steps": 1,
    "num_epochs": 30,
    "vocab_size": 32000,
    "max_len": 128,
    "d_model": 512,
    "n_layers": 6,
    "n_heads": 8,
    "d_ff": 2048,
    "dropout": 0.3,
    "lr": 1e-4,
    "weight_decay": 1e-4,
    "label_smoothing": 0.1,
}
# ---------------------------------------------------------------------------


def filter_requests(req: DataFrame) -> DataFrame:
    """A quit word ends its session; blank requests are skipped; the
    text is stripped. Per-session first quit is an aggregate joined back."""
    quits = (
        req.where(F.lower("text").isin(QUIT_WORDS))
        .groupBy("session_id")
        .agg(F.min("request_id").alias("_quit"))
    )
    live = req.join(quits, "session_id", "left").where(
        F.col("_quit").isNull() | (F.col("request_id") < F.col("_quit"))
    )
    return live.where(F.col("text").isNotNull() & (py_strip("text") != "")).select(
        "session_id", "request_id", py_strip("text").alias("text")
    )


def perplexity_of(loss: Column, cap: float = PPL_CAP) -> Column:
    """exp(loss) if loss < cap else +inf."""
    return F.when(loss < cap, F.exp(loss)).otherwise(F.lit(math.inf))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, rounded half-up to 2 places using
    integer microseconds (exact, no float tie issues)."""
    us = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor((us + 5000) / 10000) / 100.0


def epoch_summary(steps: DataFrame, val_fraction: float = 0.25) -> DataFrame:
    """One row per (run, epoch) from the step log.

    ``train_loss`` = mean batch loss; ``val_loss`` = mean of the batch means
    of the last ``val_fraction`` of the epoch's batches; ``learning_rate`` =
    rate at the epoch's last step; ``epoch_time_sec`` = elapsed wall time.
    """
    per = steps.groupBy("run", "epoch").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg("loss").alias("train_loss"),
        F.max_by("learning_rate", "batch").alias("learning_rate"),
        F.min("ts").alias("_t0"),
        F.max("ts").alias("_t1"),
        F.max("batch").alias("_last"),
    )
    # Validation batches: batch >= (1 - val_fraction) * n_batches.
    thresh = 1.0 - val_fraction
    val = (
        steps.join(per.select("run", "epoch", "n_batches"), ["run", "epoch"])
        .where(F.col("batch") >= F.col("n_batches") * thresh)
        .groupBy("run", "epoch")
        .agg(F.avg("loss").alias("val_loss"))
    )
    return per.join(val, ["run", "epoch"], "left").select(
        "run",
        "epoch",
        "n_batches",
        "train_loss",
        "val_loss",
        "learning_rate",
        elapsed_seconds(F.col("_t0"), F.col("_t1")).alias("epoch_time_sec"),
    )


def train_loss_rollup(steps: DataFrame, accumulation_steps: int = 1) -> DataFrame:
    """D7/B10/E9 (P9): per (run, epoch) the loss of the last micro-batch of
    each update step ((batch+1) % accum == 0), summed and divided by
    batches/accum as a real; ``global_step`` = updates so far in the run."""
    a = accumulation_steps
    per = steps.groupBy("run", "epoch").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.count_if(F.pmod(F.col("batch") + 1, F.lit(a)) == 0).alias("n_updates"),
        F.sum(F.when(F.pmod(F.col("batch") + 1, F.lit(a)) == 0, F.col("loss")).otherwise(F.lit(0.0))).alias(
            "_sum"
        ),
    )
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(
        "run",
        "epoch",
        "n_batches",
        "n_updates",
        F.sum("n_updates").over(w).alias("global_step"),
        (F.col("_sum") / (F.col("n_batches") / F.lit(float(a)))).alias("train_loss"),
    )


def val_loss_batch_mean(samples: DataFrame, batch_size: int) -> DataFrame:
    """Validation loss = mean over batches of each batch's mean loss.
    Batches are consecutive ``batch_size`` samples by ``pos`` per (run, epoch);
    the last short batch counts as a full batch in the outer mean."""
    per_batch = samples.groupBy("run", "epoch", F.floor(F.col("pos") / batch_size).alias("vbatch")).agg(
        F.avg("loss").alias("_m")
    )
    return per_batch.groupBy("run", "epoch").agg(
        F.avg("_m").alias("val_loss"), F.count(F.lit(1)).alias("n_batches")
    )


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """B11/E3 (X7): running best before each epoch (+inf first), whether the
    epoch improves on it strictly, and the best after."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.min("val_loss").over(w), F.lit(math.inf))
    out = epochs.select("run", "epoch", "val_loss", before.alias("best_before"))
    return out.select(
        "run",
        "epoch",
        "val_loss",
        "best_before",
        (F.col("val_loss") < F.col("best_before")).alias("improved"),
        F.least("best_before", "val_loss").alias("best_after"),
    )


def resolve_checkpoints(versions: DataFrame) -> DataFrame:
    """For each run of ``versions(run, epoch, val_loss, improved, ..)`` its latest checkpoint, the best one (the last
    strict improvement, whose file overwrote the earlier bests), "best, else latest", and that version's other columns
    as the struct ``version``."""
    version = F.struct(*[F.col(c) for c in versions.columns if c != "run"])
    best = F.when(F.col("improved"), F.col("epoch"))
    per = versions.groupBy("run").agg(
        F.max("epoch").alias("latest_epoch"),
        F.max(best).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.coalesce(F.max_by(version, best), F.max_by(version, "epoch")).alias("version"),
    )
    return per.select(
        "run",
        "latest_epoch",
        "best_epoch",
        "best_val_loss",
        F.coalesce("best_epoch", "latest_epoch").alias("resolved_epoch"),
        F.when(F.col("best_epoch").isNotNull(), F.lit("best")).otherwise(F.lit("latest")).alias("resolved_kind"),
        "version",
    )


def checkpoint_registry(epochs: DataFrame) -> DataFrame:
    """A8 without a table: what a registry of these epochs resolves to (``sources/checkpoints`` keeps one)."""
    return resolve_checkpoints(best_checkpoint(epochs)).drop("version")


def experiment_report(runs: DataFrame, report_epoch: int = REPORT_EPOCH) -> DataFrame:
    """Per run the ``report_epoch``-th row by epoch order, or the
    last row if there are fewer; PPL estimate = exp(val_loss) (inf >= 100)."""
    w = Window.partitionBy("run").orderBy("epoch")
    ranked = runs.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("run"))
    )
    chosen = ranked.where(F.col("_rn") == F.least(F.lit(report_epoch), F.col("_n")))
    return chosen.select(
        "run",
        "epoch",
        "train_loss",
        "val_loss",
        perplexity_of(F.col("val_loss")).alias("ppl"),
        F.format_string(
            "%-25s | %.4f     | %.4f     | %.2f",
            F.col("run"),
            F.col("train_loss"),
            F.col("val_loss"),
            perplexity_of(F.col("val_loss")),
        ).alias("line"),
    )


def epoch_lines(epochs: DataFrame) -> DataFrame:
    """The line that is printed after each epoch. A time of exactly half a tenth, as hundredths can be, is
    rounded up."""
    line = F.format_string(
        "Epoch %d | Time: %.1fs | Train Loss: %.4f | Val Loss: %.4f | LR: %.2e",
        "epoch",
        "epoch_time_sec",
        "train_loss",
        "val_loss",
        "learning_rate",
    )
    return epochs.select("run", "epoch", line.alias("line"))


def examples(hyps: DataFrame, refs: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` (reference, prediction) pairs by sentence id; the
    limit is the feature (a printed sample), taken after an ordered sort."""
    return refs.join(hyps, "sent_id").orderBy("sent_id").limit(n).select("sent_id", "ref", "hyp")


def loss_curves(epochs: DataFrame) -> DataFrame:
    """Wide epoch metrics -> long curves (run, epoch, curve, loss)."""
    return epochs.select("run", "epoch", "train_loss", "val_loss").unpivot(
        ["run", "epoch"], ["train_loss", "val_loss"], "curve", "loss"
    ).select("run", "epoch", F.regexp_replace("curve", "_loss$", "").alias("curve"), "loss")


def scalar_log(steps: DataFrame, epochs: DataFrame, accumulation_steps: int = 1) -> DataFrame:
    """Step and epoch scalars as a long (run, tag, step, value) table,
    like ``add_scalar(tag, value, step)``. Step scalars are logged on update
    steps only, at the global update counter."""
    a = accumulation_steps
    upd = steps.where(F.pmod(F.col("batch") + 1, F.lit(a)) == 0)
    if a != 1:
        # Update-step counter per run; a run can hold a large share of the
        # log, so dense positions (range partitions), not a per-run window.
        from bitext.operators.positions import dense_position

        upd = dense_position(upd, ["step"], group_cols=["run"], pos_col="_k").withColumn("step", F.col("_k") + 1)
    step_long = upd.select(
        "run",
        F.col("step").cast("long").alias("step"),
        F.col("loss").alias("Train/Loss_Step"),
        F.col("learning_rate").alias("Train/Learning_Rate"),
    ).unpivot(["run", "step"], ["Train/Loss_Step", "Train/Learning_Rate"], "tag", "value")
    epoch_long = epochs.select(
        "run",
        F.col("epoch").cast("long").alias("step"),
        F.col("train_loss").alias("Train/Loss_Epoch"),
        F.col("val_loss").alias("Val/Loss_Epoch"),
    ).unpivot(["run", "step"], ["Train/Loss_Epoch", "Val/Loss_Epoch"], "tag", "value")
    return step_long.unionByName(epoch_long).select("run", "tag", "step", "value")


def config_overlay(overrides: DataFrame, base: dict | None = None) -> DataFrame:
    """Each experiment row's non-null overrides replace the base value;
    override keys that the base lacks are kept as they are. The base is one
    literal row, so no join is needed: ``coalesce(col, lit)``."""
    base = dict(base or BASE_CONFIG)
    cols = [F.col("exp_name")]
    for key, value in base.items():
        if key in overrides.columns:
            cols.append(F.coalesce(F.col(key), F.lit(value)).alias(key))
        else:
            cols.append(F.lit(value).alias(key))
    extra = [F.col(c) for c in overrides.columns if c != "exp_name" and c not in base]
    return overrides.select(*cols, *extra)
