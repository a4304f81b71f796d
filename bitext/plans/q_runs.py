"""Driver queries over training-run logs (sections 2.A, 2.B, 2.D, 2.E, 2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.operators import runs as R
from bitext.plans import fixtures as fx
from bitext.plans import sql_fixtures as S
from bitext.session import cut_lineage, scratch_path
from bitext.sources import checkpoints as K
from bitext.sources import logs as L

ACCUM = 3  # accumulation steps for the roll-up query (does not divide all epochs)
VAL_BATCH = 8  # validation batch size for the batch-mean query


def r6(c):
    return F.round(c, 6)


def _epochs(spark, sf_dir):
    return R.epoch_summary(fx.step_log(spark, sf_dir))


def epoch_summary(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    return e.select(
        "run",
        "epoch",
        "n_batches",
        r6("train_loss").alias("train_loss"),
        r6("val_loss").alias("val_loss"),
        r6("learning_rate").alias("learning_rate"),
        "epoch_time_sec",
    )


def train_loss_rollup(spark, sf_dir):
    t = R.train_loss_rollup(fx.step_log(spark, sf_dir), ACCUM)
    return t.select("run", "epoch", "n_batches", "n_updates", "global_step", r6("train_loss").alias("train_loss"))


def val_loss_batch_mean(spark, sf_dir):
    samples = fx.step_log(spark, sf_dir).withColumnRenamed("batch", "pos")
    v = R.val_loss_batch_mean(samples, VAL_BATCH)
    return v.select("run", "epoch", r6("val_loss").alias("val_loss"), "n_batches")


def best_checkpoint(spark, sf_dir):
    b = R.best_checkpoint(_epochs(spark, sf_dir))
    return b.select(
        "run",
        "epoch",
        r6("val_loss").alias("val_loss"),
        r6("best_before").alias("best_before"),
        "improved",
        r6("best_after").alias("best_after"),
    )


RESTART_EPOCH = 16  # training stops here and starts again, which saves the epochs from here on once more


def checkpoint_registry(spark, sf_dir):
    """Training saves a version of each epoch in two commits: all epochs, and those from RESTART_EPOCH on again by a
    restarted run, whose accumulation counts other steps. A failed job's second commit is written twice."""
    steps = fx.step_log(spark, sf_dir)
    epochs, configs = cut_lineage(R.epoch_summary(steps)), _overlay(spark, sf_dir)
    path = scratch_path(spark, "registry")
    first = K.checkpoint_versions(epochs, R.train_loss_rollup(steps, 1), configs)
    K.write_versions(first, path, 0)
    again = K.checkpoint_versions(epochs, R.train_loss_rollup(steps, ACCUM), configs).where(F.col("epoch") >= RESTART_EPOCH)
    for _ in range(2):
        K.write_versions(again, path, 1)
    out = K.resolve(spark, path)
    return out.select(
        "run", "latest_epoch", "best_epoch", r6("best_val_loss").alias("best_val_loss"), "resolved_epoch", "resolved_kind",
        "resolved_step", r6("resolved_best_before").alias("resolved_best_before"), "resolved_commit",
        F.col("config")["num_epochs"].cast("int").alias("num_epochs"),
        F.col("config")["batch_size"].cast("long").alias("batch_size"),
        F.col("config")["lr"].cast("double").alias("lr"),
        F.size("config").alias("n_config"),
    )


def epoch_lines(spark, sf_dir):
    return R.epoch_lines(_epochs(spark, sf_dir))


def loss_curves(spark, sf_dir):
    c = R.loss_curves(_epochs(spark, sf_dir))
    return c.select("run", "epoch", "curve", r6("loss").alias("loss"))


def scalar_log(spark, sf_dir):
    steps = fx.step_log(spark, sf_dir)
    path = scratch_path(spark, "scalars")
    L.write_scalars(R.scalar_log(steps, R.epoch_summary(steps)), path)
    s = spark.read.parquet(path)
    return s.select("run", "tag", "step", r6("value").alias("value"))


def _overlay(spark, sf_dir):
    """Each run is an experiment whose logged shape overrides the base:
    epochs run, largest epoch (batches), final learning rate."""
    e = _epochs(spark, sf_dir)
    over = e.groupBy(F.col("run").alias("exp_name")).agg(
        F.count(F.lit(1)).alias("num_epochs"),
        F.max("n_batches").alias("batch_size"),
        F.max_by("learning_rate", "epoch").alias("lr"),
        F.lit(None).cast("double").alias("dropout"),
        F.lit(None).cast("int").alias("n_layers"),
        F.sum("n_batches").alias("total_steps"),
    )
    return R.config_overlay(over).withColumn("lr", r6("lr"))


def config_overlay(spark, sf_dir):
    return _overlay(spark, sf_dir)


QUERIES = {
    "epoch_summary": epoch_summary,
    "train_loss_rollup": train_loss_rollup,
    "val_loss_batch_mean": val_loss_batch_mean,
    "best_checkpoint": best_checkpoint,
    "checkpoint_registry": checkpoint_registry,
    "epoch_lines": epoch_lines,
    "loss_curves": loss_curves,
    "scalar_log": scalar_log,
    "config_overlay": config_overlay,
}

EPOCHS_CTE = (
    S.STEP_LOG
    + """,
per AS (SELECT run, epoch, count(*) AS n_batches, avg(loss) AS train_loss,
               arg_max(learning_rate, batch) AS learning_rate, min(ts) AS t0, max(ts) AS t1
        FROM step_log GROUP BY run, epoch),
val AS (SELECT s.run, s.epoch, avg(s.loss) AS val_loss FROM step_log s JOIN per USING (run, epoch)
        WHERE s.batch >= per.n_batches * 0.75 GROUP BY s.run, s.epoch),
epochs AS (SELECT run, epoch, n_batches, train_loss, val_loss, learning_rate,
                  floor((date_diff('microsecond', t0, t1) + 5000) / 10000) / 100.0 AS epoch_time_sec
           FROM per LEFT JOIN val USING (run, epoch))"""
)
WE = S.with_(EPOCHS_CTE)
BEST_CTE = """,
best AS (SELECT run, epoch, val_loss,
                coalesce(min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                         'infinity'::DOUBLE) AS best_before FROM epochs)"""

ORACLE = {
    "epoch_summary": WE
    + """ SELECT run, epoch, n_batches, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
    round(learning_rate, 6) AS learning_rate, epoch_time_sec FROM epochs""",
    "train_loss_rollup": S.with_(S.STEP_LOG)
    + f""",
    per AS (SELECT run, epoch, count(*) AS n_batches, count(*) FILTER (WHERE (batch + 1) % {ACCUM} = 0) AS n_updates,
                   sum(CASE WHEN (batch + 1) % {ACCUM} = 0 THEN loss ELSE 0.0 END) AS s
            FROM step_log GROUP BY run, epoch)
    SELECT run, epoch, n_batches, n_updates,
           CAST(sum(n_updates) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
             AS global_step,
           round(s / (n_batches / {float(ACCUM)}), 6) AS train_loss FROM per""",
    "val_loss_batch_mean": S.with_(S.STEP_LOG)
    + f""",
    b AS (SELECT run, epoch, floor(batch / {VAL_BATCH}) AS vb, avg(loss) AS m FROM step_log GROUP BY 1, 2, 3)
    SELECT run, epoch, round(avg(m), 6) AS val_loss, count(*) AS n_batches FROM b GROUP BY run, epoch""",
    "best_checkpoint": WE
    + BEST_CTE
    + """ SELECT run, epoch, round(val_loss, 6) AS val_loss, round(best_before, 6) AS best_before,
    val_loss < best_before AS improved, round(least(best_before, val_loss), 6) AS best_after FROM best""",
    "checkpoint_registry": WE
    + BEST_CTE
    + f""",
    ups AS (SELECT run, epoch, count(*) AS u1, count(*) FILTER (WHERE (batch + 1) % {ACCUM} = 0) AS u2
            FROM step_log GROUP BY run, epoch),
    gs AS (SELECT run, epoch, CAST(sum(u1) OVER w AS BIGINT) AS g1, CAST(sum(u2) OVER w AS BIGINT) AS g2 FROM ups
           WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    per_run AS (SELECT run, max(epoch) AS latest_epoch, max(epoch) FILTER (WHERE val_loss < best_before) AS best_epoch,
                       round(min(val_loss), 6) AS best_val_loss FROM best GROUP BY run),
    cfg AS (SELECT run, CAST(count(*) AS INTEGER) AS num_epochs, CAST(max(n_batches) AS BIGINT) AS batch_size,
                   round(arg_max(learning_rate, epoch), 6) AS lr FROM epochs GROUP BY run)
    SELECT p.run, latest_epoch, best_epoch, best_val_loss, b.epoch AS resolved_epoch,
           CASE WHEN best_epoch IS NOT NULL THEN 'best' ELSE 'latest' END AS resolved_kind,
           CASE WHEN b.epoch >= {RESTART_EPOCH} THEN g2 ELSE g1 END AS resolved_step,
           round(b.best_before, 6) AS resolved_best_before,
           CAST(CASE WHEN b.epoch >= {RESTART_EPOCH} THEN 1 ELSE 0 END AS BIGINT) AS resolved_commit,
           num_epochs, batch_size, lr, CAST(14 AS INTEGER) AS n_config
    FROM per_run p JOIN best b ON b.run = p.run AND b.epoch = coalesce(p.best_epoch, p.latest_epoch)
    JOIN gs ON gs.run = b.run AND gs.epoch = b.epoch JOIN cfg ON cfg.run = p.run""",
    "epoch_lines": WE
    + """ SELECT run, epoch, printf('Epoch %d | Time: %.1fs | Train Loss: %.4f | Val Loss: %.4f | LR: %.2e', epoch,
    CAST(round(CAST(epoch_time_sec AS DECIMAL(18, 2)), 1) AS DOUBLE), train_loss, val_loss, learning_rate) AS line FROM epochs""",
    "loss_curves": WE
    + """ SELECT run, epoch, 'train' AS curve, round(train_loss, 6) AS loss FROM epochs
    UNION ALL SELECT run, epoch, 'val', round(val_loss, 6) FROM epochs""",
    "scalar_log": WE
    + """ SELECT run, 'Train/Loss_Step' AS tag, step, round(loss, 6) AS value FROM step_log
    UNION ALL SELECT run, 'Train/Learning_Rate', step, round(learning_rate, 6) FROM step_log
    UNION ALL SELECT run, 'Train/Loss_Epoch', CAST(epoch AS BIGINT), round(train_loss, 6) FROM epochs
    UNION ALL SELECT run, 'Val/Loss_Epoch', CAST(epoch AS BIGINT), round(val_loss, 6) FROM epochs""",
    "config_overlay": WE
    + """ SELECT run AS exp_name, CAST(max(n_batches) AS BIGINT) AS batch_size, 1 AS accumulation_steps,
    CAST(count(*) AS BIGINT) AS num_epochs, 32000 AS vocab_size, 128 AS max_len, 512 AS d_model, 6 AS n_layers, 8 AS n_heads,
    2048 AS d_ff, 0.3::DOUBLE AS dropout, round(arg_max(learning_rate, epoch), 6) AS lr, 1e-4 AS weight_decay,
    0.1::DOUBLE AS label_smoothing, CAST(sum(n_batches) AS BIGINT) AS total_steps FROM epochs GROUP BY run""",
}
