"""Driver queries for sources and sinks (section 2.A): text and CSV round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.operators import runs as R
from bitext.operators.positions import dense_position
from bitext.plans import fixtures as fx
from bitext.plans import q_corpus, q_runs
from bitext.plans import sql_fixtures as S
from bitext.session import scratch_path
from bitext.sources import logs as L
from bitext.sources import text_files as TF

RESTART_EPOCH = 16  # runs are logged twice: a first attempt up to epoch 15, then a restart


def _written_text(spark, sf_dir):
    splits = q_corpus.split_corpus(spark, sf_dir)
    base = scratch_path(spark, "parallel-text")
    TF.write_parallel_text(splits, base)
    return splits, base


def parallel_text_scan(spark, sf_dir):
    _, base = _written_text(spark, sf_dir)
    return TF.read_parallel_text(spark, base)


def parallel_text_roundtrip(spark, sf_dir):
    """Each source row meets its line: rank of pos within the split = line_no."""
    splits, base = _written_text(spark, sf_dir)
    back = TF.read_parallel_text(spark, base)
    # Rank of pos within its split (a split is up to half the corpus, so no
    # window partitioned by split): range-partitioned dense positions.
    ranked = dense_position(splits, ["pos"], group_cols=["split"], pos_col="line_no")
    j = ranked.alias("a").join(back.alias("b"), ["split", "line_no"], "full")
    return j.select(
        "split",
        "line_no",
        F.col("a.pos").alias("pos"),
        (F.col("a.src") == F.col("b.src")).alias("src_equal"),
        (F.col("a.tgt") == F.col("b.tgt")).alias("tgt_equal"),
    )


def _logged_runs(spark, sf_dir):
    """Epoch rows for two attempts per run: the first attempt (directory
    stamped at the run's first step) up to RESTART_EPOCH-1, and the restart
    (stamped at the first step of RESTART_EPOCH) with all epochs."""
    steps = fx.step_log(spark, sf_dir)
    epochs = R.epoch_summary(steps)
    starts = steps.groupBy("run").agg(
        F.min("ts").alias("t_first"),
        F.min(F.when(F.col("epoch") == RESTART_EPOCH, F.col("ts"))).alias("t_restart"),
    )
    model = F.concat(F.lit("tf_sanity_"), F.col("run"))
    e = epochs.join(starts, "run")
    first = e.where(F.col("epoch") < RESTART_EPOCH).withColumn("run_dir", L.run_dir_name(model, F.col("t_first")))
    second = e.withColumn("run_dir", L.run_dir_name(model, F.col("t_restart")))
    return first.unionByName(second)


def _written_runs(spark, sf_dir):
    base = scratch_path(spark, "runs")
    L.write_metrics_csv(_logged_runs(spark, sf_dir), base)
    return base


def _r6(df):
    return df.select(
        *[
            F.round(c, 6).alias(c) if c in ("train_loss", "val_loss", "learning_rate", "ppl") else F.col(c)
            for c in df.columns
        ]
    )


def metrics_csv_roundtrip(spark, sf_dir):
    return _r6(L.scan_runs(spark, _written_runs(spark, sf_dir), latest_only=False))


def runs_scan(spark, sf_dir):
    return _r6(L.scan_runs(spark, _written_runs(spark, sf_dir)))


def experiment_report(spark, sf_dir):
    runs = L.scan_runs(spark, _written_runs(spark, sf_dir))
    return _r6(R.experiment_report(runs))


def prediction_examples(spark, sf_dir):
    """The first three references and predictions; the limit is the feature."""
    return R.examples(fx.hyps(spark, sf_dir), fx.refs(spark, sf_dir))


QUERIES = {
    "parallel_text_scan": parallel_text_scan,
    "parallel_text_roundtrip": parallel_text_roundtrip,
    "metrics_csv_roundtrip": metrics_csv_roundtrip,
    "runs_scan": runs_scan,
    "experiment_report": experiment_report,
    "prediction_examples": prediction_examples,
}

RUNS_CTE = (
    q_runs.EPOCHS_CTE
    + f""",
starts AS (SELECT run, min(ts) AS t_first, min(ts) FILTER (WHERE epoch = {RESTART_EPOCH}) AS t_restart
           FROM step_log GROUP BY run),
logged AS (
  SELECT e.*, 'tf_sanity_' || e.run || '_' || strftime(t_first, '%Y%m%d_%H%M%S') AS run_dir
  FROM epochs e JOIN starts USING (run) WHERE e.epoch < {RESTART_EPOCH}
  UNION ALL
  SELECT e.*, 'tf_sanity_' || e.run || '_' || strftime(t_restart, '%Y%m%d_%H%M%S') AS run_dir
  FROM epochs e JOIN starts USING (run)),
named AS (
  SELECT *, CASE WHEN len(string_split(run_dir, '_')) > 3
                 THEN array_to_string(string_split(run_dir, '_')[2:len(string_split(run_dir, '_')) - 2], '_')
                 ELSE run_dir END AS rname FROM logged),
latest2 AS (SELECT * FROM named QUALIFY run_dir = max(run_dir) OVER (PARTITION BY rname))"""
)

RUN_COLS = """rname AS run, run_dir, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
  round(learning_rate, 6) AS learning_rate, epoch_time_sec"""

SPLITS = S.with_(S.LINE_PAIRS) + q_corpus.SPLIT_CTE

ORACLE = {
    "parallel_text_scan": SPLITS
    + """ SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY pos) - 1 AS BIGINT) AS line_no,
    src, tgt FROM splits""",
    "parallel_text_roundtrip": SPLITS
    + """ SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY pos) - 1 AS BIGINT) AS line_no, pos,
    true AS src_equal, true AS tgt_equal FROM splits""",
    "metrics_csv_roundtrip": S.with_(RUNS_CTE) + f" SELECT {RUN_COLS} FROM named",
    "runs_scan": S.with_(RUNS_CTE) + f" SELECT {RUN_COLS} FROM latest2",
    "experiment_report": S.with_(RUNS_CTE)
    + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY epoch) AS rn,
                      count(*) OVER (PARTITION BY rname) AS n FROM latest2)
    SELECT rname AS run, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
           round(CASE WHEN val_loss < 100 THEN exp(val_loss) ELSE 'infinity'::DOUBLE END, 6) AS ppl,
           printf('%-25s | %.4f     | %.4f     | %.2f', rname, train_loss, val_loss,
                  CASE WHEN val_loss < 100 THEN exp(val_loss) ELSE 'infinity'::DOUBLE END) AS line
    FROM ranked WHERE rn = least(10, n)""",
    "prediction_examples": S.with_(S.LINE_PAIRS)
    + f""" SELECT pair_id AS sent_id, tgt AS ref,
           array_to_string(list_filter(string_split(tgt, ' '), lambda x, i: i % 7 <> 0), ' ') AS hyp
    FROM line_pairs WHERE {S.strip('src')} <> '' ORDER BY pair_id LIMIT 3""",
}
