"""Derived views over the driver tables (FIXTURES.md section 3).

Each view reads the given parquet tables, so its work grows with them:

* ``line_pairs(pair_id, src, tgt)``  user turn x next assistant turn, line i
  with line i up to the shorter side.
* ``mono(line_id, text)``            document lines.
* ``refs(sent_id, ref)`` / ``hyps(sent_id, hyp)``  metric input: the reference
  is the target line; the prediction drops every 7th word; no prediction for
  a pair whose source line is blank.
* ``step_log(run, epoch, batch, step, loss, n_tokens, learning_rate, ts)``;
  loss = ln(1 + value/100), a cross-entropy-like positive value.
* ``requests(session_id, request_id, text)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitext.functions.text import is_blank
from bitext.operators.positions import broadcast_if_small, dense_position
from bitext.session import read_table, spread

# Multipliers of composite ids: 16 bits each for turn and line of a pair, 31
# for a document's line. A row beyond them fails instead of sharing an id.
PAIR_CONV, PAIR_TURN = 1 << 32, 1 << 16
MONO_DOC = 1 << 31


def pair_id(conv="conv_id", turn="turn", line="line"):
    conv, turn, line = F.col(conv), F.col(turn), F.col(line)
    fits = turn.between(0, PAIR_TURN - 1) & line.between(0, PAIR_TURN - 1) & conv.between(0, (1 << 31) - 1)
    beyond = F.raise_error(F.lit("conversation, turn or line number is too large for a pair id"))
    return F.when(fits, conv * PAIR_CONV + turn * PAIR_TURN + line).otherwise(beyond.cast("long"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.split("text", "\n", -1).alias("s")
    )
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", "\n", -1).alias("t")
    )
    zipped = user.join(asst, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.posexplode(F.arrays_zip("s", "t")).alias("line", "z")
    )
    return zipped.where(F.col("z.s").isNotNull() & F.col("z.t").isNotNull()).select(
        pair_id().alias("pair_id"),
        F.col("z.s").alias("src"),
        F.col("z.t").alias("tgt"),
    )


def mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select(
        (F.col("doc_id") * MONO_DOC + F.col("pos")).alias("line_id"), "text"
    )


def vocab_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: both sides of the pairs plus the monolingual lines, one text column."""
    # Both sides in one pass over the pairs (one self-join evaluation).
    sides = line_pairs(spark, sf_dir).select(F.explode(F.array("src", "tgt")).alias("text"))
    return sides.unionAll(mono(spark, sf_dir).select("text"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pairs(spark, sf_dir).select(F.col("pair_id").alias("sent_id"), F.col("tgt").alias("ref"))


def hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = line_pairs(spark, sf_dir).where(~is_blank("src"))
    kept = F.filter(F.split("tgt", " ", -1), lambda x, i: (i + 1) % 7 != 0)
    return lp.select(F.col("pair_id").alias("sent_id"), F.array_join(kept, " ").alias("hyp"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log: one row per batch. ``batch`` is 0-based within
    (run, epoch) by (ts, event_id); ``step`` is 1-based within the run."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        "ts",
        "event_id",
        F.log(F.col("value") / 100.0 + 1.0).alias("loss"),
        (F.col("user_id") + 1).alias("n_tokens"),
        ((F.col("user_id") + 1) * F.lit(1e-6)).alias("learning_rate"),
    )
    pos = dense_position(
        ev, ["ts", "event_id"], group_cols=["run", "epoch"], pos_col="batch", count_col="n_batches"
    )
    per_epoch = pos.groupBy("run", "epoch").agg(F.first("n_batches").alias("n_batches"))
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_epoch.select(
        "run", "epoch", F.coalesce(F.sum("n_batches").over(w), F.lit(0)).alias("_before")
    )
    offsets = broadcast_if_small(offsets)
    return pos.join(offsets, ["run", "epoch"]).select(
        "run",
        "epoch",
        "batch",
        (F.col("_before") + F.col("batch") + 1).alias("step"),
        "loss",
        "n_tokens",
        "learning_rate",
        "ts",
        "event_id",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as interactive requests, one session per conversation, plus
    one session exercising a blank line and a quit word."""
    conv = read_table(spark, sf_dir, "conversations")
    users = conv.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("request_id"), "text"
    )
    extra = spark.createDataFrame(
        [(-1, 0, "  "), (-1, 1, "Exit"), (-1, 2, "after quit"), (-2, 0, "q"), (-3, 0, " Hello ")],
        "session_id long, request_id long, text string",
    )
    return users.unionByName(extra)
