"""Structured Streaming forms of the incremental operators.

* ``stream_epoch_rollup``  metric log arriving as files -> per (run, epoch)
  roll-up, update mode, each micro-batch writes the rows that it changed.
* ``stream_pairs``         sentence pairs arriving as files -> pair filter +
  clean, stateless, append mode.
* ``stream_translate``     requests arriving as files -> ``foreachBatch`` runs
  the request filter and the beam decoder on each micro-batch.

Sources are file streams (``readStream`` over a directory or glob); sinks are
Parquet tables; checkpoints live in the shared checkpoint folder. Queries run
with ``trigger(availableNow=True)``, so a call processes what has arrived and
stops, and a restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.operators.corpus import clean_pairs, filter_pairs
from bitext.operators.runs import QUIT_WORDS, filter_requests
from bitext.session import scratch_path

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _run(query_builder, spark: SparkSession, name: str):
    ckpt = scratch_path(spark, f"stream-{name}-ckpt")
    q = query_builder.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def stream_epoch_rollup(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Events as a training log; per (run, epoch) batches, mean loss and
    tokens. Update mode: a micro-batch hands the sink only the (run, epoch)
    rows that its events changed."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    agg = reader.parquet(source).groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg(F.log(F.col("value") / 100.0 + 1.0)).alias("train_loss"),
        F.sum(F.col("user_id") + 1).alias("n_tokens"),
    )
    out = scratch_path(spark, "stream-rollup")
    _run(agg.writeStream.outputMode("update").foreachBatch(changes_sink(out)), spark, "rollup")
    return read_changes(spark, out, ["run", "epoch"])


def changes_sink(out: str):
    """A sink for update mode: a batch's rows go to ``batch=<id>`` with overwrite, so a replayed batch leaves the same
    rows, and no batch reads or rewrites what others wrote."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return sink


def read_changes(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The table that :func:`changes_sink` keeps: each key's row as the last batch that changed it wrote it."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def stream_pairs(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Pair rows (pair_id, src, tgt) arrive as files; the batch filter and
    cleaning expressions apply to each as it is. Stateless; append mode to a
    Parquet sink, exactly once."""
    reader = spark.readStream.schema("pair_id long, src string, tgt string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out_df = clean_pairs(filter_pairs(reader.parquet(source)))
    out = scratch_path(spark, "stream-pairs")
    _run(out_df.writeStream.outputMode("append").format("parquet").option("path", out), spark, "pairs")
    return spark.read.parquet(out)


def stream_translate(
    spark: SparkSession,
    source: str,
    translate: Callable[[DataFrame], DataFrame],
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Requests (session_id, request_id, text) arrive; each micro-batch is
    filtered (a quit word ends its session, blanks are skipped) and handed to
    ``translate`` (a batch function, so it may join and iterate), whose output
    is appended. Sessions ended by a quit word are kept in a table next to the
    output, so a quit also drops that session's requests in later batches."""
    schema = "session_id long, request_id long, text string"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    req = reader.parquet(source)
    out = scratch_path(spark, "stream-translate")
    _run(req.writeStream.foreachBatch(translate_sink(spark, out, translate)), spark, "translate")
    return spark.read.parquet(out).drop("batch")


def translate_sink(spark: SparkSession, out: str, translate: Callable[[DataFrame], DataFrame]):
    """The sink of :func:`stream_translate`. A batch writes its rows and the
    sessions it ends under ``batch=<id>`` with overwrite, and reads the ended
    sessions of earlier batches only, so a replayed batch leaves the same rows."""
    ended_path = f"{out}-ended"
    spark.createDataFrame([], "session_id long").write.mode("overwrite").parquet(f"{ended_path}/batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        ended = spark.read.parquet(ended_path).where(F.col("batch") < batch_id).select("session_id")
        live = batch.join(ended, "session_id", "left_anti")
        translate(filter_requests(live)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        quits = live.where(F.lower("text").isin(*QUIT_WORDS)).select("session_id").distinct()
        quits.write.mode("overwrite").parquet(f"{ended_path}/batch={batch_id}")
        batch.unpersist()

    return sink
