"""Corpus scan and sink (A1, B3, B5): a pair dataset on disk <-> ``(pair_id, src, tgt)``.

The dataset is Parquet or JSON lines, in one folder or with a folder for each
split (``split=<name>``), of which a read prunes all but one. Columns are found
at run time and renamed (``text_zh``/``text_en`` by default). Without an id
column, the pair id is the row's position in file order; no text is shuffled
for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bitext.operators.positions import file_position

SRC_COL, TGT_COL = "text_zh", "text_en"


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    src_col: str = SRC_COL,
    tgt_col: str = TGT_COL,
    split: str | None = "train",
    id_col: str | None = None,
) -> DataFrame:
    """``split`` chooses rows if the dataset has a split column, which may be its folders'; a dataset without one is read
    whole. Fails with the columns it found if one that it needs is absent."""
    df = spark.read.format(fmt).load(path)
    absent = [c for c in (src_col, tgt_col, id_col) if c and c not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}; columns found: {', '.join(df.columns)}")
    if split is not None and "split" in df.columns:
        df = df.where(F.col("split") == split)
    pair = [F.col(src_col).cast("string").alias("src"), F.col(tgt_col).cast("string").alias("tgt")]
    if id_col is not None:
        return df.select(F.col(id_col).cast("long").alias("pair_id"), *pair)
    rows = df.select(
        *pair,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return file_position(rows, pos_col="pair_id").select("pair_id", "src", "tgt")


def write_corpus(pairs: DataFrame, path: str, src_col: str = SRC_COL, tgt_col: str = TGT_COL) -> int:
    """Write ``pairs(split, pair_id, src, tgt)`` as a dataset with a folder for each split, rows in the order of
    ``pair_id``, and return their number (D1), which the write itself counts.

    Fails if there is none (B5). An earlier dataset at ``path`` is replaced, but not by an empty one: rows are written
    beside it first, and an empty result fails before it is moved there."""
    spark = pairs.sparkSession
    seen = Observation()
    rows = pairs.select("split", "pair_id", F.col("src").alias(src_col), F.col("tgt").alias(tgt_col))
    ordered = rows.repartitionByRange("split", "pair_id").sortWithinPartitions("split", "pair_id").drop("pair_id")
    fresh = path.rstrip("/") + "._new"
    ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("split").parquet(fresh)
    if not seen.get["n"]:
        raise ValueError("filtered dataset is empty; check the filter rule or MAX_LEN")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = jvm.Path(path), jvm.Path(fresh)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot move {fresh} to {path}")
    return seen.get["n"]
