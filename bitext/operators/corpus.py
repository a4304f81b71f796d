"""Corpus preparation: filter, clean, shuffle, split, align, count.

Input is a pair table ``(pair_id, src, tgt)``. Every step is a column
expression or a partitioned operator; the only ordering work is the dense
position of the shuffled corpus, done with md5-prefix buckets (positions.py):
no sampled bounds, no materialisation, no single-task window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.functions.text import char_count, is_blank, py_strip, word_count
from bitext.operators.positions import MD5_BUCKET_DIGITS, bucketed_position, dense_position, md5_bucket

# --- Fixed values: the reference's defaults ---------------------------------
MIN_LEN = 4
MAX_LEN = 64
SANITY_SIZE = 100_000
MAIN_TRAIN_SIZE = 1_500_000
TEST_SIZE = 5_000
SEED = 42
SPLIT_SANITY, SPLIT_TEST, SPLIT_PRODUCTION = "sanity", "test", "production"
# ---------------------------------------------------------------------------


def pair_predicate(
    src: Column | str = "src",
    tgt: Column | str = "tgt",
    min_len: int = MIN_LEN,
    max_len: int = MAX_LEN,
) -> Column:
    """Both sides non-empty; both >= min_len characters; src <= max_len
    characters; tgt <= max_len whitespace words. Lengths on unstripped text."""
    s = F.col(src) if isinstance(src, str) else src
    t = F.col(tgt) if isinstance(tgt, str) else tgt
    present = s.isNotNull() & t.isNotNull() & (s != F.lit("")) & (t != F.lit(""))
    return F.coalesce(
        present
        & (char_count(s) >= min_len)
        & (char_count(t) >= min_len)
        & (char_count(s) <= max_len)
        & (word_count(t) <= max_len),
        F.lit(False),
    )


def filter_pairs(
    df: DataFrame,
    min_len: int = MIN_LEN,
    max_len: int = MAX_LEN,
    predicate: Callable[[Column, Column], Column] | Column | None = None,
    batch_predicate: Callable[[pa.RecordBatch], pa.Array] | None = None,
    batch_columns: Sequence[str] = ("src", "tgt"),
) -> DataFrame:
    """B1, with a user's own rule (J1) on top of the default one.

    ``predicate(src, tgt)`` returns a condition (a ready ``Column`` will do
    too); a row for which it is null goes. ``batch_predicate`` is for rules
    that no expression states: it gets Arrow batches of ``batch_columns``, of
    the rows that the other rules keep, and returns a boolean for each row;
    null drops the row.
    """
    cond = pair_predicate("src", "tgt", min_len, max_len)
    if predicate is not None:
        cond = cond & (predicate if isinstance(predicate, Column) else predicate(F.col("src"), F.col("tgt")))
    kept = df.where(cond)
    if batch_predicate is None:
        return kept

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(batch_predicate(batch.select(list(batch_columns))))

    return kept.mapInArrow(keep, kept.schema)


def clean_text(col: Column | str) -> Column:
    """H1/P2 + X10: newlines (and carriage returns) to spaces, then strip."""
    c = F.col(col) if isinstance(col, str) else col
    return py_strip(F.regexp_replace(c.cast("string"), "[\n\r]", " "))


def clean_pairs(df: DataFrame) -> DataFrame:
    """B2: clean both sides; drop the pair if either side is then empty."""
    out = df.withColumn("src", clean_text("src")).withColumn("tgt", clean_text("tgt"))
    return out.where((F.col("src") != "") & (F.col("tgt") != ""))


def ensure_not_empty(df: DataFrame, what: str = "filtered dataset") -> DataFrame:
    """Fail fast when a filter leaves nothing (one-row probe)."""
    if not df.limit(1).take(1):
        raise ValueError(f"{what} is empty; check the filter rule or MAX_LEN")
    return df


def shuffle_key(id_col: str = "pair_id", seed: int | str = SEED) -> Column:
    """a repeatable pseudo-random key, independent of partitioning."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def shuffled_positions(
    df: DataFrame, id_col: str = "pair_id", seed: int | str = SEED, num_partitions: int | None = None
) -> DataFrame:
    """F1 + E6: 0-based ``pos`` in seeded shuffle order and ``n_rows`` = N.
    The md5 key's hex prefix is a uniform, order-preserving bucket, so the
    positions need no sampled range bounds and no materialisation.
    ``num_partitions`` is kept for API compatibility (buckets decide)."""
    keyed = df.withColumn("_skey", shuffle_key(id_col, seed)).withColumn("_bkt", md5_bucket(F.col("_skey")))
    out = bucketed_position(
        keyed, ["_bkt"], ["_skey", id_col], pos_col="pos", count_col="n_rows", offsets_bound=16**MD5_BUCKET_DIGITS
    )
    return out.drop("_skey", "_bkt")


def epoch_order(df: DataFrame, epoch_col: str = "epoch", id_col: str = "pair_id", seed: int = SEED) -> DataFrame:
    """fresh shuffle per epoch = same key with the epoch in the salt; the
    rank is per epoch; md5-prefix buckets split every epoch over many tasks."""
    keyed = df.withColumn(
        "_skey",
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch_col).cast("string"), F.col(id_col).cast("string"))),
    ).withColumn("_bkt", md5_bucket(F.col("_skey")))
    out = bucketed_position(keyed, ["_bkt"], ["_skey", id_col], group_cols=[epoch_col], pos_col="pos")
    return out.drop("_skey", "_bkt")


def split_size(size: int | float, n_rows: Column) -> Column:
    """An absolute row count (the reference's form), or a fraction of N given
    as a float in (0, 1): ``floor(size * N)``."""
    if isinstance(size, float) and 0 < size < 1:
        return F.floor(F.lit(size) * n_rows).cast("long")
    return F.lit(int(size)).cast("long")


def split_membership(
    pos: Column,
    n_rows: Column,
    sanity_size: int | float = SANITY_SIZE,
    main_size: int | float = MAIN_TRAIN_SIZE,
    test_size: int | float = TEST_SIZE,
) -> Column:
    """Array of split names a position belongs to (sanity and test may
    overlap when N < sanity + test)."""
    s, m, t = (split_size(x, n_rows) for x in (sanity_size, main_size, test_size))
    test_start = F.greatest(F.lit(0), n_rows - t)
    remain_end = F.least(s + m, test_start)
    return F.filter(
        F.array(
            F.when(pos < F.least(s, n_rows), F.lit(SPLIT_SANITY)),
            F.when(pos >= test_start, F.lit(SPLIT_TEST)),
            F.when((pos >= s) & (pos < remain_end), F.lit(SPLIT_PRODUCTION)),
        ),
        lambda x: x.isNotNull(),
    )


def split_corpus(
    pairs: DataFrame,
    sanity_size: int | float = SANITY_SIZE,
    main_size: int | float = MAIN_TRAIN_SIZE,
    test_size: int | float = TEST_SIZE,
    seed: int = SEED,
    min_len: int = MIN_LEN,
    max_len: int = MAX_LEN,
    clean: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """L1: filter -> seeded shuffle -> position -> split rows -> clean.

    Sizes are row counts as in the reference, or fractions of the filtered
    row count N (floats in (0, 1)).

    One output row per (pair, split) membership:
    ``split, pos, pair_id, src, tgt``. Cleaning runs after the split ranges are
    taken, as in the reference, so a split can be smaller than its range.
    """
    filtered = filter_pairs(pairs, min_len, max_len)
    positioned = shuffled_positions(filtered, seed=seed, num_partitions=num_partitions)
    rows = positioned.withColumn(
        "split",
        F.explode(split_membership(F.col("pos"), F.col("n_rows"), sanity_size, main_size, test_size)),
    ).select("split", "pos", "pair_id", "src", "tgt")
    return clean_pairs(rows) if clean else rows


def corpus_stats(pairs: DataFrame, splits: DataFrame, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> DataFrame:
    """Original and filtered counts plus the rows kept per split, as one
    long table ``(stage, n)``; a single pass for the first two."""
    totals = pairs.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(pair_predicate("src", "tgt", min_len, max_len)).alias("filtered"),
    )
    head = totals.select(F.expr("stack(2, 'original', original, 'filtered', filtered) as (stage, n)"))
    per_split = splits.groupBy(F.concat(F.lit("split:"), F.col("split")).alias("stage")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return head.unionByName(per_split).select("stage", F.col("n").cast("long").alias("n"))


def align_pairs(src_lines: DataFrame, tgt_lines: DataFrame, mode: str = "pair") -> DataFrame:
    """Pair two line tables ``(line_no, text)`` by position.

    ``mode="pair"`` (default) drops a pair when either side is blank, keeping
    the others aligned. ``mode="compact"`` is the reference behaviour (X1):
    blanks are removed from each side independently, both sides re-numbered,
    then zipped up to the shorter side.
    """
    if mode == "pair":
        s = src_lines.select("line_no", py_strip("text").alias("src"))
        t = tgt_lines.select("line_no", py_strip("text").alias("tgt"))
        return s.join(t, "line_no").where((F.col("src") != "") & (F.col("tgt") != ""))
    if mode != "compact":
        raise ValueError(f"unknown align mode {mode!r}")
    s = dense_position(
        src_lines.where(~is_blank("text")), ["line_no"], pos_col="k"
    ).select("k", py_strip("text").alias("src"))
    t = dense_position(
        tgt_lines.where(~is_blank("text")), ["line_no"], pos_col="k"
    ).select("k", py_strip("text").alias("tgt"))
    return s.join(t, "k").withColumnRenamed("k", "line_no")
