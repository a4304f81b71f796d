"""Token sequences: template, truncation, batching, padding, masks, shifting,
detokenising and n-gram blocking. All array higher-order functions, no UDF.

Padding happens only in the batch output (late padding); sequences stay
ragged ``array<int>`` elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.text import EOS_ID, PAD_ID, SOS_ID

MAX_LEN = 128
BATCH_SIZE = 96
NGRAM = 3


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def with_template(ids: Column | str, sos: int = SOS_ID, eos: int = EOS_ID) -> Column:
    """H5: ``[SOS] $A [EOS]``."""
    return F.concat(F.array(F.lit(sos)), _c(ids), F.array(F.lit(eos)))


def with_pair_template(a: Column | str, b: Column | str, sos: int = SOS_ID, eos: int = EOS_ID) -> Column:
    """H5 pair form ``[SOS] A [EOS] [SOS] B [EOS]``."""
    return F.concat(with_template(a, sos, eos), with_template(b, sos, eos))


def truncate(ids: Column | str, max_len: int = MAX_LEN) -> Column:
    """``ids[:max_len]`` (after the template, so [EOS] may be lost)."""
    return F.slice(_c(ids), 1, max_len)


def assign_batches(df: DataFrame, pos_col: str = "pos", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive ``batch_size`` positions form a batch; the last short
    batch is kept."""
    return df.withColumn("batch_id", F.floor(F.col(pos_col) / batch_size))


def pad_to(ids: Column, width: Column, pad: int = PAD_ID) -> Column:
    """H6: right-pad to ``width``."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def pad_batches(df: DataFrame, batch_col: str = "batch_id", pad: int = PAD_ID) -> DataFrame:
    """Pad ``src_ids`` and ``tgt_ids`` to the longest sequence of
    their side in the batch; ``attention_mask`` = src token != pad (by value);
    ``src_pad_mask`` / ``tgt_pad_mask`` = token == pad (opposite polarity).

    The window is partitioned by batch, so each partition holds at most
    ``batch_size`` rows."""
    w = Window.partitionBy(batch_col)
    out = df.withColumn("_ws", F.max(F.size("src_ids")).over(w)).withColumn("_wt", F.max(F.size("tgt_ids")).over(w))
    out = out.withColumn("src_ids", pad_to(F.col("src_ids"), F.col("_ws"), pad)).withColumn(
        "tgt_ids", pad_to(F.col("tgt_ids"), F.col("_wt"), pad)
    )
    return out.drop("_ws", "_wt").withColumns(
        {
            "attention_mask": F.transform("src_ids", lambda x: x != F.lit(pad)),
            "src_pad_mask": F.transform("src_ids", lambda x: x == F.lit(pad)),
            "tgt_pad_mask": F.transform("tgt_ids", lambda x: x == F.lit(pad)),
        }
    )


def shift_targets(tgt: Column | str) -> tuple[Column, Column]:
    """Teacher forcing, ``tgt[:-1]`` as decoder input, ``tgt[1:]`` as
    labels."""
    t = _c(tgt)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.slice(t, 1, n), F.slice(t, 2, n)


def strip_ids(ids: Column | str, drop: tuple[int, ...] = (SOS_ID, EOS_ID, PAD_ID)) -> Column:
    """Remove special ids (``filter``, never ``array_except``, which would
    also drop repeated tokens)."""
    return F.filter(_c(ids), lambda x: ~x.isin(*drop))


def tighten(text: Column) -> Column:
    """P12, inference variant: no space before a full stop or a comma."""
    return F.replace(F.replace(text, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))


def detokenize(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, variant: str = "evaluate") -> DataFrame:
    """Ids -> tokens by an inner join on the vocabulary (ids with no
    token are dropped), order kept by position, joined by spaces, then
    ``" ##"`` removed; the ``inference`` variant also tightens ``" ."`` and
    ``" ,"``. The vocabulary is bounded by ``vocab_size`` -> broadcast."""
    exploded = (
        df.select(key, ids_col)
        .repartition(key)
        .select(key, F.posexplode_outer(strip_ids(ids_col)).alias("_pos", "_id"))
    )
    # Left join + null filter inside collect_list = inner-join semantics while
    # every input row (key unique) keeps its output row; the regroup reuses
    # the key partitioning.
    toks = exploded.join(
        F.broadcast(vocab.select(F.col("id").alias("_id"), F.col("token").alias("_tok"))), "_id", "left"
    )
    grouped = toks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_tok").isNotNull(), F.struct("_pos", "_tok"))))
        .getField("_tok")
        .alias("_t")
    )
    text = F.replace(F.array_join("_t", " "), F.lit(" ##"), F.lit(""))
    if variant == "inference":
        text = tighten(text)
    return grouped.select(key, text.alias("text"))


def blocked_next(ids: Column | str, n: int = NGRAM) -> Column:
    """Tokens forbidden as the next token because the current last
    n-1 tokens occurred earlier followed by them. Empty if len < n. Sorted,
    distinct (a set of logits set to -inf)."""
    s = _c(ids)
    size = F.size(s)
    ctx = F.slice(s, F.greatest(size - (n - 2), F.lit(1)), n - 1)
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    hits = F.filter(starts, lambda i: F.slice(s, i, n - 1) == ctx)
    forb = F.transform(hits, lambda i: F.element_at(s, i + n - 1))
    return F.when(size >= n, F.array_sort(F.array_distinct(forb))).otherwise(F.array().cast("array<int>"))
