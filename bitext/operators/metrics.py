"""Corpus metrics: BLEU (13a, exp smoothing), chrF (beta 2, char 1-6),
token-weighted loss / perplexity, label-smoothed NLL.

Every metric is n-gram statistics per sentence (texts meet by sentence, so no
key is hot, and n-grams are counted in Arrow batches) summed into one row, and
a closed formula on that row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.functions.text import remove_ws, tokenize_13a

# --- Fixed values: library defaults ------------------------------------------
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2.0
CHRF_EPS = 1e-16
PPL_CAP = 100.0
#: Characters or words whose n-grams a task counts at a time.
SYMBOLS = 1 << 20
# ---------------------------------------------------------------------------


def _gram_matches(pairs: DataFrame, order: int) -> DataFrame:
    """(sent_id, n, h, r, m): how many n-grams, n = 1..order, a sentence's hypotheses and references of
    ``pairs(sent_id, h, r)`` hold (strings, of characters, or arrays of words), and the clipped matches; no row where
    neither side has any. The texts meet by sentence, at most one shuffle of them; n-grams are counted where they are."""
    kind = pairs.schema["sent_id"].dataType.simpleString()
    sides = pairs.groupBy("sent_id").agg(F.collect_list("h").alias("h"), F.collect_list("r").alias("r"))
    return sides.mapInArrow(_counted(order), f"sent_id {kind}, n int, h long, r long, m long")


def _counted(order: int):
    def run(batches):
        for batch in batches:
            sizes = sum(np.bincount(row, length, batch.num_rows) for _, length, row in map(_texts, batch.columns[1:]))
            ends = np.searchsorted(np.cumsum(sizes), np.arange(SYMBOLS, sizes.sum() + SYMBOLS, SYMBOLS), "right") + 1
            start = 0
            for end in ends.tolist():  # a sentence at least, else about SYMBOLS characters or words
                part = batch.slice(start, end - start)
                start = max(start, end)
                if part.num_rows:
                    yield _sentence_matches(part, order)

    return run


def _texts(side: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All texts of a column of lists of them, their lengths, and their rows."""
    texts = side.flatten()
    measure = pc.list_value_length if pa.types.is_list(texts.type) else pc.utf8_length
    row = np.repeat(np.arange(len(side)), side.value_lengths().to_numpy())
    return texts, measure(texts).to_numpy(zero_copy_only=False).astype(np.int64), row


def _sentence_matches(batch: pa.RecordBatch, order: int) -> pa.RecordBatch:
    """An n-gram's number is that of its first n - 1 symbols and its last one, within its sentence."""
    (h, h_len, h_row), (r, r_len, r_row) = map(_texts, batch.columns[1:])
    length, row = np.concatenate([h_len, r_len]), np.concatenate([h_row, r_row])
    if pa.types.is_list(h.type):
        words = pa.concat_arrays([h.flatten(), r.flatten()]).dictionary_encode().indices
        symbol = words.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        symbol = np.frombuffer("".join(h.to_pylist() + r.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(length)
    at = np.arange(len(symbol))
    left = np.repeat(ends, length) - at  # symbols from here to the text's end
    row, is_ref = np.repeat(row, length), at >= h_len.sum()
    width = int(symbol.max(initial=0)) + 1
    gram, columns = row, []
    for n in range(1, order + 1):
        at = at[left[at] >= n]
        found, first, number = np.unique(gram[at] * width + symbol[at + n - 1], return_index=True, return_inverse=True)
        gram = np.zeros(len(symbol), np.int64)
        gram[at] = number
        ref = is_ref[at]
        counts = [np.bincount(number[side], minlength=len(found)) for side in (~ref, ref)]
        of = row[at[first]]
        sums = [np.bincount(of, c, batch.num_rows).astype(np.int64) for c in (*counts, np.minimum(*counts))]
        some = np.flatnonzero(sums[0] + sums[1])
        columns.append([batch.column(0).take(pa.array(some)), pa.array(np.full(len(some), n, np.int32)), *(pa.array(c[some]) for c in sums)])
    return pa.record_batch([pa.concat_arrays(c) for c in zip(*columns)], ["sent_id", "n", "h", "r", "m"])


def align_predictions(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """C4 (X2): predictions meet references by sentence id (inner join)."""
    return hyps.join(refs, "sent_id")


def bleu_stats(pairs: DataFrame, order: int = BLEU_ORDER) -> DataFrame:
    """One row: sys_len, ref_len, m_1..m_k (clipped matches), t_1..t_k."""
    tok = pairs.select("sent_id", tokenize_13a("hyp").alias("h"), tokenize_13a("ref").alias("r"))
    grams = _gram_matches(tok, order)

    def total(col, n):
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(col))), F.lit(0)).cast("long")

    # The lengths are the counts of 1-grams; every token starts one.
    return grams.agg(
        total("h", 1).alias("sys_len"),
        total("r", 1).alias("ref_len"),
        *[total("m", n).alias(f"m_{n}") for n in range(1, order + 1)],
        *[total("h", n).alias(f"t_{n}") for n in range(1, order + 1)],
    )


def bleu_from_stats(stats: DataFrame, order: int = BLEU_ORDER) -> DataFrame:
    """Sacrebleu corpus BLEU with exp smoothing: the j-th order with no
    match uses 100 / (2^j * total); 0 if nothing matches or any order has no
    total; BP = exp(1 - ref/sys) when sys < ref."""
    zero = [F.col(f"m_{n}") == 0 for n in range(1, order + 1)]
    precs = []
    for n in range(1, order + 1):
        j = sum((z.cast("int") for z in zero[:n]), F.lit(0))
        t = F.col(f"t_{n}")
        p = (
            F.when(t == 0, F.lit(0.0))  # no total: the score is 0 anyway
            .when(zero[n - 1], F.lit(100.0) / (F.pow(F.lit(2.0), j) * t))
            .otherwise(F.lit(100.0) * F.col(f"m_{n}") / t)
        )
        precs.append(p.alias(f"precision_{n}"))
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))
    out = stats.select("*", *precs, bp.alias("brevity_penalty"))
    mean_log = sum((F.log(F.greatest(F.col(f"precision_{n}"), F.lit(1e-300))) for n in range(1, order + 1)), F.lit(0.0)) / order
    any_match = sum((F.col(f"m_{n}") for n in range(1, order + 1)), F.lit(0)) > 0
    all_totals = F.least(*[F.col(f"t_{n}") for n in range(1, order + 1)]) > 0
    score = F.when(any_match & all_totals & (sys_len > 0), F.col("brevity_penalty") * F.exp(mean_log)).otherwise(
        F.lit(0.0)
    )
    return out.withColumn("bleu", score)


def corpus_bleu(hyps: DataFrame, refs: DataFrame, order: int = BLEU_ORDER) -> DataFrame:
    return bleu_from_stats(bleu_stats(align_predictions(hyps, refs), order), order)


def chrf_stats(pairs: DataFrame, order: int = CHRF_ORDER) -> DataFrame:
    """Per order n: H_n (hyp n-grams, counted 0 where the sentence's ref has
    none of that order), R_n, M_n (clipped matches), summed over sentences."""
    s = pairs.select("sent_id", remove_ws("hyp").alias("h"), remove_ws("ref").alias("r"))
    per = _gram_matches(s, order)
    return per.groupBy("n").agg(
        F.sum(F.when(F.col("r") > 0, F.col("h")).otherwise(F.lit(0))).alias("hyp"),
        F.sum("r").alias("ref"),
        F.sum("m").alias("match"),
    )


def chrf_from_stats(stats: DataFrame, beta: float = CHRF_BETA) -> DataFrame:
    """Average precision and recall over orders where both totals are
    positive, then F-beta x 100 (0 if both averages are 0)."""
    eff = (F.col("hyp") > 0) & (F.col("ref") > 0)
    agg = stats.agg(
        F.sum(F.when(eff, F.col("match") / F.col("hyp")).otherwise(F.lit(0.0))).alias("_p"),
        F.sum(F.when(eff, F.col("match") / F.col("ref")).otherwise(F.lit(0.0))).alias("_r"),
        F.count_if(eff).alias("effective_order"),
    )
    k = F.col("effective_order")
    p = F.when(k > 0, F.col("_p") / k).otherwise(F.lit(0.0))
    r = F.when(k > 0, F.col("_r") / k).otherwise(F.lit(0.0))
    f = beta * beta
    score = F.when(p + r > 0, F.lit(100.0) * (1 + f) * p * r / (f * p + r)).otherwise(F.lit(0.0))
    return agg.select(p.alias("avg_precision"), r.alias("avg_recall"), "effective_order", score.alias("chrf"))


def corpus_chrf(hyps: DataFrame, refs: DataFrame, order: int = CHRF_ORDER) -> DataFrame:
    return chrf_from_stats(chrf_stats(align_predictions(hyps, refs), order))


def ppl_of(avg_loss: Column, cap: float = PPL_CAP) -> Column:
    """exp(avg) if avg < cap else +inf."""
    return F.when(avg_loss < cap, F.exp(avg_loss)).otherwise(F.lit(math.inf))


def perplexity(token_losses: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch the mean loss over valid tokens, weighted back by the
    batch's valid-token count (= token-weighted mean), then exp with cap.
    Input rows are valid (non-pad) target tokens with ``loss``."""
    per = token_losses.groupBy(batch_col).agg(F.avg("loss").alias("_m"), F.count(F.lit(1)).alias("_v"))
    tot = per.agg(
        F.sum(F.col("_m") * F.col("_v")).alias("_s"), F.sum("_v").alias("n_tokens"), F.count(F.lit(1)).alias("n_batches")
    )
    avg = F.try_divide(F.col("_s"), F.col("n_tokens"))
    return tot.select("n_batches", "n_tokens", avg.alias("avg_loss"), ppl_of(avg).alias("ppl"))
