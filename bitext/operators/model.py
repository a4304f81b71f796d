"""Count-based translation model: bigram LM (K1), lexical EM (K2), per-
sentence candidates (K3), and log-prob helpers (E8, H9, D10).

These re-aim the reference's neural encoder/decoder to joins and
aggregations. Sizes: the LM is at most V^2 observed rows plus V context rows
(V = vocabulary size, a parameter); the EM co-occurrence table is per pair
and bounded by ``max_len^2`` distinct token pairs per sentence pair, i.e.
linear in the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.text import EOS_ID, PAD_ID, SOS_ID, UNK_ID
from bitext.operators.positions import BROADCAST_MAX_ROWS, broadcast_if_small
from bitext.session import cut_lineage

DELTA = 1.0  # add-delta smoothing of the bigram LM
LAMBDA = 0.5  # weight of the LM in the decoder's log-linear mix
PENALTY = 10.0  # soft repeat penalty on the last token's logit
LABEL_SMOOTHING = 0.1
CANDIDATES = 8  # top-c lexical candidates per sentence
NEVER_CANDIDATE = (PAD_ID, UNK_ID, SOS_ID)
# A token pair is hot beyond 1 / (HOT_SHARE x shuffle partitions) of all
# co-occurrences: what is shuffled by one pair is a small part of a task.
HOT_SHARE = 4


def adjacent(ids: Column) -> Column:
    n = F.size(ids)
    return F.arrays_zip(
        F.slice(ids, 1, F.greatest(n - 1, F.lit(0))).alias("prev"),
        F.slice(ids, 2, F.greatest(n - 1, F.lit(0))).alias("next"),
    )


class BigramLM:
    """K1: ``p(next | prev) = (c(prev,next) + delta) / (c(prev) + delta * V)``.

    ``obs(prev, next, n, logp)`` holds observed bigrams; ``ctx(prev, total,
    n_succ, backoff, sum_neg)`` holds per-context totals, the log-prob of any
    unseen successor and sum over all V tokens of -log p (for smoothing)."""

    def __init__(self, seqs: DataFrame, ids_col: str, vocab_size: int, delta: float = DELTA):
        self.V = int(vocab_size)
        self.delta = float(delta)
        pairs = seqs.select(F.explode(adjacent(F.col(ids_col))).alias("p")).select("p.prev", "p.next")
        counts = pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))
        V, d = float(self.V), self.delta
        ctx = counts.groupBy("prev").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_succ"))
        ctx = ctx.withColumn("_den", F.col("total") + d * V).withColumn("backoff", F.log(F.lit(d) / F.col("_den")))
        obs = counts.join(F.broadcast(ctx.select("prev", "_den")), "prev").select(
            "prev", "next", "n", F.log((F.col("n") + d) / F.col("_den")).alias("logp")
        )
        sum_obs = obs.groupBy("prev").agg(F.sum(-F.col("logp")).alias("_so"))
        ctx = ctx.join(sum_obs, "prev").select(
            "prev",
            "total",
            "n_succ",
            "backoff",
            (F.col("_so") - (V - F.col("n_succ")) * F.col("backoff")).alias("sum_neg"),
        )
        self.obs, self.ctx = obs, ctx

    def materialize(self) -> "BigramLM":
        """Write both tables to the shared checkpoint folder (iterative users
        such as the beam search read them every step)."""
        self.obs = cut_lineage(self.obs)
        self.ctx = cut_lineage(self.ctx)
        self._obs_bcast = self.obs.count() <= BROADCAST_MAX_ROWS
        return self

    @property
    def uniform_logp(self) -> float:
        return -math.log(self.V)

    def successors(self) -> DataFrame:
        """A row for each context: its back-off, and its observed successors by token with their log-probs, as two
        arrays (at most V rows)."""
        seen = self.obs.groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("next", "logp"))).alias("_s"))
        return seen.join(F.broadcast(self.ctx.select("prev", "backoff")), "prev").select(
            "prev", "backoff", F.col("_s.next").alias("_next"), F.col("_s.logp").alias("_lp")
        )

    def score(self, df: DataFrame, prev_col: str, next_col: str, out: str = "lm_logp") -> DataFrame:
        """Attach log p(next | prev) to every row (observed, else back-off,
        else uniform for an unseen context). ``ctx`` has at most V rows."""
        o = self.obs.select(F.col("prev").alias(prev_col), F.col("next").alias(next_col), F.col("logp").alias("_lp"))
        if getattr(self, "_obs_bcast", False):  # size checked in materialize()
            o = F.broadcast(o)
        c = self.ctx.select(F.col("prev").alias(prev_col), F.col("backoff").alias("_bo"))
        j = df.join(o, [prev_col, next_col], "left").join(F.broadcast(c), prev_col, "left")
        return j.withColumn(out, F.coalesce("_lp", "_bo", F.lit(self.uniform_logp))).drop("_lp", "_bo")

    def smoothed(self, df: DataFrame, prev_col: str, logp_col: str, out: str = "loss", eps: float = LABEL_SMOOTHING) -> DataFrame:
        """Attach ``(1 - eps) * nll + eps / V * sum over V of -log p(v | prev)`` to every row scored with
        ``logp_col``; an unseen context is uniform. ``ctx`` has at most V rows."""
        c = self.ctx.select(F.col("prev").alias(prev_col), F.col("sum_neg").alias("_sn"))
        rest = F.coalesce("_sn", F.lit(self.V * math.log(self.V)))
        loss = (1 - eps) * -F.col(logp_col) + eps / self.V * rest
        return df.join(F.broadcast(c), prev_col, "left").withColumn(out, loss).drop("_sn")


def log_softmax(df: DataFrame, group_cols: list[str], logit: str, out: str = "logp") -> DataFrame:
    """``logit - max - ln(sum(exp(logit - max)))`` over each group."""
    w = Window.partitionBy(*group_cols)
    m = F.max(logit).over(w)
    with_m = df.withColumn("_mx", m)
    z = F.log(F.sum(F.exp(F.col(logit) - F.col("_mx"))).over(w))
    return with_m.withColumn(out, F.col(logit) - F.col("_mx") - z).drop("_mx")


def repeat_penalized(logp: Column, is_last: Column, p_last: Column, penalty: float = PENALTY) -> Column:
    """H9: log-softmax after subtracting ``penalty`` from the last token's
    logit, in closed form from the unpenalised log-probs:
    lp' = lp - penalty*[last] - ln(1 - p_last + p_last * e^-penalty)."""
    norm = F.log(1 - p_last + p_last * math.exp(-penalty))
    return logp - F.when(is_last, F.lit(penalty)).otherwise(F.lit(0.0)) - norm


def token_table(seqs: DataFrame, key: str, ids_col: str, out: str) -> DataFrame:
    """(key, token, count) of distinct tokens per sequence."""
    return (
        seqs.select(key, F.explode(ids_col).alias(out))
        .groupBy(key, out)
        .agg(F.count(F.lit(1)).alias(f"{out}_n"))
    )


def lexical_em(
    pairs: DataFrame,
    rounds: int = 5,
    key: str = "pair_id",
    src_col: str = "src_ids",
    tgt_col: str = "tgt_ids",
    checkpoint_every: int = 1,
) -> DataFrame:
    """K2: IBM Model 1 translation table ``t(t | s)`` by EM, ``rounds`` rounds.

    Co-occurrences are distinct (source, target) tokens within a pair with
    their multiplicities, written once. Round 1 starts from a uniform table
    (each target token's posterior over the pair's source tokens is
    1/|src|). E-step: w = m_s * t(t|s), Z = sum of w per (pair, t), count =
    n_t * w / Z. M-step: sum counts per (s, t), normalise per s. The table
    is written to the shared checkpoint folder each round.

    A table of up to ``BROADCAST_MAX_ROWS`` rows is broadcast. Beyond that,
    token pairs such as ([SOS], [EOS]), which occur in every row, would meet
    in one task: pairs with more than a share of 1 / (HOT_SHARE x partitions)
    of all co-occurrences, fewer than HOT_SHARE x partitions by that share,
    meet a broadcast of their few probabilities, and only the others are
    shuffled by (s, t)."""
    src = token_table(pairs, key, src_col, "s")
    tgt = token_table(pairs, key, tgt_col, "t")
    slen = pairs.select(key, F.size(src_col).alias("_slen"))
    cooc = cut_lineage(src.join(tgt, key).join(slen, key))
    table = hot = None
    for r in range(rounds):
        if table is None:
            w = cooc.withColumn("_w", F.col("s_n") / F.col("_slen"))
            counts = w.withColumn("_c", F.col("t_n") * F.col("_w"))
        else:
            probs = table.select("s", "t", "prob")
            if probs.count() <= BROADCAST_MAX_ROWS:
                met = cooc.join(F.broadcast(probs), ["s", "t"])
            else:
                hot = hot or F.broadcast(cut_lineage(hot_pairs(cooc)))
                often = cooc.join(F.broadcast(probs.join(hot, ["s", "t"])), ["s", "t"])
                met = often.unionByName(cooc.join(hot, ["s", "t"], "left_anti").join(probs, ["s", "t"]))
            w = met.withColumn("_w", F.col("s_n") * F.col("prob"))
            zt = w.groupBy(key, "t").agg(F.sum("_w").alias("_z"))
            counts = w.join(zt, [key, "t"]).withColumn("_c", F.col("t_n") * F.col("_w") / F.col("_z"))
        st = counts.groupBy("s", "t").agg(F.sum("_c").alias("_c"))
        tot = st.groupBy("s").agg(F.sum("_c").alias("_tot"))
        # One row per distinct source token: bounded by the vocabulary size.
        table = st.join(F.broadcast(tot), "s").select("s", "t", (F.col("_c") / F.col("_tot")).alias("prob"))
        if checkpoint_every and (r + 1) % checkpoint_every == 0:
            table = cut_lineage(table)
    return table


def hot_pairs(cooc: DataFrame) -> DataFrame:
    """(s, t) of the token pairs that hold more than 1 / (HOT_SHARE x shuffle partitions) of all rows of ``cooc``:
    fewer than HOT_SHARE x partitions pairs."""
    most = HOT_SHARE * int(cooc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.broadcast(cooc.agg(F.count(F.lit(1)).alias("_total")))  # one row
    each = cooc.groupBy("s", "t").agg(F.count(F.lit(1)).alias("_n"))
    return each.join(total, F.col("_n") * most > F.col("_total")).select("s", "t")


def translation_support(
    sents: DataFrame, table: DataFrame, key: str = "sent_id", src_col: str = "src_ids"
) -> DataFrame:
    """Every token that K2 can translate some token of the sentence to, with
    ``p_tm(t | sent)`` as in K3 (never PAD/UNK/SOS): ``(key, token, score)``.
    What the decoder ranks; other tokens have probability 0. At most a
    vocabulary of rows per sentence, as the reference's logits."""
    src = token_table(sents, key, src_col, "s")
    slen = sents.select(key, F.size(src_col).alias("_slen"))
    tab = table.where(~F.col("t").isin(*NEVER_CANDIDATE)).select("s", F.col("t").alias("token"), "prob")
    sums = src.join(tab, "s").groupBy(key, "token").agg(F.sum(F.col("s_n") * F.col("prob")).alias("_sum"))
    return sums.join(slen, key).where("_sum > 0").select(key, "token", (F.col("_sum") / F.col("_slen")).alias("score"))


def translation_candidates(
    sents: DataFrame,
    table: DataFrame,
    key: str = "sent_id",
    src_col: str = "src_ids",
    top_c: int = CANDIDATES,
    always: tuple[int, ...] = (),
    hot: tuple[int, ...] = (SOS_ID, EOS_ID),
) -> DataFrame:
    """K3: ``p_tm(t | sent) = mean over source positions of t(t | s_i)``, top
    ``top_c`` per sentence by (score desc, token asc), never PAD/UNK/SOS;
    tokens in ``always`` are kept whatever their rank (if they score > 0).

    Tokens in ``hot`` ([SOS], [EOS]) occur in nearly every sentence; joining
    them per sentence would emit sentences x vocabulary rows. Their share of a
    score depends only on the sentence's counts of them (its signature s), so
    it is one ranked table per signature (bounded by the vocabulary). A target
    outside the sentence's own ("cold") candidates scores hot_s(t) / len, so
    among the first ``top_c + n_cold`` targets of the signature's ranking at
    least ``top_c`` are outside the cold set and outrank every later one:
    the exact top-c lies in the cold candidates plus that prefix."""
    src = token_table(sents, key, src_col, "s")
    slen = sents.select(key, F.size(src_col).alias("_slen"))
    tab = table.where(~F.col("t").isin(*NEVER_CANDIDATE)).select("s", "t", "prob")
    hcols = [f"_h{i}" for i in range(len(hot))]
    sig = src.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("s") == h, F.col("s_n"))), F.lit(0)).alias(c) for h, c in zip(hot, hcols)]
    )
    cold = (
        src.where(~F.col("s").isin(*hot))
        .join(tab, "s")
        .groupBy(key, "t")
        .agg(F.sum(F.col("s_n") * F.col("prob")).alias("_cold"))
    )
    n_cold = cold.groupBy(key).agg(F.count(F.lit(1)).alias("_ncold"))
    # Hot table per signature: signatures are few (counts of the hot tokens,
    # at most max_len each), rows per signature at most the vocabulary. A
    # signature's rows meet the table's by the hot token, so the plan has one
    # join whatever the signatures are, and none of them reaches the driver.
    uses = broadcast_if_small(
        sig.select(*hcols)
        .distinct()
        .select(*hcols, F.explode(F.array(*[F.struct(F.lit(h).alias("s"), F.col(c).alias("n")) for h, c in zip(hot, hcols)])).alias("use"))
        .select(*hcols, "use.s", "use.n")
        .where("n > 0")
    )
    ranked_hot = (
        tab.join(uses, "s")
        .groupBy(*hcols, "t")
        .agg(F.sum(F.col("n").cast("double") * F.col("prob")).alias("_hot"))
        .where("_hot > 0")
    )
    rank_w = Window.partitionBy(*hcols).orderBy(F.desc("_hot"), "t")
    ranked_hot = broadcast_if_small(ranked_hot.withColumn("_rank", F.row_number().over(rank_w)))
    # Per sentence: the first top_c + n_cold targets of its signature.
    sent_info = sig.join(n_cold, key, "left").select(key, *hcols, F.coalesce("_ncold", F.lit(0)).alias("_ncold"))
    prefix = (
        sent_info.select(key, *hcols, F.explode(F.sequence(F.lit(1), F.col("_ncold") + top_c)).alias("_rank"))
        .join(ranked_hot.select(*hcols, "_rank", "t"), [*hcols, "_rank"])
        .select(key, "t", F.lit(0.0).alias("_cold"))
    )
    extra = []
    if always:
        extra = [sent_info.select(key, F.explode(F.array(*[F.lit(a) for a in always])).alias("t"), F.lit(0.0).alias("_cold"))]
    cands = cold.select(key, "t", "_cold").unionByName(prefix)
    for df in extra:
        cands = cands.unionByName(df)
    cands = cands.groupBy(key, "t").agg(F.sum("_cold").alias("_cold"))
    scored = (
        cands.join(sent_info.select(key, *hcols), key)
        .join(ranked_hot.select(*hcols, "t", "_hot"), [*hcols, "t"], "left")
        .join(slen, key)
        .withColumn("_sum", F.col("_cold") + F.coalesce("_hot", F.lit(0.0)))
        .where(F.col("_sum") > 0)
        .withColumn("score", F.col("_sum") / F.col("_slen"))
    )
    w = Window.partitionBy(key).orderBy(F.desc("score"), "t")
    keep = F.col("rank") <= top_c
    if always:
        keep = keep | F.col("t").isin(*always)
    return scored.withColumn("rank", F.row_number().over(w)).where(keep).select(
        key, "rank", F.col("t").alias("token"), "score"
    )
