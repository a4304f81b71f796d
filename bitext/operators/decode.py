"""Beam search as iterative joins and windows.

All sentences advance together, one Spark step per decode position:

1. live beams ``(sent_id, beam, score, seq)`` meet their candidate
   next tokens through ``expand(live)`` (a join), which returns
   ``logp`` already normalised per beam;
2. top ``k`` per beam by (logp desc, token asc)              (E1); log-probs
   are whole numbers of 2^-32 from here on, so that equal sums are equal
   whatever order they were added in, and ties go by token and parent
3. proposals ending in [EOS] are finished with
   ``score / len(seq)^alpha``                                (H8, G2)
4. the rest are cut to ``k`` per sentence by (score desc, parent beam, rank),
   which is Python's stable sort over the reference's loop order (E2, F5);
5. a sentence stops once it has >= k finished hypotheses.

``UNROLL`` steps are one job: all of it stays in the partitioning by sentence
(beams and candidates are co-partitioned), so a step needs no shuffle and hands
its rows to the next one inside the task. The job writes the steps' finished
hypotheses and live beams (carrying the sentence's running finished count) to
the shared checkpoint folder; the next job reads the live rows back, so a lost
executor costs at most these steps. At the end each
sentence takes its best finished hypothesis (ties: earlier step, beam, rank),
else its best live beam of the latest step that had one (G3: a step that
leaves nothing keeps the previous live set).

An expander that can score beams as arrays (:class:`TranslationExpander`, if
its bigram model is small enough to be sent to every task) runs all steps of a
sentence in the task that has its candidates, many sentences at a time; the
rows that come out are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitext.functions.text import EOS_ID, SOS_ID
from bitext.operators.positions import BROADCAST_MAX_ROWS, broadcast_if_small
from bitext.operators.sequences import blocked_next
from bitext.session import cut_lineage

BEAM = 4
ALPHA_EVAL = 0.7
ALPHA_INFER = 1.0
MAX_STEPS = 100
MAX_STEPS_INFER = 128
#: Scores are whole numbers of this part of a nat.
FIXED = 2.0**32
#: Decode positions that one job advances.
UNROLL = 8
#: Candidates whose sentences a task decodes at a time (8 bytes for each of their beams, in some 15 arrays).
TOGETHER = 1 << 16


def length_normalised(score: Column, length: Column, alpha: float) -> Column:
    """H8: ``score / len^alpha`` (len counts [SOS] and [EOS])."""
    return score / F.pow(length.cast("double"), F.lit(alpha))


def fixed_point(logp: Column) -> Column:
    """A log-probability as a whole number: what sums differ in by rounding is far below half a unit."""
    return F.floor(logp * FIXED + 0.5).cast("long")


def start_beams(sents: DataFrame, key: str = "sent_id") -> DataFrame:
    return sents.select(
        F.col(key).alias("sent_id"),
        F.lit(0).alias("beam"),
        F.lit(0.0).alias("score"),
        F.array(F.lit(SOS_ID)).alias("seq"),
    )


def block_ngrams(live: DataFrame, n: int = 3) -> DataFrame:
    """Live beams with the tokens that would repeat an n-gram of their
    prefix, computed once per beam, before it meets its candidates."""
    return live.withColumn("_blocked", blocked_next("seq", n))


def beam_search(
    spark: SparkSession,
    starts: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    beam_size: int = BEAM,
    alpha: float = ALPHA_EVAL,
    max_steps: int = MAX_STEPS,
    num_partitions: int | None = None,
    unroll: int = UNROLL,
) -> DataFrame:
    """Run the search. ``starts``: (sent_id, beam, score, seq). ``expand``
    maps live beams to (sent_id, beam, score, seq, token, logp) candidates,
    passing through any other live column (the running count ``nf``).

    ``unroll`` steps are one job that writes their finished hypotheses and
    live beams (with the sentence's running finished count ``nf``) to the
    shared checkpoint folder; the next job reads the live rows back.

    Returns one row per sentence: sent_id, seq, score, kind ('finished' or
    'live'), step."""
    k = beam_size
    whole = getattr(expand, "search", lambda *_: None)
    nparts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # The step number is a column, so every step's code is the same and is compiled once.
    live = starts.withColumns({"score": fixed_point(F.col("score")), "nf": F.lit(0).cast("long"), "step": F.lit(0)}).repartition(nparts, "sent_id")
    # Step 0: the start beams, the answer of a sentence that has no candidate.
    steps = [live.select("sent_id", "step", "beam", F.lit(0).alias("rank"), "seq", "score", F.lit("live").alias("kind"), "nf")]
    held: list[DataFrame] = []
    found = whole(live, k, max_steps, nparts)
    if found is not None:
        steps, max_steps = [cut_lineage(found)], 0
    for step in range(1, max_steps + 1):
        cands = expand(live).withColumn("logp", fixed_point(F.col("logp")))
        w_beam = Window.partitionBy("sent_id", "beam").orderBy(F.desc("logp"), "token")
        top = (
            cands.withColumn("rank", F.row_number().over(w_beam))
            .where(F.col("rank") <= k)
            .select(
                "sent_id",
                "beam",
                "rank",
                "token",
                "nf",
                "step",
                (F.col("score") + F.col("logp")).alias("score"),
                F.concat("seq", F.array("token")).alias("seq"),
            )
        )
        is_eos = F.col("token") == EOS_ID
        w_all = Window.partitionBy("sent_id")
        # Live candidates rank after the finished ones so that the first k
        # ranks of the non-EOS rows are their own order.
        w_sent = Window.partitionBy("sent_id").orderBy(is_eos.asc(), F.desc("score"), "beam", "rank")
        ranked = top.withColumn("_nf", F.col("nf") + F.sum(is_eos.cast("long")).over(w_all)).withColumn(
            "_r", F.row_number().over(w_sent)
        )
        out = ranked.where(is_eos | ((F.col("_r") <= k) & (F.col("_nf") < k))).select(
            "sent_id",
            (F.col("step") + 1).alias("step"),
            F.when(is_eos, F.col("beam")).otherwise(F.col("_r") - 1).alias("beam"),
            F.when(is_eos, F.col("rank")).otherwise(F.lit(0)).alias("rank"),
            "seq",
            "score",
            F.when(is_eos, F.lit("finished")).otherwise(F.lit("live")).alias("kind"),
            F.col("_nf").alias("nf"),
        )
        held.append(out.persist())  # planned, not run: the steps after it in the same job read it
        live = held[-1].where(F.col("kind") == "live").select("sent_id", "beam", "score", "seq", "nf", "step")
        if len(held) == unroll or step == max_steps:
            # Reliable checkpoint to spark.checkpoint.dir: one job runs these
            # steps, and lineage is never longer than they are.
            done = cut_lineage(reduce(DataFrame.unionByName, held))
            for df in held:
                df.unpersist()
            held = []
            steps.append(done)
            live = done.where((F.col("kind") == "live") & (F.col("step") == step)).select("sent_id", "beam", "score", "seq", "nf", "step")
            live = live.repartition(nparts, "sent_id")
            if live.isEmpty():
                break
    # All steps' rows (a few per sentence and step) meet their sentence once; one
    # window takes its best finished hypothesis, else (G3) its best live beam of the
    # latest step that had one.
    res = reduce(DataFrame.unionByName, steps).where((F.col("kind") == "finished") | (F.col("beam") == 0)).repartition(nparts, "sent_id")
    ended = F.col("kind") == "finished"
    nats = F.col("score") / FIXED
    res = res.withColumn("score", F.when(ended, length_normalised(nats, F.size("seq"), alpha)).otherwise(nats))
    of_ended = lambda c: F.when(ended, F.col(c))
    best = Window.partitionBy("sent_id").orderBy(ended.desc(), of_ended("score").desc(), of_ended("step"), F.desc("step"), "beam", "rank")
    res = res.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1)
    return cut_lineage(res.select("sent_id", "seq", "score", "kind", "step"))


def _carry(live: DataFrame) -> list[str]:
    """Beam columns an expander passes through (plus the search's own counters)."""
    return ["sent_id", "beam", "score", "seq"] + [c for c in ("nf", "step") if c in live.columns]


def lm_expander(lm_cands: DataFrame, k: int = BEAM) -> Callable[[DataFrame], DataFrame]:
    """K1-only expansion: the candidates of a beam are the ``k`` best observed
    successors of its last token, ``lm_cands(prev, token, logp)`` already
    normalised over all of them. No beam can use more than ``k`` (E1), so the
    others are cut before the join: it meets one row for each last token, an
    array of ``k`` successors."""
    order = Window.partitionBy("prev").orderBy(fixed_point(F.col("logp")).desc(), "token")
    top = lm_cands.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    lists = cut_lineage(top.groupBy("prev").agg(F.collect_list(F.struct("token", "logp")).alias("_best")))
    table = broadcast_if_small(lists)

    def expand(live: DataFrame) -> DataFrame:
        l2 = live.withColumn("prev", F.element_at("seq", -1))
        j = l2.join(table, "prev").select(*_carry(live), F.explode("_best").alias("_c"))
        return j.select(*_carry(live), "_c.token", "_c.logp")

    return expand


def translation_expander(
    cands: DataFrame,
    lm,
    lam: float = 0.5,
    repeat_penalty: float | None = None,
    ngram_block: int | None = None,
    k: int = BEAM,
) -> "TranslationExpander":
    """K4 expansion: the sentence's candidate tokens (all of K3's) scored by ``lam * ln p_lm(t | last) + (1 - lam) * ln p_tm(t | sent)``;
    optional soft repeat penalty on the last token (H9) and n-gram blocking
    (C7); then log-softmax per beam (E8). ``cands`` is (sent_id, token,
    tm_logp) and is co-partitioned with the live beams by sent_id.

    A beam meets one row of its sentence's candidates and one of its last
    token's successors, both as arrays by token; :func:`best_tokens` scores
    all of them and hands on the ``k`` best, as no beam can use more (E1)."""
    return TranslationExpander(cands, lm, lam, repeat_penalty or 0.0, ngram_block, k)


class TranslationExpander:
    """See :func:`translation_expander`. Called with live beams it expands them by one step; :meth:`search` runs
    all steps of :func:`beam_search`."""

    def __init__(self, cands: DataFrame, lm, lam: float, penalty: float, ngram_block: int | None, k: int):
        order = ["token", "tm_logp"]
        lists = cands.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_c"))
        self.lists = cut_lineage(lists.select("sent_id", F.col("_c.token").alias("_tokens"), F.col("_c.tm_logp").alias("_tm")))
        self.lm, self.lam, self.penalty, self.ngram_block, self.k = lm, lam, penalty, ngram_block, k

    @cached_property
    def after(self) -> DataFrame:
        return broadcast_if_small(cut_lineage(self.lm.successors()))

    def __call__(self, live: DataFrame) -> DataFrame:
        best = best_tokens(self.lam, self.penalty, self.lm.uniform_logp, self.k)
        l2 = live.withColumn("prev", F.element_at("seq", -1))
        l2 = block_ngrams(l2, self.ngram_block) if self.ngram_block else l2.withColumn("_blocked", F.array().cast("array<int>"))
        j = l2.join(self.after, "prev", "left").join(self.lists, "sent_id")
        found = best("prev", "_tokens", "_tm", "_next", "_lp", "backoff", "_blocked")
        j = j.select(*_carry(live), found.alias("_found"))
        # An inner explode makes Spark ask for the array's size first, which scores every beam twice.
        each = j.select(*_carry(live), F.explode_outer("_found").alias("_b")).where("_b is not null")
        return each.select(*_carry(live), "_b.token", "_b.logp")

    def search(self, starts: DataFrame, k: int, max_steps: int, nparts: int) -> DataFrame | None:
        """The rows of all steps that can be a sentence's answer, as :func:`beam_search` has them: the start beams, what
        finished, and the best live beam of the last step that had one. ``None`` if the bigram model has too many rows
        to be sent to every task."""
        if self.lm.obs.limit(BROADCAST_MAX_ROWS + 1).count() > BROADCAST_MAX_ROWS:
            return None
        obs, ctx = self.lm.obs.select("prev", "next", "logp").toArrow(), self.lm.ctx.select("prev", "backoff").toArrow()
        sent = starts.sparkSession.sparkContext.broadcast(BigramArrays(*(obs[c].to_numpy() for c in ("prev", "next", "logp")), *(ctx[c].to_numpy() for c in ("prev", "backoff")), self.lm.uniform_logp))
        lam, penalty, block, most = self.lam, self.penalty, self.ngram_block, min(k, self.k)
        beams = starts.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("beam", "score", "seq"))).alias("_beams"))
        rows = beams.join(self.lists, "sent_id", "left").repartition(nparts, "sent_id")

        def decode(batches):
            for batch in batches:
                sizes = pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto, at = np.cumsum(sizes), 0
                while at < batch.num_rows:
                    end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + TOGETHER, "right")))
                    yield searched(batch.slice(at, end - at), sent.value, lam, penalty, block, most, k, max_steps)
                    at = end

        kind = starts.schema["sent_id"].dataType.simpleString()
        return rows.mapInArrow(decode, f"sent_id {kind}, step int, beam int, rank int, seq array<int>, score long, kind string, nf long")


class BigramArrays:
    """The bigram model as arrays: log-probabilities by context and next token, back-offs by context."""

    def __init__(self, prev: np.ndarray, after: np.ndarray, logp: np.ndarray, contexts: np.ndarray, backoff: np.ndarray, uniform: float):
        key = (prev.astype(np.int64) << 32) + after
        order, self.uniform = np.argsort(key, kind="stable"), uniform
        self.key, self.logp = key[order], logp[order]
        order = np.argsort(contexts, kind="stable")
        self.contexts, self.backoff = contexts[order], backoff[order]

    def of(self, row: np.ndarray, prev: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The log-probability of each token after its row's ``prev``."""
        out = np.full(len(prev), self.uniform)
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, prev), len(self.contexts) - 1)
            out = np.where(self.contexts[at] == prev, self.backoff[at], out)
        out = out[row]
        if len(self.key):
            # successors of each row's context lie together: only they are searched
            key = (prev.astype(np.int64) << 32)[row] + token
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out = np.where(self.key[at] == key, self.logp[at], out)
        return out


def blocked_pairs(seq: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """C7 for beams as rows of a matrix: the row and token of each n-gram that would be repeated."""
    size = seq.shape[1]
    if size < n:
        return np.zeros(0, np.int64), np.zeros(0, seq.dtype)
    last = size - n + 1
    hit = np.arange(last)[None, :] <= (length - n)[:, None]
    rows = np.arange(len(seq))
    for j in range(n - 1):
        hit &= seq[:, j : j + last] == seq[rows, np.maximum(length - n + 1 + j, 0)][:, None]
    row, at = np.nonzero(hit)
    return row, seq[row, at + n - 1]


def searched(batch: pa.RecordBatch, lm: BigramArrays, lam: float, penalty: float, block: int | None, most: int, k: int, max_steps: int) -> pa.RecordBatch:
    """All steps of the search for a batch of sentences (``sent_id, _beams, _tokens, _tm``), advanced together."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens, tm = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_tokens", "_tm"))
    first = np.cumsum(sizes) - sizes
    starts = batch.column("_beams")
    sent = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy())
    starts = starts.flatten()
    beam, score = (starts.field(c).to_numpy().astype(np.int64) for c in ("beam", "score"))
    lists = starts.field("seq")
    length = lists.value_lengths().to_numpy().astype(np.int64)
    seq = np.zeros((len(length), int(length.max(initial=0))), np.int32)
    seq[np.arange(seq.shape[1])[None, :] < length[:, None]] = lists.flatten().to_numpy()
    nf, out = np.zeros(batch.num_rows, np.int64), []
    out.append((sent, np.zeros(len(sent), np.int64), beam, np.zeros(len(sent), np.int64), seq, length, score, np.zeros(len(sent), bool), nf[sent]))
    last: dict[int, tuple] = {}  # of each step, the sentences' best live beams
    latest = np.zeros(batch.num_rows, np.int64)
    for step in range(1, max_steps + 1):
        n = sizes[sent]
        row = np.repeat(np.arange(len(sent)), n)
        place = np.repeat(first[sent] - (np.cumsum(n) - n), n) + np.arange(len(row))
        prev, token = seq[np.arange(len(sent)), length - 1], tokens[place]
        shut = blocked_pairs(seq, length, block) if block else None
        picked, fixed = top_tokens(row, token, tm[place], prev, lm.of(row, prev, token), lam, penalty, shut, most)[1:]
        # beams' proposals, best first; only the first k of each beam
        of, token = row[picked] if shut is None else picked[0], token[picked] if shut is None else picked[1]
        order = np.lexsort((token, -fixed, beam[of], sent[of]))
        of, token, fixed = of[order], token[order], fixed[order]
        rank = ranks(sent[of], beam[of])
        keep = rank < k
        of, token, fixed, rank = of[keep], token[keep], fixed[keep], rank[keep]
        if not len(of):
            break
        total, eos = score[of] + fixed, token == EOS_ID
        np.add.at(nf, sent[of][eos], 1)
        order = np.lexsort((rank, beam[of], -total, eos, sent[of]))
        of, token, rank, total, eos = (x[order] for x in (of, token, rank, total, eos))
        place = ranks(sent[of])
        keep = eos | ((place < k) & (nf[sent[of]] < k))
        of, token, rank, total, eos, place = (x[keep] for x in (of, token, rank, total, eos, place))
        size = length[of]
        grown = np.zeros((len(of), max(seq.shape[1], int(size.max(initial=0)) + 1)), np.int32)
        grown[:, : seq.shape[1]] = seq[of]
        grown[np.arange(len(of)), size] = token
        at = sent[of]
        rows = (at, np.full(len(of), step), np.where(eos, beam[of], place), np.where(eos, rank + 1, 0), grown, size + 1, total, eos, nf[at])
        out.append(tuple(x[eos] for x in rows))
        live = ~eos
        sent, beam, seq, length, score = at[live], place[live], grown[live], size[live] + 1, total[live]
        latest[sent] = step
        ahead = live & (place == 0)
        last[step] = tuple(x[ahead] for x in rows)
        for old in [s for s in last if s < step]:  # only what may still be a sentence's last live beam
            stays = latest[last[old][0]] == old
            last[old] = tuple(x[stays] for x in last[old])
            if not len(last[old][0]):
                del last[old]
        if not len(sent):
            break
    out += last.values()
    at, step, beam, rank, score, ended, count = (np.concatenate([x[c] for x in out]) for c in (0, 1, 2, 3, 6, 7, 8))
    length = np.concatenate([x[5] for x in out])
    flat = np.concatenate([x[4][np.arange(x[4].shape[1])[None, :] < x[5][:, None]] for x in out])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat))
    kind = pa.array(np.where(ended, "finished", "live"), pa.string())
    columns = [batch.column("sent_id").take(pa.array(at)), *(pa.array(x.astype(np.int32)) for x in (step, beam, rank)), lists, pa.array(score), kind, pa.array(count)]
    return pa.record_batch(columns, ["sent_id", "step", "beam", "rank", "seq", "score", "kind", "nf"])


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Each row's place (from 0) among the rows with the same keys, which lie together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    edge = np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0))
    begins = np.flatnonzero(edge)
    return np.arange(len(edge)) - begins[np.cumsum(edge) - 1]


def top_tokens(row: np.ndarray, token: np.ndarray, tm: np.ndarray, prev: np.ndarray, lm: np.ndarray, lam: float, penalty: float, shut: tuple[np.ndarray, np.ndarray] | None, k: int):
    """The ``k`` best candidates of each beam (logp desc, token asc), log-softmax over all its candidates that are not
    ``shut``. Candidates are given by beam (``row``) and token, both ascending. Returns (log-probs, the (beams, tokens) or, if
    nothing is shut, places of the chosen, their log-probs as whole numbers of 2^-32), in no order."""
    logit = lam * lm + (1 - lam) * tm
    logit = logit - np.where(token == prev[row], penalty, 0.0)
    if shut is not None:
        width = int(max(token.max(initial=0), shut[1].max(initial=0))) + 1
        free = ~np.isin(row * width + token, shut[0] * width + shut[1])
        row, token, logit = row[free], token[free], logit[free]
    own = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    if not len(own):
        none = np.zeros(0, np.int64)
        return np.zeros(0), none if shut is None else (none, token), none
    each = np.repeat(np.arange(len(own)), np.diff(np.append(own, len(row))))
    logit = logit - np.maximum.reduceat(logit, own)[each]
    logp = logit - np.log(np.add.reduceat(np.exp(logit), own))[each]
    fixed = np.floor(logp * FIXED + 0.5)
    rank, picked = fixed.copy(), []
    for _ in range(k):  # the first of the highest that are left, row by row
        top = np.maximum.reduceat(rank, own)
        hits = np.flatnonzero((rank == top[each]) & (rank > -np.inf))
        hits = hits[np.append(True, each[hits[1:]] != each[hits[:-1]])] if len(hits) else hits
        rank[hits] = -np.inf
        picked.append(hits)
    picked = np.concatenate(picked)
    return logp[picked], picked if shut is None else (row[picked], token[picked]), fixed[picked].astype(np.int64)


def best_tokens(lam: float, penalty: float, uniform: float, k: int):
    """The ``k`` best ``(token, logp)`` of each beam (logp desc, token asc), log-softmax over all its candidates that
    are not blocked. Arrow in and out; a batch's candidates are scored together."""

    @F.arrow_udf("array<struct<token:int,logp:double>>")
    def best(prev: pa.Array, tokens: pa.Array, tm: pa.Array, after: pa.Array, after_lp: pa.Array, backoff: pa.Array, blocked: pa.Array) -> pa.Array:
        def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(len(lists)), n), lists.flatten().to_numpy(zero_copy_only=False)

        rows = len(prev)
        row, token = flat(tokens)
        _, logit = flat(tm)
        seen_row, seen = flat(after)
        _, seen_lp = flat(after_lp)
        shut_row, shut = flat(blocked)
        width = int(max(token.max(initial=0), seen.max(initial=0), shut.max(initial=0))) + 1
        key, known = row * width + token, seen_row * width + seen  # both ascending
        lm = backoff.fill_null(uniform).to_numpy(zero_copy_only=False)[row]
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            lm = np.where(known[at] == key, seen_lp[at], lm)
        logp, chosen, _ = top_tokens(row, token, logit, prev.to_numpy(zero_copy_only=False), lm, lam, penalty, (shut_row, shut), k)
        order = np.argsort(chosen[0], kind="stable")
        chosen, logp = [x[order] for x in chosen], logp[order]
        found = np.bincount(chosen[0], minlength=rows)
        offsets = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(chosen[1].astype(np.int32)), pa.array(logp)], ["token", "logp"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs)

    return best
