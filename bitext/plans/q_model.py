"""Driver queries for the count-based model, scoring and decoding
(sections 2.D, 2.E, 2.H, 2.K)."""

from __future__ import annotations


from pyspark.sql import functions as F

from bitext.operators import decode as D
from bitext.operators import metrics as M
from bitext.operators import model as K
from bitext.plans import q_corpus, q_vocab
from bitext.plans import sql_fixtures as S
from bitext.session import cut_lineage

EM_ROUNDS = 2  # unrolled in the oracle
TOP_C = 8
EPS = K.LABEL_SMOOTHING
BATCH = 8


def r6(c):
    return F.round(c, 6)


def _data(spark, sf_dir):
    """The character vocabulary and the encoded train (sanity + production,
    disjoint ranges) and test rows. Only split rows are encoded; cleaning
    touches whitespace only, which encoding drops, so ids equal those of the
    raw lines."""
    vocab = cut_lineage(q_vocab.char_vocab(spark, sf_dir))
    splits = cut_lineage(q_corpus.split_corpus(spark, sf_dir))
    train = cut_lineage(
        q_vocab.encoded_pairs(
            spark, sf_dir, pairs=splits.where(F.col("split").isin("sanity", "production")), vocab=vocab
        )
    )
    test = cut_lineage(
        q_vocab.encoded_pairs(spark, sf_dir, pairs=splits.where(F.col("split") == "test"), vocab=vocab, keep=["pos"])
    )
    return vocab, train, test


def _lm(spark, sf_dir):
    vocab, train, test = _data(spark, sf_dir)
    return K.BigramLM(train, "tgt_ids", vocab.count()), train, test


def _test_tokens(test, lm):
    """Teacher-forced target tokens of the test rows with LM log-probs."""
    toks = test.select(
        "pair_id", F.floor(F.col("pos") / BATCH).alias("batch_id"), F.posexplode(K.adjacent(F.col("tgt_ids"))).alias("i", "p")
    ).select("pair_id", "batch_id", "i", F.col("p.prev").alias("prev"), F.col("p.next").alias("next"))
    return lm.score(toks, "prev", "next", "lm_logp")


def bigram_lm(spark, sf_dir):
    lm, _, _ = _lm(spark, sf_dir)
    return lm.obs.join(lm.ctx.select("prev", "backoff"), "prev").select(
        "prev", "next", "n", r6("logp").alias("logp"), r6("backoff").alias("backoff")
    )


def perplexity(spark, sf_dir):
    lm, _, test = _lm(spark, sf_dir)
    toks = _test_tokens(test, lm).withColumn("loss", -F.col("lm_logp"))
    p = M.perplexity(toks)
    return p.select("n_batches", "n_tokens", r6("avg_loss").alias("avg_loss"), r6("ppl").alias("ppl"))


def smoothed_nll(spark, sf_dir):
    lm, _, test = _lm(spark, sf_dir)
    toks = lm.smoothed(_test_tokens(test, lm), "prev", "lm_logp")
    return toks.agg(
        F.count(F.lit(1)).alias("n_tokens"), r6(F.avg(-F.col("lm_logp"))).alias("nll"), r6(F.avg("loss")).alias("smoothed_nll")
    )


def length_norm(spark, sf_dir):
    lm, _, test = _lm(spark, sf_dir)
    seq = _test_tokens(test, lm).groupBy("pair_id").agg(F.sum("lm_logp").alias("score"))
    j = test.select("pair_id", F.size("tgt_ids").alias("len")).join(seq, "pair_id")
    return j.select(
        "pair_id",
        "len",
        r6("score").alias("score"),
        r6(D.length_normalised(F.col("score"), F.col("len"), D.ALPHA_EVAL)).alias("norm_eval"),
        r6(D.length_normalised(F.col("score"), F.col("len"), D.ALPHA_INFER)).alias("norm_infer"),
    )


def _lm_cands(lm):
    """Observed successors per context, log-softmax over them."""
    return K.log_softmax(lm.obs.select("prev", F.col("next").alias("token"), "logp"), ["prev"], "logp", "lsm").select(
        "prev", "token", F.col("lsm").alias("logp")
    )


def log_softmax(spark, sf_dir):
    lm, _, _ = _lm(spark, sf_dir)
    return _lm_cands(lm).select("prev", F.col("token").alias("next"), r6("logp").alias("lsm"))


def repeat_penalty(spark, sf_dir):
    lm, _, _ = _lm(spark, sf_dir)
    last = lm.score(lm.obs.select("prev").distinct().withColumn("tok", F.col("prev")), "prev", "tok", "_pl")
    j = lm.obs.join(last.select("prev", F.exp("_pl").alias("p_last")), "prev")
    pen = K.repeat_penalized(F.col("logp"), F.col("next") == F.col("prev"), F.col("p_last"))
    return j.select("prev", "next", r6("logp").alias("logp"), r6(pen).alias("penalized"))


def beam_topk_step(spark, sf_dir):
    from pyspark.sql import Window

    lm, _, _ = _lm(spark, sf_dir)
    c = _lm_cands(lm)
    w = Window.partitionBy("prev").orderBy(F.desc("logp"), "token")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= D.BEAM).select(
        "prev", "rank", F.col("token").alias("next"), r6("logp").alias("logp")
    )


def beam_decode(spark, sf_dir):
    """K1-only beam search, k=4, alpha=0.7: each test target is continued from
    its [SOS] and first token to the evaluation's step limit."""
    lm, _, test = _lm(spark, sf_dir)
    starts = test.where(F.size("tgt_ids") > 2).select(
        F.col("pair_id").alias("sent_id"), F.lit(0).alias("beam"), F.lit(0.0).alias("score"), F.slice("tgt_ids", 1, 2).alias("seq")
    )
    cands = cut_lineage(_lm_cands(lm))
    res = D.beam_search(spark, starts, D.lm_expander(cands), D.BEAM, D.ALPHA_EVAL, max_steps=D.MAX_STEPS)
    return res.select("sent_id", F.array_join("seq", " ").alias("seq"), r6("score").alias("score"), "kind", "step")


def _table(spark, sf_dir, rounds=EM_ROUNDS):
    _, train, test = _data(spark, sf_dir)
    return K.lexical_em(train, rounds=rounds), train, test


def lexical_em(spark, sf_dir):
    t, _, _ = _table(spark, sf_dir)
    return t.select("s", "t", r6("prob").alias("prob"))


def translation_candidates(spark, sf_dir):
    t, _, test = _table(spark, sf_dir)
    c = K.translation_candidates(test.withColumnRenamed("pair_id", "sent_id"), t, top_c=TOP_C)
    return c.select("sent_id", "rank", "token", r6("score").alias("score"))


class Translator:
    """K4 assembled from the training rows: LM and lexical table are written
    once; ``decode`` runs the beam search for (sent_id, src_ids) rows and
    ``translate_text`` encodes raw text first."""

    def __init__(self, spark, sf_dir, em_rounds=EM_ROUNDS):
        self.spark = spark
        vocab, train, test = _data(spark, sf_dir)
        self.vocab = vocab
        self.test = test
        self.lm = K.BigramLM(train, "tgt_ids", self.vocab.count()).materialize()
        self.table = K.lexical_em(train, rounds=em_rounds)

    def decode(self, sents, repeat=K.PENALTY, block=None, max_steps=D.MAX_STEPS_INFER, alpha=D.ALPHA_INFER):
        spark = self.spark
        cands = K.translation_support(sents, self.table).select("sent_id", "token", F.log("score").alias("tm_logp"))
        cands = cut_lineage(cands.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sent_id"))
        expand = D.translation_expander(cands, self.lm, K.LAMBDA, repeat_penalty=repeat, ngram_block=block)
        return D.beam_search(spark, D.start_beams(sents), expand, D.BEAM, alpha, max_steps=max_steps)

    def translate_text(self, df, key, text_col, **kw):
        from bitext.operators import vocab as V
        from bitext.operators.sequences import detokenize, with_template

        ids = V.encode_chars(df, key, text_col, self.vocab, "src_ids")
        sents = ids.select(F.col(key).alias("sent_id"), with_template("src_ids").alias("src_ids"))
        res = self.decode(sents, **kw)
        text = detokenize(res, "sent_id", "seq", self.vocab, "inference")
        return res.join(text, "sent_id").withColumnRenamed("sent_id", key)


def _translate(spark, sf_dir, **kw):
    tr = Translator(spark, sf_dir)
    sents = tr.test.select(F.col("pair_id").alias("sent_id"), "src_ids")
    return tr.decode(sents, **kw), tr.vocab


def translate_beam(spark, sf_dir):
    from bitext.operators.sequences import detokenize

    res, vocab = _translate(spark, sf_dir)
    text = detokenize(res, "sent_id", "seq", vocab, "inference")
    # output in input order.
    return (
        res.join(text, "sent_id")
        .select("sent_id", F.array_join("seq", " ").alias("seq"), r6("score").alias("score"), "kind", "step", "text")
        .orderBy("sent_id")
    )


def beam_decode_blocked(spark, sf_dir):
    res, _ = _translate(spark, sf_dir, repeat=None, block=3, alpha=D.ALPHA_EVAL, max_steps=D.MAX_STEPS)
    return res.select("sent_id", F.array_join("seq", " ").alias("seq"), r6("score").alias("score"), "kind", "step")


def _evaluated(spark, sf_dir):
    """The test split decoded as in evaluation, with its references: sent_id,
    src, hyp, ref; and the split's teacher-forced perplexity."""
    from bitext.operators.sequences import detokenize

    tr = Translator(spark, sf_dir)
    # evaluation decodes without the n-gram block and without the repeat penalty
    res = tr.decode(tr.test.select(F.col("pair_id").alias("sent_id"), "src_ids"), repeat=None, block=None, alpha=D.ALPHA_EVAL, max_steps=D.MAX_STEPS)
    hyp = detokenize(res, "sent_id", "seq", tr.vocab, "evaluate").withColumnRenamed("text", "hyp")
    test = q_corpus.split_corpus(spark, sf_dir).where(F.col("split") == "test")
    refs = test.select(F.col("pair_id").alias("sent_id"), "pos", "src", F.col("tgt").alias("ref"))
    ppl = M.perplexity(_test_tokens(tr.test, tr.lm).withColumn("loss", -F.col("lm_logp")))
    return cut_lineage(M.align_predictions(hyp, refs)), ppl


def evaluate(spark, sf_dir):
    """BLEU, chrF and perplexity of the decoder's own output, with the first
    three examples."""
    pairs, ppl = _evaluated(spark, sf_dir)
    bleu, chrf = M.bleu_from_stats(M.bleu_stats(pairs)), M.chrf_from_stats(M.chrf_stats(pairs))
    shown = pairs.orderBy("pos").limit(3).select(F.struct("pos", "src", "hyp", "ref").alias("x"))
    text = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(" | ", x["src"], x["hyp"], x["ref"]))
    one = shown.agg(F.array_join(text, "\n").alias("examples"))
    parts = [bleu.select(r6("bleu").alias("value"), F.lit("bleu").alias("name")), chrf.select(r6("chrf").alias("value"), F.lit("chrf").alias("name")), ppl.select(r6("ppl").alias("value"), F.lit("ppl").alias("name"))]
    scores = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("name", "value", F.lit(None).cast("string").alias("examples"))
    return scores.unionByName(one.select(F.lit("examples").alias("name"), F.lit(None).cast("double").alias("value"), "examples"))


QUERIES = {
    "evaluate": evaluate,
    "bigram_lm": bigram_lm,
    "perplexity": perplexity,
    "smoothed_nll": smoothed_nll,
    "length_norm": length_norm,
    "log_softmax": log_softmax,
    "repeat_penalty": repeat_penalty,
    "beam_topk_step": beam_topk_step,
    "beam_decode": beam_decode,
    "lexical_em": lexical_em,
    "translation_candidates": translation_candidates,
    "translate_beam": translate_beam,
    "beam_decode_blocked": beam_decode_blocked,
}

# ---------------------------------------------------------------- oracle SQL

BASE = (
    q_vocab.ENC
    + q_corpus.SPLIT_CTE
    + """,
train AS (SELECT * FROM enct WHERE pair_id IN (SELECT pair_id FROM splits WHERE split IN ('sanity', 'production'))),
test AS (SELECT e.*, s.pos FROM enct e JOIN splits s USING (pair_id) WHERE s.split = 'test'),
vsize AS (SELECT count(*)::DOUBLE AS v FROM vocab),
lmp AS (SELECT ids[i] AS prev, ids[i + 1] AS next FROM (SELECT tgt_ids AS ids, unnest(range(1, len(tgt_ids))) AS i FROM train)),
cnt AS (SELECT prev, next, count(*) AS n FROM lmp GROUP BY ALL),
ctx0 AS (SELECT prev, sum(n) AS total, count(*) AS n_succ, ln(1.0 / (sum(n) + 1.0 * (SELECT v FROM vsize))) AS backoff
         FROM cnt GROUP BY prev),
obs AS (SELECT c.prev, c.next, c.n, ln((c.n + 1.0) / (x.total + 1.0 * (SELECT v FROM vsize))) AS logp
        FROM cnt c JOIN ctx0 x USING (prev)),
ctx AS (SELECT x.*, (SELECT sum(-o.logp) FROM obs o WHERE o.prev = x.prev) - ((SELECT v FROM vsize) - x.n_succ) * x.backoff
               AS sum_neg FROM ctx0 x),
tt AS (SELECT pair_id, CAST(floor(pos / 8) AS BIGINT) AS batch_id, tgt_ids[i] AS prev, tgt_ids[i + 1] AS next
       FROM (SELECT pair_id, pos, tgt_ids, unnest(range(1, len(tgt_ids))) AS i FROM test)),
ts AS (SELECT t.*, coalesce(o.logp, x.backoff, -ln((SELECT v FROM vsize))) AS lm_logp, x.sum_neg
       FROM tt t LEFT JOIN obs o USING (prev, next) LEFT JOIN ctx x USING (prev)),
lsm AS (SELECT prev, next AS token, logp - max(logp) OVER (PARTITION BY prev)
               - ln(sum(exp(logp - max(logp) OVER (PARTITION BY prev))) OVER (PARTITION BY prev)) AS logp FROM obs)"""
)

# lsm above nests window functions, which SQL forbids; use a two-level form.
BASE = BASE.replace(
    """lsm AS (SELECT prev, next AS token, logp - max(logp) OVER (PARTITION BY prev)
               - ln(sum(exp(logp - max(logp) OVER (PARTITION BY prev))) OVER (PARTITION BY prev)) AS logp FROM obs)""",
    """lsm0 AS (SELECT prev, next, logp, max(logp) OVER (PARTITION BY prev) AS mx FROM obs),
lsm AS (SELECT prev, next AS token, logp - mx - ln(sum(exp(logp - mx)) OVER (PARTITION BY prev)) AS logp FROM lsm0)""",
)


def beam_sql(starts: str, expansion: str, steps: int, k: int, alpha: float) -> str:
    """Beam search as one recursive query: the rows of a step are its finished
    hypotheses and next live beams; scores are whole numbers of 2^-32. ``starts``: (sent_id, seq). ``expansion``
    gives (step, sent_id, beam, score, seq, nf0, token, logp) from the live
    rows of ``beam``; it must stop at the last step."""
    return f""",
beam(step, sent_id, kind, beam, rk, score, seq, nf) AS (
  SELECT 0, sent_id, 'live', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), seq, CAST(0 AS HUGEINT) FROM ({starts})
  UNION ALL
  SELECT step + 1, sent_id, CASE WHEN token = 3 THEN 'finished' ELSE 'live' END, CASE WHEN token = 3 THEN beam ELSE r - 1 END,
         CASE WHEN token = 3 THEN rk ELSE 0 END, score, seq, nf
  FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY token = 3, score DESC, beam, rk) AS r,
               nf0 + sum(CASE WHEN token = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id) AS nf
        FROM (SELECT step, sent_id, beam, nf0, token, score + logp AS score, list_append(seq, token) AS seq, rk
              FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, beam ORDER BY logp DESC, token) AS rk
                    FROM (SELECT * REPLACE (CAST(floor(logp * {D.FIXED} + 0.5) AS BIGINT) AS logp) FROM ({expansion}))) WHERE rk <= {k}))
  WHERE token = 3 OR (r <= {k} AND nf < {k})),
fin AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, step, beam, rk) AS r
        FROM (SELECT * REPLACE (score / {D.FIXED} / pow(len(seq), {alpha}) AS score) FROM beam WHERE kind = 'finished')),
liv AS (SELECT * REPLACE (score / {D.FIXED} AS score), row_number() OVER (PARTITION BY sent_id ORDER BY step DESC) AS r FROM beam
        WHERE kind = 'live' AND beam = 0 AND sent_id NOT IN (SELECT sent_id FROM fin)),
decoded AS (SELECT sent_id, seq, score, kind, step FROM fin WHERE r = 1 UNION ALL SELECT sent_id, seq, score, kind, step FROM liv WHERE r = 1)"""


LM_EXPANSION = """SELECT l.step, l.sent_id, l.beam, l.score, l.seq, l.nf AS nf0, c.token, c.logp
  FROM beam l JOIN lsm c ON c.prev = l.seq[len(l.seq)] WHERE l.kind = 'live' AND l.step < {steps}"""


def translation_expansion(steps: int, penalty: float = 0.0, block: int = 0) -> str:
    """K4's expansion over ``cand(sent_id, token, tm)`` and the bigram model."""
    repeats = ""
    if block:
        n = block
        repeats = f""" AND NOT (len(l.seq) >= {n} AND list_contains(list_transform(
          list_filter(range(1, len(l.seq) - {n - 2}), lambda i: l.seq[i:i + {n - 2}] = l.seq[len(l.seq) - {n - 2}:len(l.seq)]),
          lambda i: l.seq[i + {n - 1}]), c.token))"""
    return f"""SELECT step, sent_id, beam, score, seq, nf0, token, logit - mx - ln(sum(exp(logit - mx)) OVER (PARTITION BY sent_id, beam)) AS logp
  FROM (SELECT *, max(logit) OVER (PARTITION BY sent_id, beam) AS mx FROM (
    SELECT l.step, l.sent_id, l.beam, l.score, l.seq, l.nf AS nf0, c.token,
           0.5 * coalesce(o.logp, x.backoff, -ln((SELECT v FROM vsize))) + 0.5 * c.tm
           - CASE WHEN c.token = l.seq[len(l.seq)] THEN {penalty} ELSE 0.0 END AS logit
    FROM beam l JOIN cand c ON c.sent_id = l.sent_id
    LEFT JOIN obs o ON o.prev = l.seq[len(l.seq)] AND o.next = c.token
    LEFT JOIN ctx x ON x.prev = l.seq[len(l.seq)]
    WHERE l.kind = 'live' AND l.step < {steps}{repeats}))"""


def candidates_sql(sents: str) -> str:
    """``cand(sent_id, token, tm)`` of ``sents(sent_id, src_ids)``."""
    return f""",
sents AS ({sents}),
s_tok AS (SELECT sent_id, s, count(*) AS s_n FROM (SELECT sent_id, unnest(src_ids) AS s FROM sents) GROUP BY ALL),
cand AS (SELECT a.sent_id, p.t AS token, ln(sum(a.s_n * p.prob) / any_value(len(e.src_ids))) AS tm
         FROM s_tok a JOIN tab{EM_ROUNDS} p USING (s) JOIN sents e USING (sent_id) WHERE p.t NOT IN (0, 1, 2) GROUP BY a.sent_id, p.t)"""


def detokenize_sql() -> str:
    return """,
dk AS (SELECT sent_id, seq, unnest(range(1, len(seq) + 1)) AS k FROM decoded),
dj AS (SELECT d.sent_id, string_agg(v.token, ' ' ORDER BY d.k) AS t FROM dk d JOIN vocab v ON v.id = d.seq[d.k]
       WHERE d.seq[d.k] NOT IN (0, 2, 3) GROUP BY d.sent_id),
dtext AS (SELECT d.sent_id, replace(coalesce(t, ''), ' ##', '') AS plain, replace(replace(replace(coalesce(t, ''), ' ##', ''), ' .', '.'), ' ,', ',') AS text
          FROM decoded d LEFT JOIN dj USING (sent_id))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def em_sql(rounds: int = 2) -> str:
    parts = [
        """,
src_tok AS (SELECT pair_id, s, count(*) AS s_n FROM (SELECT pair_id, unnest(src_ids) AS s FROM train) GROUP BY ALL),
tgt_tok AS (SELECT pair_id, t, count(*) AS t_n FROM (SELECT pair_id, unnest(tgt_ids) AS t FROM train) GROUP BY ALL),
cooc AS (SELECT a.pair_id, s, s_n, t, t_n, len(tr.src_ids) AS slen FROM src_tok a JOIN tgt_tok b USING (pair_id)
         JOIN train tr USING (pair_id)),
c1 AS (SELECT s, t, sum(t_n * s_n / slen) AS c FROM cooc GROUP BY s, t),
tab1 AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS prob FROM c1)"""
    ]
    for r in range(2, rounds + 1):
        parts.append(
            f""",
w{r} AS (SELECT o.pair_id, o.s, o.t, o.t_n, o.s_n * p.prob AS w FROM cooc o JOIN tab{r - 1} p USING (s, t)),
z{r} AS (SELECT pair_id, t, sum(w) AS z FROM w{r} GROUP BY pair_id, t),
c{r} AS (SELECT s, t, sum(t_n * w / z) AS c FROM w{r} JOIN z{r} USING (pair_id, t) GROUP BY s, t),
tab{r} AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS prob FROM c{r})"""
        )
    return "".join(parts)


def evaluate_sql() -> str:
    """The decode of evaluation, detokenised, joined to its references, and scored by
    the metrics' own SQL."""
    from bitext.plans import q_metrics

    body = (
        recursive(BASE)
        + em_sql(EM_ROUNDS)
        + candidates_sql("SELECT pair_id AS sent_id, src_ids FROM test")
        + beam_sql("SELECT sent_id, [2] AS seq FROM sents", translation_expansion(100), 100, 4, 0.7)
        + detokenize_sql()
        + """,
hr AS (SELECT d.sent_id, d.plain AS hyp, s.tgt AS ref, s.src, s.pos FROM dtext d JOIN splits s ON s.pair_id = d.sent_id AND s.split = 'test')"""
    )
    bleu, chrf = (sql.replace(q_metrics.PAIRS, "", 1).lstrip(",\n") for sql in (q_metrics.BLEU_SQL, q_metrics.CHRF_SQL))
    return (
        body
        + f""",
ppl0 AS (SELECT batch_id, avg(-lm_logp) AS m, count(*) AS v FROM ts GROUP BY batch_id),
ppl1 AS (SELECT sum(m * v) / sum(v) AS a FROM ppl0),
shown AS (SELECT string_agg(src || ' | ' || hyp || ' | ' || ref, chr(10) ORDER BY pos) AS examples
          FROM (SELECT * FROM hr ORDER BY pos LIMIT 3)),
score_b AS (WITH {bleu}),
score_c AS (WITH {chrf})
SELECT 'bleu' AS name, bleu AS value, NULL::VARCHAR AS examples FROM score_b
UNION ALL SELECT 'chrf', chrf, NULL FROM score_c
UNION ALL SELECT 'ppl', round(CASE WHEN a < 100 THEN exp(a) ELSE 'infinity'::DOUBLE END, 6), NULL FROM ppl1
UNION ALL SELECT 'examples', NULL, examples FROM shown"""
    )


ORACLE = {
    "evaluate": evaluate_sql(),
    "bigram_lm": BASE
    + " SELECT o.prev, o.next, o.n, round(o.logp, 6) AS logp, round(x.backoff, 6) AS backoff FROM obs o JOIN ctx x USING (prev)",
    "perplexity": BASE
    + """,
    pb AS (SELECT batch_id, avg(-lm_logp) AS m, count(*) AS v FROM ts GROUP BY batch_id),
    pt AS (SELECT count(*) AS n_batches, CAST(sum(v) AS BIGINT) AS n_tokens, sum(m * v) / sum(v) AS a FROM pb)
    SELECT n_batches, n_tokens, round(a, 6) AS avg_loss,
           round(CASE WHEN a < 100 THEN exp(a) ELSE 'infinity'::DOUBLE END, 6) AS ppl FROM pt""",
    "smoothed_nll": BASE
    + f""" SELECT count(*) AS n_tokens, round(avg(-lm_logp), 6) AS nll,
    round(avg({1 - EPS} * (-lm_logp) + {EPS} / (SELECT v FROM vsize)
              * coalesce(sum_neg, (SELECT v * ln(v) FROM vsize))), 6) AS smoothed_nll FROM ts""",
    "length_norm": BASE
    + """, sc AS (SELECT pair_id, sum(lm_logp) AS score FROM ts GROUP BY pair_id)
    SELECT t.pair_id, CAST(len(t.tgt_ids) AS INTEGER) AS len, round(sc.score, 6) AS score,
           round(sc.score / pow(len(t.tgt_ids), 0.7), 6) AS norm_eval,
           round(sc.score / pow(len(t.tgt_ids), 1.0), 6) AS norm_infer FROM test t JOIN sc USING (pair_id)""",
    "log_softmax": BASE + " SELECT prev, token AS next, round(logp, 6) AS lsm FROM lsm",
    "repeat_penalty": BASE
    + """,
    pl AS (SELECT DISTINCT o.prev, exp(coalesce(o2.logp, x.backoff)) AS p_last
           FROM obs o LEFT JOIN obs o2 ON o2.prev = o.prev AND o2.next = o.prev JOIN ctx x ON x.prev = o.prev)
    SELECT o.prev, o.next, round(o.logp, 6) AS logp,
           round(o.logp - CASE WHEN o.next = o.prev THEN 10.0 ELSE 0.0 END
                 - ln(1 - pl.p_last + pl.p_last * exp(-10.0)), 6) AS penalized
    FROM obs o JOIN pl USING (prev)""",
    "beam_topk_step": BASE
    + """ SELECT prev, rank, token AS next, round(logp, 6) AS logp FROM (
    SELECT prev, token, logp, CAST(row_number() OVER (PARTITION BY prev ORDER BY logp DESC, token) AS INTEGER) AS rank
    FROM lsm) WHERE rank <= 4""",
    "beam_decode": recursive(BASE)
    + beam_sql("SELECT pair_id AS sent_id, tgt_ids[1:2] AS seq FROM test WHERE len(tgt_ids) > 2", LM_EXPANSION.format(steps=100), 100, 4, 0.7)
    + " SELECT sent_id, array_to_string(seq, ' ') AS seq, round(score, 6) AS score, kind, step FROM decoded",
    "translate_beam": recursive(BASE)
    + em_sql(EM_ROUNDS)
    + candidates_sql("SELECT pair_id AS sent_id, src_ids FROM test")
    + beam_sql("SELECT sent_id, [2] AS seq FROM sents", translation_expansion(128, penalty=10.0), 128, 4, 1.0)
    + detokenize_sql()
    + " SELECT sent_id, array_to_string(seq, ' ') AS seq, round(score, 6) AS score, kind, step, text FROM decoded JOIN dtext USING (sent_id)",
    "beam_decode_blocked": recursive(BASE)
    + em_sql(EM_ROUNDS)
    + candidates_sql("SELECT pair_id AS sent_id, src_ids FROM test")
    + beam_sql("SELECT sent_id, [2] AS seq FROM sents", translation_expansion(100, block=3), 100, 4, 0.7)
    + " SELECT sent_id, array_to_string(seq, ' ') AS seq, round(score, 6) AS score, kind, step FROM decoded",
    "lexical_em": BASE + em_sql(2) + " SELECT s, t, round(prob, 6) AS prob FROM tab2",
    "translation_candidates": BASE
    + em_sql(2)
    + """,
    ts_tok AS (SELECT pair_id, s, count(*) AS s_n FROM (SELECT pair_id, unnest(src_ids) AS s FROM test) GROUP BY ALL),
    sc AS (SELECT a.pair_id, p.t, sum(a.s_n * p.prob) / any_value(len(te.src_ids)) AS score
           FROM ts_tok a JOIN tab2 p USING (s) JOIN test te USING (pair_id) WHERE p.t NOT IN (0, 1, 2) GROUP BY a.pair_id, p.t),
    rk AS (SELECT pair_id, t, score, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, t) AS INTEGER) AS rank
           FROM sc)
    SELECT pair_id AS sent_id, rank, t AS token, round(score, 6) AS score FROM rk WHERE rank <= 8""",
}
