"""Driver queries for batches and sequences (sections 2.B, 2.C, 2.E, 2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.operators import sequences as Q
from bitext.plans import q_corpus, q_vocab
from bitext.plans import sql_fixtures as S

BATCH = 8  # batch size for the padding query


def _train_batches(spark, sf_dir):
    """Every split, encoded whole and batched by position within the split
    (positions are unique across splits, and a batch never spans two)."""
    split = q_corpus.split_corpus(spark, sf_dir)
    rows = q_vocab.encoded_pairs(spark, sf_dir, pairs=split, keep=["split", "pos"])
    batched = Q.assign_batches(rows, "pos", BATCH).withColumn("part", F.struct("split", "batch_id"))
    return Q.pad_batches(batched, "part")


def js(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def pad_batches(spark, sf_dir):
    b = _train_batches(spark, sf_dir)
    return b.select(
        "split",
        "pos",
        "pair_id",
        "batch_id",
        js("src_ids").alias("src_ids"),
        js("tgt_ids").alias("tgt_ids"),
        js("attention_mask").alias("attention_mask"),
        js("src_pad_mask").alias("src_pad_mask"),
        js("tgt_pad_mask").alias("tgt_pad_mask"),
    )


def shift_targets(spark, sf_dir):
    b = _train_batches(spark, sf_dir)
    tin, tout = Q.shift_targets("tgt_ids")
    return b.select(
        "split", "pos", "batch_id", F.array_join(tin, " ").alias("tgt_input"), F.array_join(tout, " ").alias("tgt_output")
    )


def detokenize(spark, sf_dir):
    enc = q_vocab.encoded_pairs(spark, sf_dir)
    vocab = q_vocab.char_vocab(spark, sf_dir)
    ev = Q.detokenize(enc, "pair_id", "tgt_ids", vocab, "evaluate")
    return ev.withColumn("text_inference", Q.tighten(F.col("text")))


def ngram_block(spark, sf_dir):
    enc = q_vocab.encoded_pairs(spark, sf_dir)
    return enc.select("pair_id", F.array_join(Q.blocked_next("tgt_ids", 3), " ").alias("blocked"))


QUERIES = {
    "pad_batches": pad_batches,
    "shift_targets": shift_targets,
    "detokenize": detokenize,
    "ngram_block": ngram_block,
}

# ---------------------------------------------------------------- oracle SQL


BATCH_SQL = (
    S.with_(S.VOCAB_CORPUS)
    + q_corpus.SPLIT_CTE
    + ""
    + q_vocab.WC_CTE
    + q_vocab.enc_cte("src").replace("FROM line_pairs)", "FROM splits)")
    + q_vocab.enc_cte("tgt").replace("FROM line_pairs)", "FROM splits)")
    + f""",
enc AS (SELECT lp.split, lp.pos, lp.pair_id, coalesce(s.ids, []::INTEGER[]) AS src_ids, coalesce(t.ids, []::INTEGER[]) AS tgt_ids
        FROM splits lp LEFT JOIN src_e s USING (pair_id) LEFT JOIN tgt_e t USING (pair_id)),
enct AS (SELECT split, pos, pair_id, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch_id,
                list_concat([2], src_ids, [3]) AS src_ids, list_concat([2], tgt_ids, [3]) AS tgt_ids FROM enc),
padded AS (SELECT split, pos, pair_id, batch_id,
                  list_resize(src_ids, max(len(src_ids)) OVER (PARTITION BY split, batch_id), 0) AS src_ids,
                  list_resize(tgt_ids, max(len(tgt_ids)) OVER (PARTITION BY split, batch_id), 0) AS tgt_ids FROM enct)"""
)


def jl(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


DETOK = f""",
dt AS (SELECT pair_id, tgt_ids, unnest(range(1, len(tgt_ids) + 1)) AS k FROM enct),
dt2 AS (SELECT d.pair_id, string_agg(v.token, ' ' ORDER BY d.k) AS t
        FROM dt d JOIN vocab v ON v.id = d.tgt_ids[d.k] WHERE d.tgt_ids[d.k] NOT IN (0, 2, 3) GROUP BY d.pair_id),
dt3 AS (SELECT e.pair_id, replace(coalesce(dt2.t, ''), ' ##', '') AS text FROM enct e LEFT JOIN dt2 USING (pair_id))"""

ORACLE = {
    "pad_batches": BATCH_SQL
    + f""" SELECT split, pos, pair_id, batch_id, {jl('src_ids')} AS src_ids, {jl('tgt_ids')} AS tgt_ids,
    {jl('list_transform(src_ids, lambda x: x <> 0)')} AS attention_mask,
    {jl('list_transform(src_ids, lambda x: x = 0)')} AS src_pad_mask,
    {jl('list_transform(tgt_ids, lambda x: x = 0)')} AS tgt_pad_mask FROM padded""",
    "shift_targets": BATCH_SQL
    + f""" SELECT split, pos, batch_id, {jl('tgt_ids[1:len(tgt_ids) - 1]')} AS tgt_input,
    {jl('tgt_ids[2:len(tgt_ids)]')} AS tgt_output FROM padded""",
    "detokenize": q_vocab.ENC
    + DETOK
    + """ SELECT pair_id, text, replace(replace(text, ' .', '.'), ' ,', ',') AS text_inference FROM dt3""",
    "ngram_block": q_vocab.ENC
    + f""" SELECT pair_id, CASE WHEN len(tgt_ids) >= 3 THEN {jl('''list_sort(list_distinct(list_transform(
        list_filter(range(1, len(tgt_ids) - 1), lambda i: tgt_ids[i:i + 1] = tgt_ids[len(tgt_ids) - 1:len(tgt_ids)]),
        lambda i: tgt_ids[i + 2])))''')} ELSE '' END AS blocked FROM enct""",
}
