"""Driver queries for pre-tokenizing, vocabularies, BPE and id lookup
(sections 2.C, 2.D, 2.H, 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.functions.text import chars, pretokenize
from bitext.operators import sequences as Q
from bitext.operators import vocab as V
from bitext.plans import fixtures as fx
from bitext.plans import sql_fixtures as S


def ids_str(c):
    return F.array_join(c, " ")


def _word_counts(spark, sf_dir):
    return V.word_counts(fx.vocab_corpus(spark, sf_dir))


def char_vocab(spark, sf_dir):
    return V.char_vocab(spark, texts=fx.vocab_corpus(spark, sf_dir))


def encoded_pairs(spark, sf_dir, pairs=None, template=True, max_len=None, vocab=None, keep=None):
    """(pair_id, *keep, src_ids, tgt_ids) with the character vocabulary; whole
    texts unless ``max_len`` cuts them."""
    pairs = pairs if pairs is not None else fx.line_pairs(spark, sf_dir)
    vocab = vocab if vocab is not None else char_vocab(spark, sf_dir)
    keep = list(keep or [])
    out = V.encode_chars(pairs, "pair_id", ["src", "tgt"], vocab, ["src_ids", "tgt_ids"], keep=keep)
    if template:
        def side(name):
            ids = Q.with_template(name)
            return (Q.truncate(ids, max_len) if max_len else ids).alias(name)

        out = out.select("pair_id", *keep, side("src_ids"), side("tgt_ids"))
    return out


def pretokenize_q(spark, sf_dir):
    m = fx.mono(spark, sf_dir)
    return m.select(
        "line_id", F.size(pretokenize("text")).alias("n_tokens"), F.array_join(pretokenize("text"), " ").alias("tokens")
    )


def word_counts(spark, sf_dir):
    return _word_counts(spark, sf_dir)


def bpe_pair_counts(spark, sf_dir):
    wc = _word_counts(spark, sf_dir).withColumn("syms", chars("word"))
    return V.pair_counts(wc, "syms").select(F.col("l").alias("left"), F.col("r").alias("right"), "n")


def vocab_table(spark, sf_dir):
    return char_vocab(spark, sf_dir)


def encode_ids(spark, sf_dir):
    e = encoded_pairs(spark, sf_dir, template=False)
    return e.select("pair_id", ids_str("src_ids").alias("src_ids"), ids_str("tgt_ids").alias("tgt_ids"))


def encode_template(spark, sf_dir):
    e = encoded_pairs(spark, sf_dir, template=False)
    return e.select(
        "pair_id",
        ids_str(Q.with_template("src_ids")).alias("src_ids"),
        ids_str(Q.with_template("tgt_ids")).alias("tgt_ids"),
        ids_str(Q.with_pair_template("src_ids", "tgt_ids")).alias("pair_ids"),
    )


def encode_truncate(spark, sf_dir):
    e = encoded_pairs(spark, sf_dir, max_len=Q.MAX_LEN)
    return e.select(
        "pair_id",
        F.size("tgt_ids").alias("n_tgt"),
        F.array_contains("tgt_ids", 3).alias("tgt_has_eos"),
        ids_str("src_ids").alias("src_ids"),
        ids_str("tgt_ids").alias("tgt_ids"),
    )


def train_model(spark, sf_dir, size=V.VOCAB_SIZE):
    """To the stop rule: ``size`` tokens, or no pair that occurs twice."""
    return V.train_bpe(_word_counts(spark, sf_dir), vocab_size=size)


def model_path(spark, sf_dir, size=V.VOCAB_SIZE):
    """Where the tokenizer for these inputs lives: the shared checkpoint
    folder, keyed by the input files (path, size and time as Spark's reader
    gives them) and the vocabulary size."""
    import hashlib

    from bitext.session import ensure_checkpoint_dir, read_table

    parts = [str(size)]
    for name in ("documents", "conversations"):
        files = read_table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        seen = files.distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *files.columns))), "|"), 256))
        parts.append(f"{name}:{seen.first()[0]}")
    key = hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bitext-tokenizer-{key}"


def bpe_train(spark, sf_dir):
    """D4 + A4 save: always trains, then saves the model for later encodes."""
    model = train_model(spark, sf_dir)
    V.save_model(spark, model, model_path(spark, sf_dir))
    return model.merges_df(spark)


def bpe_encode(spark, sf_dir):
    """J2 with A4 load-or-build (the reference's get_or_build_tokenizer)."""
    model = V.load_or_build(spark, model_path(spark, sf_dir), lambda: train_model(spark, sf_dir))
    lp = fx.line_pairs(spark, sf_dir)
    return lp.select(
        "pair_id",
        ids_str(Q.truncate(Q.with_template(V.bpe_encode_column(model, F.col("src"))))).alias("src_ids"),
        ids_str(Q.truncate(Q.with_template(V.bpe_encode_column(model, F.col("tgt"))))).alias("tgt_ids"),
    )


QUERIES = {
    "pretokenize": pretokenize_q,
    "word_counts": word_counts,
    "bpe_pair_counts": bpe_pair_counts,
    "vocab_table": vocab_table,
    "encode_ids": encode_ids,
    "encode_template": encode_template,
    "encode_truncate": encode_truncate,
    "bpe_train": bpe_train,
    "bpe_encode": bpe_encode,
}

# ---------------------------------------------------------------- oracle SQL

WC_CTE = f""",
wc AS (SELECT word, count(*) AS freq FROM (SELECT unnest({S.pretokenize('text')}) AS word FROM vocab_corpus) GROUP BY word),
alpha AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id
          FROM (SELECT DISTINCT unnest(regexp_extract_all(word, '.')) AS token FROM wc)),
vocab AS (SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[SOS]', 2), ('[EOS]', 3)) v(token, id)
          UNION ALL SELECT token, id FROM alpha)"""


def enc_cte(side: str) -> str:
    return f""",
{side}_t AS (SELECT pair_id, toks, unnest(range(1, len(toks) + 1)) AS k
            FROM (SELECT pair_id, regexp_extract_all({side}, {S.q(V.ENCODE_CHAR_RE)}) AS toks FROM line_pairs)),
{side}_e AS (SELECT t.pair_id, list(coalesce(v.id, 1) ORDER BY t.k) AS ids
            FROM {side}_t t LEFT JOIN vocab v ON v.token = t.toks[t.k] GROUP BY t.pair_id)"""


ENC = (
    S.with_(S.VOCAB_CORPUS)
    + WC_CTE
    + enc_cte("src")
    + enc_cte("tgt")
    + """,
enc AS (SELECT lp.pair_id, coalesce(s.ids, []::INTEGER[]) AS src_ids, coalesce(t.ids, []::INTEGER[]) AS tgt_ids
        FROM line_pairs lp LEFT JOIN src_e s USING (pair_id) LEFT JOIN tgt_e t USING (pair_id)),
enct AS (SELECT pair_id, list_concat([2], src_ids, [3]) AS src_ids, list_concat([2], tgt_ids, [3]) AS tgt_ids FROM enc)"""
)


def js(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


ORACLE = {
    "pretokenize": S.with_(S.MONO)
    + f""" SELECT line_id, CAST(len({S.pretokenize('text')}) AS INTEGER) AS n_tokens,
    array_to_string({S.pretokenize('text')}, ' ') AS tokens FROM mono""",
    "word_counts": S.with_(S.VOCAB_CORPUS) + WC_CTE + " SELECT word, freq FROM wc",
    "bpe_pair_counts": S.with_(S.VOCAB_CORPUS)
    + WC_CTE
    + """,
    syms AS (SELECT regexp_extract_all(word, '.') AS s, freq FROM wc),
    pr AS (SELECT s[i] AS l, s[i + 1] AS r, freq FROM (SELECT s, freq, unnest(range(1, len(s))) AS i FROM syms))
    SELECT l AS "left", r AS "right", CAST(sum(freq) AS BIGINT) AS n FROM pr GROUP BY l, r""",
    "vocab_table": S.with_(S.VOCAB_CORPUS) + WC_CTE + " SELECT token, id FROM vocab",
    "encode_ids": ENC + f" SELECT pair_id, {js('src_ids')} AS src_ids, {js('tgt_ids')} AS tgt_ids FROM enc",
    "encode_template": ENC
    + f""" SELECT pair_id, {js("list_concat([2], src_ids, [3])")} AS src_ids,
    {js("list_concat([2], tgt_ids, [3])")} AS tgt_ids,
    {js("list_concat([2], src_ids, [3], [2], tgt_ids, [3])")} AS pair_ids FROM enc""",
    "encode_truncate": ENC
    + f""", cut AS (SELECT pair_id, src_ids[1:128] AS src_ids, tgt_ids[1:128] AS tgt_ids FROM enct) SELECT pair_id, CAST(len(tgt_ids) AS INTEGER) AS n_tgt, list_contains(tgt_ids, 3) AS tgt_has_eos,
    {js('src_ids')} AS src_ids, {js('tgt_ids')} AS tgt_ids FROM cut""",
}
