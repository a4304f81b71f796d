"""Driver queries for corpus preparation (sections 2.A, 2.B, 2.E, 2.F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.operators import corpus as C
from bitext.plans import fixtures as fx
from bitext.plans import sql_fixtures as S
from bitext.session import scratch_path
from bitext.sources.corpus import read_corpus, write_corpus

# Split sizes for the driver queries as fractions of the filtered row count,
# so every split grows with the data (the reference's absolute defaults are
# for a 20M-pair corpus; absolute sizes are covered in tests/).
SANITY, MAIN, TEST = 0.5, 0.3, 0.2


def _split(spark, sf_dir):
    return C.split_corpus(fx.line_pairs(spark, sf_dir), SANITY, MAIN, TEST)


def corpus_scan(spark, sf_dir):
    """The pairs as a dataset on disk with two splits (what the length filter keeps, and the rest), each read back by
    its name; ids are positions in the split's files."""
    keep = F.when(C.pair_predicate(), "train").otherwise("rest")
    path = scratch_path(spark, "corpus")
    write_corpus(fx.line_pairs(spark, sf_dir).withColumn("split", keep), path)
    parts = [read_corpus(spark, path, split=s).withColumn("split", F.lit(s)) for s in ("train", "rest")]
    return parts[0].unionByName(parts[1])


def pair_filter(spark, sf_dir):
    return C.filter_pairs(fx.line_pairs(spark, sf_dir))


def pair_clean(spark, sf_dir):
    return C.clean_pairs(fx.line_pairs(spark, sf_dir))


def shuffle_seeded(spark, sf_dir):
    return C.shuffled_positions(C.filter_pairs(fx.line_pairs(spark, sf_dir))).select(
        "pos", "pair_id", "n_rows"
    )


def epoch_shuffle(spark, sf_dir):
    """Per-epoch order of the filtered pairs for epochs 1..3."""
    pairs = C.filter_pairs(fx.line_pairs(spark, sf_dir)).select("pair_id")
    epochs = pairs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return C.epoch_order(epochs).select("epoch", "pos", "pair_id")


def split_corpus(spark, sf_dir):
    return _split(spark, sf_dir)


def corpus_stats(spark, sf_dir):
    pairs = fx.line_pairs(spark, sf_dir)
    return C.corpus_stats(pairs, _split(spark, sf_dir))


def head_rows(spark, sf_dir):
    """the first 50 test-split rows in file order."""
    test = _split(spark, sf_dir).where(F.col("split") == "test")
    return test.orderBy("pos").limit(50).select("pos", "pair_id", "src", "tgt")


def _line_tables(spark, sf_dir):
    lp = fx.line_pairs(spark, sf_dir)
    src = lp.select(F.col("pair_id").alias("line_no"), F.col("src").alias("text"))
    tgt = lp.select(F.col("pair_id").alias("line_no"), F.col("tgt").alias("text"))
    return src, tgt


def align_pairs(spark, sf_dir):
    src, tgt = _line_tables(spark, sf_dir)
    return C.align_pairs(src, tgt, mode="pair")


def align_compact(spark, sf_dir):
    src, tgt = _line_tables(spark, sf_dir)
    return C.align_pairs(src, tgt, mode="compact")


def request_filter(spark, sf_dir):
    from bitext.operators.runs import filter_requests

    return filter_requests(fx.requests(spark, sf_dir))


QUERIES = {
    "corpus_scan": corpus_scan,
    "pair_filter": pair_filter,
    "pair_clean": pair_clean,
    "shuffle_seeded": shuffle_seeded,
    "epoch_shuffle": epoch_shuffle,
    "split_corpus": split_corpus,
    "corpus_stats": corpus_stats,
    "head_rows": head_rows,
    "align_pairs": align_pairs,
    "align_compact": align_compact,
    "request_filter": request_filter,
}

# ---------------------------------------------------------------- oracle SQL

P1 = f"""src IS NOT NULL AND tgt IS NOT NULL AND src <> '' AND tgt <> ''
  AND length(src) >= 4 AND length(tgt) >= 4 AND length(src) <= 64 AND {S.word_count('tgt')} <= 64"""


def clean(expr: str) -> str:
    return S.strip(f"regexp_replace({expr}, '[\\n\\r]', ' ', 'g')")


SPLIT_CTE = f""",
f AS (SELECT * FROM line_pairs WHERE {P1}),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) - 1 AS BIGINT) AS pos,
             count(*) OVER () AS n FROM f),
sz AS (SELECT *, CAST(floor({SANITY} * n) AS BIGINT) AS s_n, CAST(floor({MAIN} * n) AS BIGINT) AS m_n,
              CAST(floor({TEST} * n) AS BIGINT) AS t_n FROM p),
m AS (
  SELECT 'sanity' AS split, * FROM sz WHERE pos < least(s_n, n)
  UNION ALL SELECT 'test' AS split, * FROM sz WHERE pos >= greatest(0, n - t_n)
  UNION ALL SELECT 'production' AS split, * FROM sz WHERE pos >= s_n AND pos < least(s_n + m_n, greatest(0, n - t_n))),
splits AS (
  SELECT split, pos, pair_id, {clean('src')} AS src, {clean('tgt')} AS tgt FROM m
  WHERE {clean('src')} <> '' AND {clean('tgt')} <> '')"""

W = S.with_(S.LINE_PAIRS)

ORACLE = {
    "corpus_scan": W
    + f""", s AS (SELECT *, CASE WHEN {P1} THEN 'train' ELSE 'rest' END AS split FROM line_pairs)
    SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1 AS BIGINT) AS pair_id, src, tgt FROM s""",
    "pair_filter": W + f" SELECT pair_id, src, tgt FROM line_pairs WHERE {P1}",
    "pair_clean": W
    + f""" SELECT pair_id, {clean('src')} AS src, {clean('tgt')} AS tgt FROM line_pairs
    WHERE {clean('src')} <> '' AND {clean('tgt')} <> ''""",
    "shuffle_seeded": W
    + f""", f AS (SELECT * FROM line_pairs WHERE {P1})
    SELECT CAST(row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) - 1 AS BIGINT) AS pos, pair_id,
           count(*) OVER () AS n_rows FROM f""",
    "epoch_shuffle": W
    + f""", f AS (SELECT pair_id, CAST(e AS INTEGER) AS epoch FROM line_pairs, range(1, 4) r(e) WHERE {P1})
    SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || pair_id), pair_id) - 1
           AS BIGINT) AS pos, pair_id FROM f""",
    "split_corpus": W + SPLIT_CTE + " SELECT * FROM splits",
    "corpus_stats": W
    + SPLIT_CTE
    + f"""
    SELECT 'original' AS stage, count(*) AS n FROM line_pairs
    UNION ALL SELECT 'filtered', count(*) FROM line_pairs WHERE {P1}
    UNION ALL SELECT 'split:' || split, count(*) FROM splits GROUP BY split""",
    "head_rows": W
    + SPLIT_CTE
    + " SELECT pos, pair_id, src, tgt FROM splits WHERE split = 'test' ORDER BY pos LIMIT 50",
    "align_pairs": W
    + f""" SELECT pair_id AS line_no, {S.strip('src')} AS src, {S.strip('tgt')} AS tgt FROM line_pairs
    WHERE {S.strip('src')} <> '' AND {S.strip('tgt')} <> ''""",
    "align_compact": W
    + f""",
    s AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS k, {S.strip('src')} AS src FROM line_pairs
          WHERE src IS NOT NULL AND {S.strip('src')} <> ''),
    t AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS k, {S.strip('tgt')} AS tgt FROM line_pairs
          WHERE tgt IS NOT NULL AND {S.strip('tgt')} <> '')
    SELECT CAST(s.k AS BIGINT) AS line_no, src, tgt FROM s JOIN t USING (k)""",
    "request_filter": S.with_(S.REQUESTS)
    + f""",
    quits AS (SELECT session_id, min(request_id) AS q FROM requests WHERE lower(text) IN ('q', 'exit') GROUP BY session_id)
    SELECT r.session_id, r.request_id, {S.strip('r.text')} AS text FROM requests r LEFT JOIN quits USING (session_id)
    WHERE (quits.q IS NULL OR r.request_id < quits.q) AND r.text IS NOT NULL AND {S.strip('r.text')} <> ''""",
}
