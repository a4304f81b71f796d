"""Driver queries for Structured Streaming (section 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.plans import fixtures as fx
from bitext.plans import q_corpus
from bitext.plans import sql_fixtures as S
from bitext.session import scratch_path
from bitext.streaming import streams as ST


def _table_glob(sf_dir, name):
    # The file source takes a directory or a glob, not a single file path.
    return f"{sf_dir}/{name}.parquet*"


def stream_metrics(spark, sf_dir):
    r = ST.stream_epoch_rollup(spark, _table_glob(sf_dir, "events"))
    return r.select("run", "epoch", "n_batches", F.round("train_loss", 6).alias("train_loss"), "n_tokens")


def stream_pair_filter(spark, sf_dir):
    landing = scratch_path(spark, "pairs-landing")
    fx.line_pairs(spark, sf_dir).write.mode("overwrite").parquet(landing)
    return ST.stream_pairs(spark, landing)


def stream_translate(spark, sf_dir):
    """Requests land as files (derived from the conversations); each
    micro-batch is filtered and decoded."""
    from bitext.plans.q_model import Translator

    landing = scratch_path(spark, "requests-landing")
    fx.requests(spark, sf_dir).write.mode("overwrite").parquet(landing)
    tr = Translator(spark, sf_dir)

    def translate(batch):
        keyed = batch.withColumn("rid", F.concat_ws(":", "session_id", "request_id"))
        out = tr.translate_text(keyed, "rid", "text").withColumnRenamed("text", "translation")
        return keyed.join(out, "rid").select(
            "session_id", "request_id", F.col("text").alias("request"), F.array_join("seq", " ").alias("seq"),
            F.round("score", 6).alias("score"), "kind", "step", "translation"
        )

    return ST.stream_translate(spark, landing, translate)


QUERIES = {
    "stream_metrics": stream_metrics,
    "stream_pair_filter": stream_pair_filter,
    "stream_translate": stream_translate,
}

def translate_sql() -> str:
    """The requests that pass the filter, encoded and decoded as in inference."""
    from bitext.operators import vocab as V
    from bitext.plans import q_model as M

    return (
        M.recursive(M.BASE)
        + M.em_sql(M.EM_ROUNDS)
        + ",\n" + S.REQUESTS.strip("\n")
        + f""",
quits AS (SELECT session_id, min(request_id) AS q FROM requests WHERE lower(text) IN ('q', 'exit') GROUP BY session_id),
asked AS (SELECT r.session_id || ':' || r.request_id AS rid, r.session_id, r.request_id, {S.strip('r.text')} AS text
          FROM requests r LEFT JOIN quits USING (session_id)
          WHERE (quits.q IS NULL OR r.request_id < quits.q) AND r.text IS NOT NULL AND {S.strip('r.text')} <> ''),
asked_t AS (SELECT rid, toks, unnest(range(1, len(toks) + 1)) AS k FROM (SELECT rid, regexp_extract_all(text, {S.q(V.ENCODE_CHAR_RE)}) AS toks FROM asked)),
asked_e AS (SELECT t.rid, list(coalesce(v.id, 1) ORDER BY t.k) AS ids FROM asked_t t LEFT JOIN vocab v ON v.token = t.toks[t.k] GROUP BY t.rid)"""
        + M.candidates_sql("SELECT a.rid AS sent_id, list_concat([2], coalesce(e.ids, []::INTEGER[]), [3]) AS src_ids FROM asked a LEFT JOIN asked_e e USING (rid)")
        + M.beam_sql("SELECT sent_id, [2] AS seq FROM sents", M.translation_expansion(128, penalty=10.0), 128, 4, 1.0)
        + M.detokenize_sql()
        + """ SELECT session_id, request_id, asked.text AS request, array_to_string(seq, ' ') AS seq, round(score, 6) AS score, kind, step, dtext.text AS translation
FROM decoded JOIN dtext USING (sent_id) JOIN asked ON asked.rid = sent_id"""
    )


ORACLE = {
    "stream_translate": translate_sql(),
    "stream_metrics": """SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, count(*) AS n_batches,
    round(avg(ln(value / 100.0 + 1.0)), 6) AS train_loss, CAST(sum(user_id + 1) AS BIGINT) AS n_tokens FROM events GROUP BY 1, 2""",
    "stream_pair_filter": q_corpus.ORACLE["pair_clean"].replace(
        "WHERE " + q_corpus.clean("src"), f"WHERE {q_corpus.P1} AND " + q_corpus.clean("src"), 1
    ),
}
