"""Driver queries for metrics (sections 2.D, 2.H, 2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext.functions.text import BLEU_13A_RULES, PY_WS
from bitext.operators import metrics as M
from bitext.plans import fixtures as fx
from bitext.plans import sql_fixtures as S


def r6(c):
    return F.round(c, 6)


def corpus_bleu(spark, sf_dir):
    b = M.corpus_bleu(fx.hyps(spark, sf_dir), fx.refs(spark, sf_dir))
    return b.select(
        r6("bleu").alias("bleu"),
        r6("brevity_penalty").alias("brevity_penalty"),
        "sys_len",
        "ref_len",
        *[F.col(f"m_{n}") for n in range(1, 5)],
        *[F.col(f"t_{n}") for n in range(1, 5)],
    )


def corpus_chrf(spark, sf_dir):
    c = M.corpus_chrf(fx.hyps(spark, sf_dir), fx.refs(spark, sf_dir))
    return c.select(
        r6("chrf").alias("chrf"), r6("avg_precision").alias("avg_precision"), r6("avg_recall").alias("avg_recall"),
        "effective_order",
    )


QUERIES = {"corpus_bleu": corpus_bleu, "corpus_chrf": corpus_chrf}

# ---------------------------------------------------------------- oracle SQL


def tok13a(expr: str) -> str:
    s = expr
    for a, b in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        s = f"replace({s}, {S.q(a)}, {S.q(b)})"
    s = f"(' ' || {s} || ' ')"
    for pat, repl in BLEU_13A_RULES:
        s = f"regexp_replace({s}, {S.q(pat)}, {S.q(repl.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return S.py_split(s)


PAIRS = (
    S.with_(S.HYP_REF)
    + """,
hr AS (SELECT h.sent_id, h.hyp, r.ref FROM hyps h JOIN refs r USING (sent_id))"""
)

BLEU_SQL = (
    PAIRS
    + f""",
tk AS (SELECT sent_id, {tok13a('hyp')} AS h, {tok13a('ref')} AS r FROM hr),
hg AS (SELECT sent_id, n, array_to_string(h[i:i + n - 1], ' ') AS g FROM
        (SELECT sent_id, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM tk, range(1, 5) o(n))),
rg AS (SELECT sent_id, n, array_to_string(r[i:i + n - 1], ' ') AS g FROM
        (SELECT sent_id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM tk, range(1, 5) o(n))),
hc AS (SELECT sent_id, n, g, count(*) AS c FROM hg GROUP BY ALL),
rc AS (SELECT sent_id, n, g, count(*) AS c FROM rg GROUP BY ALL),
mt AS (SELECT n, sum(least(hc.c, rc.c)) AS m FROM hc JOIN rc USING (sent_id, n, g) GROUP BY n),
st AS (SELECT sum(len(h)) AS sys_len, sum(len(r)) AS ref_len,
              {", ".join(f"sum(greatest(len(h) - {n - 1}, 0)) AS t_{n}" for n in range(1, 5))} FROM tk),
s2 AS (SELECT CAST(coalesce(sys_len, 0) AS BIGINT) AS sys_len, CAST(coalesce(ref_len, 0) AS BIGINT) AS ref_len,
              {", ".join(f"CAST(coalesce((SELECT m FROM mt WHERE n = {n}), 0) AS BIGINT) AS m_{n}" for n in range(1, 5))},
              {", ".join(f"CAST(coalesce(t_{n}, 0) AS BIGINT) AS t_{n}" for n in range(1, 5))} FROM st),
s3 AS (SELECT *, {", ".join(f"CASE WHEN m_{n} = 0 THEN 100.0 / (pow(2.0, {' + '.join(f'CAST(m_{j} = 0 AS INTEGER)' for j in range(1, n + 1))}) * t_{n}) ELSE 100.0 * m_{n} / t_{n} END AS p_{n}" for n in range(1, 5))},
              CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END AS bp FROM s2)
SELECT round(CASE WHEN m_1 + m_2 + m_3 + m_4 > 0 AND least(t_1, t_2, t_3, t_4) > 0 AND sys_len > 0
                  THEN bp * exp((ln(p_1) + ln(p_2) + ln(p_3) + ln(p_4)) / 4) ELSE 0.0 END, 6) AS bleu,
       round(bp, 6) AS brevity_penalty, sys_len, ref_len, m_1, m_2, m_3, m_4, t_1, t_2, t_3, t_4 FROM s3"""
)

CHRF_SQL = (
    PAIRS
    + f""",
ws AS (SELECT sent_id, regexp_replace(hyp, {S.q(PY_WS)}, '', 'g') AS h, regexp_replace(ref, {S.q(PY_WS)}, '', 'g') AS r FROM hr),
hg AS (SELECT sent_id, n, substring(h, i, n) AS g FROM
        (SELECT sent_id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM ws, range(1, 7) o(n))),
rg AS (SELECT sent_id, n, substring(r, i, n) AS g FROM
        (SELECT sent_id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM ws, range(1, 7) o(n))),
hc AS (SELECT sent_id, n, g, count(*) AS c FROM hg GROUP BY ALL),
rc AS (SELECT sent_id, n, g, count(*) AS c FROM rg GROUP BY ALL),
j AS (SELECT coalesce(hc.sent_id, rc.sent_id) AS sent_id, coalesce(hc.n, rc.n) AS n,
             coalesce(hc.c, 0) AS hcnt, coalesce(rc.c, 0) AS rcnt FROM hc FULL JOIN rc USING (sent_id, n, g)),
per AS (SELECT sent_id, n, sum(hcnt) AS h, sum(rcnt) AS r, sum(least(hcnt, rcnt)) AS m FROM j GROUP BY sent_id, n),
ord AS (SELECT n, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS hyp, sum(r) AS ref, sum(m) AS mat FROM per GROUP BY n),
ag AS (SELECT sum(CASE WHEN hyp > 0 AND ref > 0 THEN mat / hyp ELSE 0.0 END) AS sp,
              sum(CASE WHEN hyp > 0 AND ref > 0 THEN mat / ref ELSE 0.0 END) AS sr,
              count(*) FILTER (WHERE hyp > 0 AND ref > 0) AS k FROM ord),
pr AS (SELECT CASE WHEN k > 0 THEN sp / k ELSE 0.0 END AS p, CASE WHEN k > 0 THEN sr / k ELSE 0.0 END AS r, k FROM ag)
SELECT round(CASE WHEN p + r > 0 THEN 100.0 * 5 * p * r / (4 * p + r) ELSE 0.0 END, 6) AS chrf,
       round(p, 6) AS avg_precision, round(r, 6) AS avg_recall, k AS effective_order FROM pr"""
)

ORACLE = {"corpus_bleu": BLEU_SQL, "corpus_chrf": CHRF_SQL}
