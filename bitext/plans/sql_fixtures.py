"""DuckDB forms of the fixture views, used by the oracle SQL strings.

The patterns are the same strings as in ``bitext.functions.text`` (valid in
both Java regex and RE2). DuckDB's ``regexp_replace`` needs the ``'g'`` flag
to replace every match, like Spark's.
"""

from __future__ import annotations

from bitext.functions.text import PRE_TOKEN_RE, PY_STRIP_RE, PY_WS, NON_WS_CHAR_RE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(PY_STRIP_RE)}, '', 'g')"


def py_split(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(PY_WS + '+')}), lambda x: x <> '')"


def word_count(expr: str) -> str:
    return f"len({py_split(expr)})"


def pretokenize(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(PRE_TOKEN_RE)})"


def symbols(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(NON_WS_CHAR_RE)})"


LINE_PAIRS = """
lp0 AS (
  SELECT u.conv_id, u.turn, string_split(u.text, chr(10)) AS s, string_split(a.text, chr(10)) AS t
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
lp1 AS (SELECT conv_id, turn, s, t, unnest(range(0, least(len(s), len(t)))) AS i FROM lp0),
line_pairs AS (
  SELECT CAST(conv_id * 4294967296 + turn * 65536 + i AS BIGINT) AS pair_id, s[i + 1] AS src, t[i + 1] AS tgt
  FROM lp1)"""

MONO = """
mono0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
mono1 AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM mono0),
mono AS (SELECT CAST(doc_id * 2147483648 + i AS BIGINT) AS line_id, ls[i + 1] AS text FROM mono1)"""

VOCAB_CORPUS = (
    LINE_PAIRS
    + ","
    + MONO
    + """,
vocab_corpus AS (
  SELECT src AS text FROM line_pairs UNION ALL SELECT tgt FROM line_pairs UNION ALL SELECT text FROM mono)"""
)

HYP_REF = (
    LINE_PAIRS
    + f""",
refs AS (SELECT pair_id AS sent_id, tgt AS ref FROM line_pairs),
hyps AS (
  SELECT pair_id AS sent_id,
         array_to_string(list_filter(string_split(tgt, ' '), lambda x, i: i % 7 <> 0), ' ') AS hyp
  FROM line_pairs WHERE src IS NOT NULL AND {strip('src')} <> '')"""
)

STEP_LOG = """
ev AS (
  SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, ts, event_id, ln(value / 100.0 + 1.0) AS loss,
         user_id + 1 AS n_tokens, (user_id + 1) * 1e-6 AS learning_rate
  FROM events),
step_log AS (
  SELECT run, epoch,
         CAST(row_number() OVER (PARTITION BY run, epoch ORDER BY ts, event_id) - 1 AS BIGINT) AS batch,
         CAST(row_number() OVER (PARTITION BY run ORDER BY epoch, ts, event_id) AS BIGINT) AS step,
         loss, n_tokens, learning_rate, ts, event_id
  FROM ev)"""

REQUESTS = """
requests AS (
  SELECT conv_id AS session_id, turn AS request_id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES (-1, 0, '  '), (-1, 1, 'Exit'), (-1, 2, 'after quit'), (-2, 0, 'q'),
                                  (-3, 0, ' Hello ')) v(session_id, request_id, text))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)
