"""Column expressions for text: strip, word counts, pre-tokenizer, 13a.

All of these are built-in Spark expressions (Java regex), so they stay inside
whole-stage codegen. The regex strings are also valid RE2, which lets the
DuckDB oracle use the very same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference's behaviour) --------------------
# Python str.strip()/str.split() whitespace: the 29 characters Python treats as
# whitespace, written as one character class.
PY_WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# White_Space as split by the BERT pre-tokenizer (no \x1C-\x1F).
PRE_WS_BODY = (
    r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Punctuation isolated by the BERT pre-tokenizer: ASCII punctuation plus
# Unicode category P.
PUNCT_BODY = r"!-/:-@\[-`{-~\p{P}"
# Special tokens, ids 0..3 in this order.
SPECIALS = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
PAD_ID, UNK_ID, SOS_ID, EOS_ID = 0, 1, 2, 3
# Tokenizer "13a" (mteval-v13a) replacement chain, in order.
BLEU_13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# ---------------------------------------------------------------------------

PRE_TOKEN_RE = f"[{PUNCT_BODY}]|[^{PUNCT_BODY}{PRE_WS_BODY}]+"
NON_WS_CHAR_RE = f"[^{PRE_WS_BODY}]"
PY_STRIP_RE = f"^{PY_WS}+|{PY_WS}+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Python whitespace."""
    return F.regexp_replace(_c(col), PY_STRIP_RE, "")


def py_split(col: Column | str) -> Column:
    """Python ``str.split()``: words separated by runs of Python whitespace."""
    return F.array_remove(F.split(_c(col), f"{PY_WS}+"), "")


def word_count(col: Column | str) -> Column:
    """``len(s.split())``."""
    return F.size(py_split(col))


def char_count(col: Column | str) -> Column:
    """``len(s)`` in code points (Spark ``length`` counts code points)."""
    return F.length(_c(col))


def is_blank(col: Column | str) -> Column:
    """Null, empty or whitespace-only (Python falsy after strip)."""
    c = _c(col)
    return c.isNull() | (py_strip(c) == F.lit(""))


def pretokenize(col: Column | str) -> Column:
    """BERT pre-tokenizer: whitespace dropped, each punctuation mark alone."""
    return F.regexp_extract_all(_c(col), F.lit(PRE_TOKEN_RE), 0)


def symbols(col: Column | str) -> Column:
    """Characters of all pre-tokens, in order (whitespace dropped).

    Equal to the character-level BPE input of the whole text.
    """
    return F.regexp_extract_all(_c(col), F.lit(NON_WS_CHAR_RE), 0)


def chars(col: Column | str) -> Column:
    """Code points of a string (surrogate pairs stay whole)."""
    return F.split(_c(col), "")


def tokenize_13a(col: Column | str) -> Column:
    """sacrebleu's default BLEU tokenizer "13a" -> array of tokens."""
    s = _c(col)
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    s = F.replace(s, F.lit("&quot;"), F.lit('"'))
    s = F.replace(s, F.lit("&amp;"), F.lit("&"))
    s = F.replace(s, F.lit("&lt;"), F.lit("<"))
    s = F.replace(s, F.lit("&gt;"), F.lit(">"))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, repl in BLEU_13A_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return py_split(s)


def remove_ws(col: Column | str) -> Column:
    """``''.join(s.split())``."""
    return F.regexp_replace(_c(col), PY_WS, "")
