"""Query registry: name -> Spark callable, name -> DuckDB oracle SQL."""

from __future__ import annotations

from bitext.plans import q_corpus, q_io, q_metrics, q_model, q_runs, q_sequences, q_stream, q_vocab

MODULES = [q_corpus, q_io, q_runs, q_vocab, q_sequences, q_metrics, q_model, q_stream]


def queries():
    out = {}
    for mod in MODULES:
        out.update(mod.QUERIES)
    return out


def oracle_sql():
    out = {}
    for mod in MODULES:
        out.update(getattr(mod, "ORACLE", {}))
    return out
