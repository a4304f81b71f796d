"""Lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitext.llm import lexsearch, queries
from bitext.llm.common import utf8

from ..conftest import SF_SMALL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    total, n_docs = sum(c.total() for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for i, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(q * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -s))
    return out


def got(rows):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows)


def test_query_equals_plain_python_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    out = got(queries.op11_lexical_search(spark, SF_SMALL).collect())
    assert out == Counter(plain(docs, items))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    assert Counter(con.execute(queries.ORACLE_SQL["op11_lexical_search"]).fetchall()) == out


@pytest.fixture
def small(monkeypatch):
    """Many shards, bundles, blocks and pieces."""
    for name, value in (("SHARD_BYTES", 300), ("PIECE_BYTES", 40), ("BLOCK", 8), ("BUNDLE", 3)):
        monkeypatch.setattr(lexsearch, name, value)


def test_edge_rows(spark, small):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "The", "Été", "x1", "日本", "b", "c" * rng.randint(1, 90)])
    docs = [(k if k % 9 else None, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(120)]
    docs += [(3, None), (None, None), (4, ""), (5, " .,\n"), (6, "a a a"), (6, "a a a"), (6, "a the"), (900, "the Été " * 3000)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 9)))) for k in range(20)] + [(None, "a the"), (50, None), (51, ""), (52, "nowhere"), (53, "a a THE"), (53, "a a THE"), (54, "é . ÉTÉ")]
    frame = lambda rows, name: spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], f"{name} long, text string, part int, slice string, term int, sum int")
    out = lexsearch.search(frame(docs, "doc_id").repartition(5), frame(items, "item_id").repartition(2))
    assert got(out.collect()) == Counter(plain(docs, items))


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)]), ([(1, "a")], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    rows = lexsearch.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert got(rows) == Counter(plain(docs, items))


def test_dropped_documents_could_not_win(spark, small, monkeypatch):
    """With as many stages as terms, sums are cut early and often."""
    monkeypatch.setattr(lexsearch, "SHARES", (0.01, 0.05, 0.1, 0.3, 0.6, 1.0))
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=8))) for k in range(7)]
    out = lexsearch.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(out.collect()) == Counter(plain(docs, items))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB9é日 .-\n", max_size=30), max_size=6), st.integers(1, 12))
def test_pieces_are_whole_terms(texts, most):
    found = [[] for _ in texts]
    for row, codes, distinct in lexsearch.pieces(*utf8(pa.array(texts, pa.string())), most):
        for r, c in zip(row.tolist(), codes.tolist()):
            found[r].append(distinct[c].as_py().decode())
    assert found == [terms(t) for t in texts]


def test_length_factor_beyond_64_bits():
    n = np.array([1, 2**40], np.int64)
    assert lexsearch.length_factor(n, 2**40, 2**41).tolist() == [25 + 75 * int(x) * 2**40 // 2**41 for x in n]
