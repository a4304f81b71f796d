"""Top-k, embedding near-duplicates, URL filters, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext.llm import components, embdedup, queries, simhash, topk, toxicity, urlfilter

from ..conftest import SF_SMALL

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, q string, rep string"


@pytest.fixture(scope="module")
def vectors(spark):
    pick = np.random.default_rng(2)
    base = pick.standard_normal((300, 8)).astype(np.float32)
    base[100:140] = base[100] + pick.standard_normal((40, 8)).astype(np.float32) * 0.03  # a group of near copies
    base[150:190] = base[150]  # and one of exact ones
    base[200] = 3 * base[201]
    rows = [(k, v.tolist(), 1, "clash", "clash") for k, v in enumerate(base)]
    odd = [(None, [1.0] * 8), (400, None), (401, []), (402, [0.0] * 8), (403, [1.0] * 7 + [NAN]), (404, [INF] + [0.0] * 7), (405, [None] * 8), (406, [1.0, 2.0]), (407, [1.0, 2.1]), (408, [3e38] * 8), (5, base[5].tolist())]
    return spark.createDataFrame(rows + [(*o, 1, "", "") for o in odd], VECTORS)


def test_top_k(spark, vectors):
    kept = {}
    for r in vectors.collect():
        e = r.embedding
        if r.vec_id is not None and e and all(x is not None and np.isfinite(x) and abs(x) < 1e30 for x in e):
            kept[r.vec_id] = [int(np.floor(1024 * float(x))) for x in e]
    q = topk.quantised(vectors)
    assert {r.vec_id: r.q for r in q.collect()} == kept
    for k in (1, 10, 500):
        got = {}
        for r in topk.top_k(q, q.where("vec_id % 50 = 0 or vec_id > 400"), k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for query in [x for x in kept if x % 50 == 0 or x > 400]:
            scores = sorted((-sum(a * b for a, b in zip(kept[query], v)), i) for i, v in kept.items() if i != query and len(v) == len(kept[query]))
            assert sorted(got[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    assert topk.top_k(q.limit(0), q.limit(0), 3).count() == 0


def test_top_k_of_large_scores_is_exact(spark):
    pick = np.random.default_rng(8)
    big = [(int(k), (v * 1e5).tolist()) for k, v in enumerate(pick.standard_normal((60, 4)))]
    q = topk.quantised(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    own = {r.vec_id: r.q for r in q.collect()}
    assert len(own) == 60
    got = [(r.vec_id, r.score) for r in topk.top_k(q, q.where("vec_id = 0"), 5).orderBy("rank").collect()]
    scores = sorted((-sum(a * b for a, b in zip(own[0], v)), i) for i, v in own.items() if i)
    assert got == [(i, -s) for s, i in scores[:5]]


def test_top_k_in_groups_of_queries(spark, monkeypatch):
    """Queries in more groups and blocks than one, candidates in several steps, and a task that cuts what it holds."""
    for name, value in (("SENT", 40), ("BLOCK", 16), ("STEP", 8), ("HELD", 50)):
        monkeypatch.setattr(topk, name, value)
    pick = np.random.default_rng(9)
    own = [(k, pick.integers(-3, 4, 5).tolist()) for k in range(300)]  # many ties
    rows = spark.createDataFrame(own, "vec_id long, q array<long>")
    got = {}
    for r in topk.top_k(rows, rows.where("vec_id < 120"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for query in range(120):
        scores = sorted((-sum(a * b for a, b in zip(own[query][1], v)), i) for i, v in own if i != query)
        assert sorted(got[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]


def test_embedding_near_duplicates(spark, vectors):
    rows = {r.vec_id: r.embedding for r in vectors.orderBy(F.desc("vec_id")).collect() if r.vec_id is not None}
    good = {k: np.array(e, float) for k, e in rows.items() if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    unit = {k: (e / np.abs(e).max()) / np.linalg.norm(e / np.abs(e).max()) for k, e in good.items()}
    links = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and unit[k] @ unit[j] >= 0.95} for k in good}
    label = {k: k for k in rows}
    while True:
        new = {k: min([label[k], *(label[j] for j in links.get(k, ()))]) for k in rows}
        if new == label:
            break
        label = new
    want = sorted((k, len(links.get(k, ())), label[k], k == label[k]) for k in rows)
    got = sorted(tuple(r) for r in embdedup.near_duplicates(vectors, 0.95).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.97 * there  # none below the threshold
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.97 * len(want)
    assert embdedup.near_duplicates(vectors.limit(0)).count() == 0


def test_plan_keeps_recall_at_every_size():
    for rows in (10, 10**4, 10**7, 10**10):
        size, groups, window, least = embdedup.plan(rows, 0.95)
        pick = np.random.default_rng(1)
        a = np.eye(64)[0]
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * np.eye(64)[1]
        met = passed = 0
        for trial in range(60):
            g = pick.standard_normal((64, groups * size))
            offset = pick.random(groups * size) * embdedup.INTERVAL
            same = np.floor((a @ g + offset) / embdedup.INTERVAL) == np.floor((b @ g + offset) / embdedup.INTERVAL)
            met += same.reshape(groups, size).all(axis=1).any()
            passed += (np.abs((a - b) @ pick.standard_normal((64, embdedup.COUNTED))) <= window).sum() >= least
        assert met >= 56 and passed >= 58


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(900), pick.randrange(900)) for _ in range(500)] + [(5000 + k, 5001 + k) for k in range(70)] + [(9000, 9001 + k) for k in range(80)] + [(7, 7), (None, 3), (3, None), (5, 6), (6, 5)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            if a in new and b in new and a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    rows = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in components.connected_components(rows).collect()} == label
    assert components.connected_components(rows.limit(0)).count() == 0
    left, right = np.array([0, 4, 2, 5]), np.array([1, 3, 3, 0])
    assert components.star_edges(7, left, right).tolist() == [[1, 0], [3, 2], [4, 2], [5, 0]]


PAGES = [
    (1, "http://a.x.org/p?q=1#f", '<link href="https://news.net/es/1" rel="canonical">'),
    (2, "https://B.com:80/x", None),
    (3, None, ""),
    (4, "nohost", '<link rel="canonical" href="http://news.net/es/1">'),
    (5, "http://example.com/en/1", '<meta http-equiv="refresh" content="0; url=http://q.org/z?a=1&amp;b=2">'),
    (6, "https://q.org/z?a=1&b=2#top", ""),
    (7, "http://www.EXAMPLE.com/en/1", "<link rel=canonical href=/de/>"),
    (8, "http://r.org/", '<link rel="canonical" href="http://s.org"><META HTTP-EQUIV=Refresh CONTENT="5;URL=//k.com/">'),
    (9, "http://s.org/", '<link rel="stylesheet" href="http://news.net/es/1">'),
    (10, "ftp://s.org", '<link rel="canonical" href="http://news.net/fr/x">'),
    (11, "http://t.org/a/b", '<link rel="canonical" href="c">'),
    (12, "http://t.org/a/c", '<meta http-equiv="refresh" content="0;url=http://example.com/en/x">'),
    (1, "http://a.x.org/p?q=1", ""),
    (13, "http://notexample.com", "<p>canonical</p>"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, rule string, node string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {
        (1, "a.x.org", "/p"): (None, "block"),  # its canonical page is blocked
        (2, "b.com:80", "/x"): (None, "allow"),
        (3, "", ""): (None, "allow"),
        (4, "", ""): (None, "allow"),
        (5, "example.com", "/en/1"): ("example.com/en/", "block"),
        (6, "q.org", "/z"): (None, "block"),  # a blocked page redirects to it
        (7, "www.example.com", "/en/1"): ("www.example.com/en/", "allow"),  # the longest rule
        (8, "r.org", "/"): (None, "allow"),  # an allowed page in the group outweighs the blocked one
        (9, "s.org", "/"): (None, "allow"),
        (10, "s.org", ""): (None, "allow"),
        (11, "t.org", "/a/b"): (None, "block"),  # relative canonical link to a page that redirects to a blocked one
        (12, "t.org", "/a/c"): (None, "block"),
        (13, "notexample.com", ""): (None, "allow"),
    }
    assert urlfilter.judge(pages, rules).count() == len(PAGES)
    redirects = spark.createDataFrame([("http://notexample.com", "http://u.net/fr/"), (None, "http://x.org")], "src string, dst string")
    assert [r.verdict for r in urlfilter.judge(pages, rules, redirects).where("page_id = 13").collect()] == ["block"]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_pipeline_stages(spark):
    import corpus_pipeline

    pick = random.Random(6)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(80)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k] + "\n" + texts[k + 10] + " " + pick.choice(vocabulary)) for k in range(5)]  # only known lines
    rows += [(200, "fresh words stay here\n" + texts[0]), (201, None), (202, ""), (203, " ".join(texts[1].split()[:40] + texts[2].split()[:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    lines = corpus_pipeline.dedup_lines(spark, docs, SF_SMALL)
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert {k for k in got if k < 100} == set(range(30)) and not any(100 <= k < 105 for k in got)
    assert got[200].text == "fresh words stay here" and got[200].n_chars == 21 and {201, 202} <= set(got)
    one = corpus_pipeline.dedup_documents(spark, docs, SF_SMALL)
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in one.collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "packing"]


def test_pipeline_stages_take_empty_tables_and_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, n_chars int, key string, row string, fp int, lost int, score int, hash int"
    long = " ".join(f"word{k}" for k in range(60))
    ids = [(None, None), (None, ""), (3, None), (3, long), (3, long), (None, long), (4, " \n ")]
    docs = spark.createDataFrame([(i, t, 0, "a", "b", 1, 2, 3, 4) for i, t in ids], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_SMALL).collect() == []
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.dedup_documents(spark, docs, SF_SMALL).collect()))
    assert [t for _, t in kept if t.strip()] == [long] and len(kept) == 2
    assert corpus_pipeline.pack(spark, docs.limit(0), SF_SMALL).collect() == []
    pieces = corpus_pipeline.pack(spark, docs, SF_SMALL).collect()
    assert len(pieces) == len(ids) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces)


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert kept and not kept & toxic and kept <= {r.doc_id for r in docs.collect()}


def test_relative_targets_resolve_as_in_browsers(spark):
    want = {"?p=1": "/a/b?p=1", "./x": "/a/x", "../x?q=../y": "/x?q=../y", "../../x": "/x", "/c/./d/../e": "/c/e", "..": "/", ".": "/a/", "x/..": "/a/", "x.y/..z": "/a/x.y/..z"}
    pages = spark.createDataFrame([(k, "http://h/a/b", f'<link rel="canonical" href="{to}">') for k, to in enumerate(want)], "page_id long, url string, html string")
    assert sorted(r.dst for r in urlfilter.links(pages).collect()) == sorted(f"http://h{x}" for x in want.values())
