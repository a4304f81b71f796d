"""Property tests: the BPE merge rewrite and bucketed positions against
plain-Python brute force on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitext.operators.positions import bucketed_position
from bitext.operators.vocab import merge_pair_text


def py_merge(ids, left, right, new):
    """Left to right, non-overlapping replacement of (left, right)."""
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and ids[i] == left and ids[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


seqs = st.lists(st.lists(st.integers(4, 7), min_size=1, max_size=12), min_size=1, max_size=30)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=seqs, left=st.integers(4, 7), right=st.integers(4, 7))
def test_merge_rewrite_matches_python(spark, words, left, right):
    new = 99
    rows = [(i, " " + " ".join(map(str, w)) + " ") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {r.k: r.m for r in df.select("k", merge_pair_text(F.col("s"), left, right, new).alias("m")).collect()}
    for i, w in enumerate(words):
        assert got[i].split() == [str(x) for x in py_merge(w, left, right, new)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=60, unique=True
    )
)
def test_bucketed_position_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g int, b int, o int")
    got = {(r.g, r.b, r.o): r.pos for r in bucketed_position(df, ["b"], ["o"], group_cols=["g"]).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((b, o) for gg, b, o in rows if gg == g)
        for i, (b, o) in enumerate(ordered):
            assert got[(g, b, o)] == i
