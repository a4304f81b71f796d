"""Text expressions (P1, P4, P5) and corpus preparation."""

import pytest
from pyspark.sql import functions as F

from bitext.functions.text import pretokenize, py_strip, word_count
from bitext.operators import corpus as C

PY_WHITESPACE = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_strip_and_split_match_python(spark):
    samples = [w + "a b" + w for w in PY_WHITESPACE] + ["​ x ​", "a\x1cb", " 😀 x "]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", py_strip("t").alias("s"), word_count("t").alias("n")).collect()
    for r in got:
        assert r.s == r.t.strip()
        assert r.n == len(r.t.split())


def test_pretokenize_matches_bert_pretokenizer(spark):
    from tokenizers.pre_tokenizers import BertPreTokenizer

    texts = [
        "我喜欢深度学习,deep-learning 你好。ok",
        "Hello, world! (x+y)=z; 'quote' \"dq\" [SOS]",
        "tabs\tand　ideographic space nbsp",
        "émigré naïve – em—dash … ellipsis «guillemets»",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(pretokenize("t").alias("p")).collect()]
    pre = BertPreTokenizer()
    want = [[w for w, _ in pre.pre_tokenize_str(t)] for t in texts]
    assert got == want


@pytest.mark.parametrize(
    "src,tgt,keep",
    [
        ("abc", "abcd", False),  # src 3 chars
        ("abcd", "abcd", True),
        ("a" * 64, "abcd", True),
        ("a" * 65, "abcd", False),
        ("abcd", " ".join(["w"] * 64), True),
        ("abcd", " ".join(["w"] * 65), False),
        (None, "abcd", False),
        ("", "abcd", False),
        ("    ", "abcd", True),  # unstripped length 4
        ("　　　　", "abcd", True),
        ("😀😀😀😀", "abcd", True),  # code points, not UTF-16 units
        ("😀😀😀", "abcd", False),
    ],
)
def test_pair_filter_bounds(spark, src, tgt, keep):
    df = spark.createDataFrame([(1, src, tgt)], "pair_id long, src string, tgt string")
    assert (C.filter_pairs(df).count() == 1) is keep


def test_clean_removes_cr_and_drops_empty(spark):
    df = spark.createDataFrame(
        [(1, " a\r\nb ", "x"), (2, "\n", "y"), (3, "ok", " ")], "pair_id long, src string, tgt string"
    )
    got = {r.pair_id: (r.src, r.tgt) for r in C.clean_pairs(df).collect()}
    assert got == {1: ("a  b", "x")}


def _split_rows(spark, n, sanity, main, test, parts):
    df = spark.range(n).select(F.col("id").alias("pair_id"), F.lit("abcd").alias("src"), F.lit("abcd").alias("tgt"))
    out = C.split_corpus(df, sanity, main, test, num_partitions=parts)
    return sorted((r.split, r.pos, r.pair_id) for r in out.collect())


def test_split_ranges_overlap_and_no_production(spark):
    rows = _split_rows(spark, 30, 20, 100, 15, 4)
    by = {}
    for s, p, _ in rows:
        by.setdefault(s, []).append(p)
    assert by["sanity"] == list(range(0, 20))
    assert by["test"] == list(range(15, 30))  # overlaps sanity: N < sanity + test
    assert "production" not in by  # min(120, 15) <= 20


def test_split_production_range(spark):
    rows = _split_rows(spark, 100, 10, 30, 20, 3)
    prod = sorted(p for s, p, _ in rows if s == "production")
    assert prod == list(range(10, 40))


def test_positions_invariant_to_partitioning(spark):
    base = _split_rows(spark, 257, 50, 100, 40, 1)
    for parts in (4, 16, 64):
        assert _split_rows(spark, 257, 50, 100, 40, parts) == base


def test_shuffle_is_md5_order(spark):
    import hashlib

    df = spark.range(50).select(F.col("id").alias("pair_id"))
    got = [r.pair_id for r in C.shuffled_positions(df, num_partitions=5).orderBy("pos").collect()]
    want = sorted(range(50), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == want


def test_align_compact_vs_pair(spark):
    src = spark.createDataFrame([(0, "a"), (1, " "), (2, "c")], "line_no long, text string")
    tgt = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "line_no long, text string")
    pair = sorted((r.src, r.tgt) for r in C.align_pairs(src, tgt, "pair").collect())
    compact = sorted((r.src, r.tgt) for r in C.align_pairs(src, tgt, "compact").collect())
    assert pair == [("a", "A"), ("c", "C")]
    # Reference behaviour: blanks dropped per side, then zipped -> shifted.
    assert compact == [("a", "A"), ("c", "B")]


def test_empty_guard(spark):
    df = spark.createDataFrame([(1, "ab", "cd")], "pair_id long, src string, tgt string")
    with pytest.raises(ValueError):
        C.ensure_not_empty(C.filter_pairs(df))


def test_read_lines_across_split_blocks(spark, tmp_path):
    from bitext.sources.text_files import read_lines

    lines = [f"line {i} " + "x" * (i % 97) for i in range(20000)]
    path = tmp_path / "big.txt"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = read_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4  # really split into blocks
        got = {r.line_no: r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))


def _pairs(spark, n):
    rows = [(i, "train" if i % 3 else "rest", f"源 {i}", f"target {i}") for i in range(n)]
    return spark.createDataFrame(rows, "pair_id long, split string, src string, tgt string").repartition(3)


def test_corpus_is_written_by_split_and_read_in_order(spark, tmp_path):
    from bitext.sources.corpus import read_corpus, write_corpus

    path = str(tmp_path / "corpus")
    assert write_corpus(_pairs(spark, 1000), path) == 1000
    for split, want in (("train", [i for i in range(1000) if i % 3]), ("rest", list(range(0, 1000, 3)))):
        df = read_corpus(spark, path, split=split)
        got = sorted((r.pair_id, r.src, r.tgt) for r in df.collect())
        assert got == [(k, f"源 {i}", f"target {i}") for k, i in enumerate(want)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan
        # the texts' scan is joined where it is: every exchange is of blocks, without text columns
        for line in plan.splitlines():
            if "Exchange" in line and "BroadcastExchange" not in line:
                assert "text_zh" not in line and "src" not in line
    assert read_corpus(spark, path, split="absent").count() == 0
    with pytest.raises(ValueError, match="columns found: text_zh, text_en, split"):
        read_corpus(spark, path, src_col="zh")


def test_an_empty_corpus_replaces_nothing(spark, tmp_path):
    from bitext.sources.corpus import read_corpus, write_corpus

    path = str(tmp_path / "corpus")
    write_corpus(_pairs(spark, 10), path)
    with pytest.raises(ValueError, match="empty"):
        write_corpus(_pairs(spark, 10).where("src = 'none'"), path)
    assert read_corpus(spark, path, split=None).count() == 10
    assert write_corpus(_pairs(spark, 4), path) == 4
    assert read_corpus(spark, path, split=None).count() == 4


def test_files_of_more_than_five_digits_come_in_their_order(spark):
    from bitext.operators.positions import file_position

    names = ["d/part-99998-x", "d/part-99999-x", "d/part-100000-x", "e/part-00000-x"]
    rows = [(n, b, 100 * k + 10 * b + i, f"{n}/{b}/{i}") for k, n in enumerate(names) for b in (0, 4) for i in range(3)]
    df = spark.createDataFrame(rows[::-1], "_file string, _block long, _row long, text string")
    got = {r.text: r.pos for r in file_position(df).collect()}
    assert [got[r[3]] for r in rows] == list(range(len(rows)))


def test_user_predicates(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [(1, "abcd", "good text", "x"), (2, "abcd", "bad text", None), (3, "abc", "good text", "x"), (4, "efgh", "good again", "y"), (5, "abcd", None, "z")]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string, extra string").repartition(2)
    ids = lambda d: sorted(r.pair_id for r in d.collect())
    by_rule = C.filter_pairs(df, predicate=lambda src, tgt: tgt.startswith("good") & (F.length(src) == 4))
    assert ids(by_rule) == [1, 4] and ids(C.filter_pairs(df, predicate=F.col("tgt").startswith("good"))) == [1, 4]
    assert ids(C.filter_pairs(df, predicate=lambda src, tgt: F.when(tgt.startswith("good"), True))) == [1, 4]
    seen = lambda batch: pc.equal(batch.column("extra"), "x")
    by_batch = C.filter_pairs(df, batch_predicate=seen, batch_columns=["extra"])
    assert ids(by_batch) == [1] and by_batch.columns == df.columns
    assert ids(C.filter_pairs(df, batch_predicate=lambda b: pa.array([True] * b.num_rows))) == [1, 2, 4]
    assert ids(C.filter_pairs(df.limit(0), batch_predicate=seen, batch_columns=["extra"])) == []
    # the expression rule is pushed below a shuffle
    plan = C.filter_pairs(df, predicate=lambda s, t: t != "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("Repartition")
