"""BPE (P6, P7, J2) against the public `tokenizers` library; sequence
operators (P8, P11, P12, B6-B9)."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitext.operators import sequences as Q
from bitext.operators import vocab as V

SPECIALS = ["[PAD]", "[UNK]", "[SOS]", "[EOS]"]


def _hf_train(texts, vocab_size):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors, trainers

    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    tr = trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=2, special_tokens=SPECIALS, show_progress=False)
    tok.train_from_iterator(texts, trainer=tr)
    tok.post_processor = processors.TemplateProcessing(
        single="[SOS] $A [EOS]", pair="[SOS] $A [EOS] [SOS] $B [EOS]", special_tokens=[("[SOS]", 2), ("[EOS]", 3)]
    )
    return tok


def _train(spark, texts, merges):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return V.train_bpe(V.word_counts(df), max_merges=merges)


@pytest.mark.parametrize(
    "texts",
    [
        ["ab cd", "ab cd"],  # tied counts
        ["cd ab", "cd ab"],
        ["ba ab ba ab"],
        ["low lower lowest newer wider new", "low low lower newest widest"],
        ["aaaa aaa aa", "abab abab"],  # overlapping pairs
    ],
)
def test_bpe_matches_library_on_ties(spark, texts):
    model = _train(spark, texts, 20)
    alpha = len(model.vocab) - len(model.merges)
    hf = _hf_train(texts, alpha + 20)
    assert hf.get_vocab() == model.vocab


def test_bpe_queries_train_beyond_a_large_alphabet(spark, tmp_path):
    """2,200 distinct characters, as in Chinese text, leave room for all merges that occur twice."""
    from bitext.plans import fixtures as fx
    from bitext.plans import q_vocab

    letters = [chr(0x4E00 + k) for k in range(2200)]
    lines = ["".join(letters[k : k + 20]) for k in range(0, 2200, 20)] + ["low lower lowest newer wider new low low"] * 2
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "low newest\nwide"), (1, 1, "assistant", "lower wide\nnewest")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    model = q_vocab.train_model(spark, str(tmp_path))
    texts = [r.text for r in fx.vocab_corpus(spark, str(tmp_path)).collect()]
    hf = _hf_train(texts, 32000)
    assert len(model.merges) > 10 and hf.get_vocab() == model.vocab
    got = {r.pair_id: (r.src_ids, r.tgt_ids) for r in q_vocab.bpe_encode(spark, str(tmp_path)).collect()}
    want = {r.pair_id: tuple(" ".join(map(str, hf.encode(t).ids)) for t in (r.src, r.tgt)) for r in fx.line_pairs(spark, str(tmp_path)).collect()}
    assert got == want


def _rounds(spark, texts, size, **kw):
    """The model, and how many merges each round found."""
    seen = []
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return V.train_bpe(V.word_counts(df), vocab_size=size, on_round=lambda r, n: seen.append(n), **kw), seen


@pytest.mark.parametrize("touched", [4, 40, 400, 1 << 17])
def test_bpe_rounds_of_any_size_match_library(spark, touched):
    """Rounds of counted triples only, of both kinds, and one round of touched words."""
    rng = random.Random(touched)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(8)]
    size = 30 if touched < 400 else 80
    model, seen = _rounds(spark, texts, size, touched=touched, candidates_per_round=16 if touched < 400 else 8192)
    assert _hf_train(texts, size).get_vocab() == model.vocab
    assert touched < 1 << 17 or len(seen) == 1


def test_full_vocabulary_and_all_pairs_match_library(spark):
    """32,000 tokens or no pair that occurs twice, over all texts; then every pair encoded, whole."""
    from bitext.plans import fixtures as fx

    from .conftest import SF_SMALL

    texts = [r.text for r in fx.vocab_corpus(spark, SF_SMALL).collect()]
    model, seen = _rounds(spark, texts, V.VOCAB_SIZE, touched=1 << 14)
    hf = _hf_train(texts, V.VOCAB_SIZE)
    assert hf.get_vocab() == model.vocab and len(seen) > 3
    hf.post_processor = None
    rows = fx.line_pairs(spark, SF_SMALL).select("src", V.bpe_encode_column(model, F.col("src")).alias("ids")).collect()
    assert rows and all(r.ids == hf.encode(r.src, add_special_tokens=False).ids for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.text("abc", min_size=2, max_size=9)), min_size=1, max_size=12, unique_by=lambda x: x[1]), st.integers(1, 30))
def test_merging_in_touched_words_equals_merging_in_all(words, size):
    """With a head of some pairs, the merges found are the first of those of merging in all words."""
    letters = {c: i for i, c in enumerate("abc")}
    rows = [(n, [letters[c] for c in w]) for n, w in words]
    counts = {}
    for n, ids in rows:
        for p in zip(ids, ids[1:]):
            counts[p] = counts.get(p, 0) + n
    order = sorted(((-n, *p) for p, n in counts.items()))
    whole = V.merge_touched(rows, counts, None, letters, 40, 1)
    head = {p: counts[p] for _, *p in order[:size] for p in [tuple(p)]}
    floor = order[size] if size < len(order) else None
    touched = [(n, ids) for n, ids in rows if any(p in head for p in zip(ids, ids[1:]))]
    part = V.merge_touched(touched, head, floor, letters, 40, 1)
    assert part and part == whole[: len(part)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.text("abcde", min_size=2, max_size=14)), min_size=1, max_size=12, unique_by=lambda x: x[1]), st.integers(1, 30), st.integers(1, 3), st.sampled_from([0, 512]))
def test_merging_in_stretches_equals_merging_in_whole_words(words, size, context, few):
    """Equal stretches counted together, cut at one to three symbols, with arrays and word by word."""
    letters = {c: i for i, c in enumerate("abcde")}
    rows = [(n, [letters[c] for c in w]) for n, w in words]
    counts = {}
    for n, ids in rows:
        for p in zip(ids, ids[1:]):
            counts[p] = counts.get(p, 0) + n
    order = sorted((-n, *p) for p, n in counts.items())
    head = {(left, right): -n for n, left, right in order[:size]}
    whole = V.merge_touched(rows, counts, None, letters, 40, 1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(V, "CONTEXT", context)
        patch.setattr(V, "FEW_PAIRS", few)
        row, found = V._stretches(pa.array([ids for _, ids in rows], pa.list_(pa.int32())), V._packed(head))
        alike = {}
        for r, ids in zip(row.tolist(), found.to_pylist()):
            alike[tuple(ids)] = alike.get(tuple(ids), 0) + rows[r][0]
        part = V.merge_touched([(n, list(ids)) for ids, n in alike.items()], head, order[size] if size < len(order) else None, letters, 40, 1)
    assert part and part == whole[: len(part)]


def test_equal_stretches_are_counted_once(spark, monkeypatch):
    """Pairs that stand in 676 words but in few stretches fit a task of 200: no round falls back to counted triples."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"{a}{b}uvabcdefwx{b}{a}" for a in letters for b in letters]
    monkeypatch.setattr(V, "_counted_merges", None)
    model, seen = _rounds(spark, texts, 4 + 36 + 3, touched=200)
    assert _hf_train(texts, 4 + 36 + 3).get_vocab() == model.vocab and sum(seen) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=9), min_size=1, max_size=12), st.lists(st.text("abc", min_size=2, max_size=2), min_size=1, max_size=6, unique=True))
def test_merges_of_a_round_are_applied_in_rank_order(words, merges):
    """All words at once give what each merge by itself, one after the other, gives in each word."""
    letters = {c: i for i, c in enumerate("abc")}
    ranks = {(letters[p[0]], letters[p[1]]): (r, 3 + r) for r, p in enumerate(merges)}
    flat = np.array([letters[c] for w in words for c in w], np.int64)
    got = {}
    for number, symbols, sizes in V._merge_rows(flat, np.array([len(w) for w in words]), ranks):
        ends = np.cumsum(sizes)
        got |= {k: symbols[b - n : b].tolist() for k, b, n in zip(number.tolist(), ends.tolist(), sizes.tolist())}
    want = {}
    for k, w in enumerate(words):
        ids = [letters[c] for c in w]
        for (left, right), (_, new) in ranks.items():
            out = []
            for i in ids:
                merged = out and out[-1] == left and i == right
                out[-1:] = [new] if merged else out[-1:] + [i]
            ids = out
        want[k] = ids
    assert got == want


def test_a_merge_costs_what_it_changes():
    """Each of 500 merges changes a few of 300,000 words. Passing over all words for each took as long as 40 sorts of
    their symbols; all of it takes 3."""
    import time

    rng = np.random.default_rng(1)
    rows = [(1, ids) for ids in rng.integers(0, 1000, (300_000, 8)).tolist()]
    table = pa.table([pa.array([n for n, _ in rows], pa.int64()), pa.array([ids for _, ids in rows], pa.list_(pa.int32()))], ["freq", "ids"])
    began = time.process_time()
    symbols = rng.integers(0, 1 << 40, 2_400_000)
    for _ in range(4):
        np.sort(symbols.copy(), kind="stable")
    sorts = (time.process_time() - began) / 4
    began = time.process_time()
    merge = V._merging(table, V._packed((2 * k, 2 * k + 1) for k in range(500)))
    merged = sum(-merge((2 * k, 2 * k + 1), 1000 + k).get((2 * k, 2 * k + 1), 0) for k in range(500))
    assert time.process_time() - began < 20 * sorts
    ids = np.array([ids for _, ids in rows])
    assert merged == ((ids[:, :-1] % 2 == 0) & (ids[:, 1:] == ids[:, :-1] + 1)).sum()


def test_bpe_train_and_encode_match_library_on_documents(spark):
    from bitext.plans import fixtures as fx

    from .conftest import SF_SMALL

    texts = [r.text for r in fx.vocab_corpus(spark, SF_SMALL).collect()]
    model = _train(spark, texts, 40)
    alpha = len(model.vocab) - len(model.merges)
    hf = _hf_train(texts, alpha + 40)
    assert hf.get_vocab() == model.vocab
    sample = texts[:200] + ["龘龘 the [SOS] 龘", "", "x[EOS]y"]
    df = spark.createDataFrame(list(enumerate(sample)), "k long, text string")
    got = {
        r.k: r.ids
        for r in df.select("k", Q.with_template(V.bpe_encode_column(model, F.col("text"))).alias("ids")).collect()
    }
    for k, t in enumerate(sample):
        assert got[k] == hf.encode(t).ids, t


def test_unknown_and_special_literals(spark):
    model = _train(spark, ["the the the"], 5)
    df = spark.createDataFrame([("龘龘 the [SOS] 龘",)], "text string")
    ids = df.select(Q.with_template(V.bpe_encode_column(model, F.col("text"))).alias("i")).first().i
    inv = model.id_to_token
    assert [inv[i] for i in ids] == ["[SOS]", "[UNK]", "[UNK]", "the", "[SOS]", "[UNK]", "[EOS]"]


def test_truncation_loses_eos_and_empty_text(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "ids array<int>")
    got = [r.t for r in df.select(Q.truncate(Q.with_template("ids"), 4).alias("t")).collect()]
    assert got == [[2, 5, 6, 7], [2, 3]]


def test_pad_batches_polarity_and_short_last_batch(spark):
    rows = [(0, [2, 5, 3], [2, 9, 9, 3]), (1, [2, 3], [2, 3]), (2, [2, 7, 7, 7, 3], [2, 3])]
    df = spark.createDataFrame(rows, "pos long, src_ids array<int>, tgt_ids array<int>")
    out = {r.pos: r for r in Q.pad_batches(Q.assign_batches(df, "pos", 2)).collect()}
    assert out[0].src_ids == [2, 5, 3] and out[1].src_ids == [2, 3, 0]
    assert out[1].tgt_ids == [2, 3, 0, 0]
    assert out[1].attention_mask == [True, True, False]  # real tokens
    assert out[1].src_pad_mask == [False, False, True]  # pad positions
    assert out[2].batch_id == 1 and out[2].src_ids == [2, 7, 7, 7, 3]  # short last batch kept


def _followers(seq, n):
    """What followed the last n-1 tokens wherever they stood before, from a map
    of every context to its followers."""
    after = {}
    for context, token in ((tuple(seq[i - n + 1 : i]), seq[i]) for i in range(n - 1, len(seq))):
        after.setdefault(context, set()).add(token)
    return sorted(after.get(tuple(seq[len(seq) - n + 1 :]), ()))


def test_ngram_block_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    seqs = [[rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(300)] + [[1, 2], [1, 2, 1, 2, 1, 2]]
    df = spark.createDataFrame([(s,) for s in seqs], "s array<int>")
    for n in (2, 3, 4):
        got = [r.b for r in df.select(Q.blocked_next("s", n).alias("b")).collect()]
        assert got == [_followers(s, n) for s in seqs]


def test_detokenize_keeps_repeats_and_drops_unknown_ids(spark):
    vocab = spark.createDataFrame([(0, "[PAD]"), (2, "[SOS]"), (3, "[EOS]"), (5, "a"), (6, ","), (7, "##b")], "id int, token string")
    df = spark.createDataFrame([(1, [2, 5, 5, 99, 6, 7, 3, 0])], "k long, ids array<int>")
    ev = Q.detokenize(df, "k", "ids", vocab, "evaluate").first().text
    inf = Q.detokenize(df, "k", "ids", vocab, "inference").first().text
    assert ev == "a a ,b"
    assert inf == "a a,b"
