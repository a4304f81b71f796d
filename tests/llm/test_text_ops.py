"""Tokens, packing, files, lexicon, toxicity, line dedup, SimHash and LM scoring against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitext.llm import bytebpe, lexicon, linededup, lmscore, packing, queries, simhash, simple8b, toxicity
from bitext.llm.common import utf8

from ..conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.bpe_path()
#: Null id and text, empty and blank texts, a repeated row, a special token's string, a long text.
EDGE = [(None, None), (9000, ""), (9001, "x <|endoftext|>  's y"), (9002, "a b\nA  B\n c"), (9002, "a b\nA  B\n c"), (9003, " \n\t"), (9004, "été ½ 日本 " * 4000), (None, "x")]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with edge cases and columns whose names the operators use themselves."""
    own = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = own.unionByName(spark.createDataFrame(EDGE, "doc_id long, text string"))
    return rows.selectExpr("doc_id", "text", "1 as h", "2 as fp", "3 as ids", "'x' as start", "4 as component", "5 as leftover")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabst' '\n\tré1²日!　 lvemd\x85\x1c<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_batch_encoder_equals_the_library(texts):
    library, bpe = tokenizers.Tokenizer.from_file(PATH), bytebpe.tokenizer(PATH)
    for words in (None, bytebpe.memo(PATH)):
        ids, bounds = bpe.encode(*utf8(pa.array(texts, pa.string())), words)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(library, t) for t in texts]


def test_packing(spark, docs, library):
    rows = packing.pack(docs, PATH, window=64, end_id=1, open_windows=4).collect()
    want = Counter(tuple(ids_of(library, r.text) + [1]) for r in docs.collect())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([len(r.ids) // 4 for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= 64
    used = sum(len(r.ids) // 4 for r in rows)
    assert used == sum(len(k) * n for k, n in want.items())
    assert used >= 0.9 * 64 * len(sequences)
    named = defaultdict(dict)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 9002:
            named[r.doc_id][r.start] = r
    for r in docs.where("doc_id is not null and doc_id <> 9002").collect():
        parts = [named[r.doc_id][k] for k in sorted(named[r.doc_id])]
        whole = ids_of(library, r.text) + [1]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == whole
        assert {p.doc_tokens for p in parts} == {len(whole)}
        assert [p.start for p in parts] == [0, *np.cumsum([len(p.ids) // 4 for p in parts])[:-1]]
    assert packing.pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 3), st.integers(2**58, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(ids, times):
    ids = np.array(ids * times, np.uint64)
    assert (simple8b.decode(*simple8b.encode(ids), len(ids)) == ids).all()
    lengths = [len(ids), 0]
    doc_ids, found, back = simple8b.from_bytes(simple8b.to_bytes([None, -3], lengths, ids))
    assert doc_ids == [None, -3] and found.tolist() == lengths and (back == ids).all()


def test_simple8b_is_dense_and_refuses_other_files():
    words, _, _ = simple8b.encode(np.ones(6000, np.uint64))
    assert len(words) == 69 + 32  # 60 to a word, in blocks of 4,096
    with pytest.raises(ValueError):
        simple8b.from_bytes(b"something else")
    with pytest.raises(ValueError):
        simple8b.from_bytes(simple8b.to_bytes([1], [1], np.ones(1, np.uint64)) + b"x")


def test_token_files(spark, docs, library, tmp_path):
    files = simple8b.write_token_files(docs, f"file://{tmp_path}/ids", PATH, end_id=2)
    rows = sorted(simple8b.read_token_files(spark, f"file://{tmp_path}/ids", files).collect(), key=lambda r: (r.start))
    assert files.count() >= 4
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids_of(library, texts[r.doc_id]) + [2] for r in rows if r.doc_id is not None)
    none = simple8b.write_token_files(docs.limit(0), f"file://{tmp_path}/none", PATH)
    assert simple8b.read_token_files(spark, f"file://{tmp_path}/none", none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=8), max_size=40))
def test_automaton_knows_exactly_its_words(tmp_path_factory, known, other):
    known = sorted(known)
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(lexicon.compile_lexicon(known, bytebpe.tokenizer(PATH)))
    asked = known + other
    at = np.append(0, np.cumsum([len(w) for w in asked])).astype(np.int64)
    number = {w: k for k, w in enumerate(known)}
    found = lexicon.Lexicon(str(path)).look_up(np.frombuffer(b"".join(asked), np.uint8), at)
    assert found.tolist() == [number.get(w, -1) for w in asked]


def test_automaton_is_minimal():
    arcs, final, start = lexicon.automaton([b"cats", b"cots", b"dogs", b"hogs"])
    assert len(arcs) == 7  # start; after c; after d or h; after ca or co; after do or ho; before s; the end
    arcs, final, start = lexicon.automaton([])
    assert arcs == [{}] and final == [False]


def test_lexicon_encodes_and_decodes(spark, docs, library):
    rows = lexicon.encode_decode(docs, PATH).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows)
    want = Counter()
    for r in docs.collect():
        ids = ids_of(library, r.text)
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert lexicon.encode_decode(docs.limit(0), PATH).count() == 0
    assert lexicon.decode(np.array([50256, 223]), np.array([0, 1, 2]), PATH) == ["<|endoftext|>", library.decode([223])]


def plain_fingerprint(text, k=3):
    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(table))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if i == j or linked(i, j)) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash(spark, docs):
    source = docs.collect()
    near = [(500 + k, r.text + " one more word") for k, r in enumerate(source[:20]) if r.text]
    both = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(near, "doc_id long, text string").withColumn("fp", F.lit(0)))
    rows = both.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    label = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for k, r in zip(label, rows):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, fp, least.get(k)) for r, fp, k in zip(rows, fps, label))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(both).collect())
    assert got == want
    kept = simhash.keep_one(both)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(both.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abC \t\né", max_size=200), st.integers(1, 4), st.integers(1, 40))
def test_a_text_read_in_pieces_has_the_same_fingerprint(text, k, most):
    raw = np.frombuffer(text.encode(), np.uint8)
    got = simhash.fingerprint_rows(raw, np.array([0, len(raw)]), k, most)
    assert got.tolist() == [plain_fingerprint(text, k)]


def test_a_very_long_text_has_a_fingerprint_in_bounded_memory():
    raw = np.tile(np.frombuffer(b"some words that go on and on, one after another; ", np.uint8), 200_000)
    tracemalloc.start()
    simhash.fingerprint_rows(raw, np.array([0, len(raw)]), 3)
    assert tracemalloc.get_traced_memory()[1] < 6 * len(raw)
    tracemalloc.stop()


def test_vantage_tree_finds_every_pair_once():
    pick = np.random.default_rng(3)
    base = pick.integers(0, 2**64, 400, dtype=np.uint64)
    near = [base ^ (np.uint64(mask) << pick.integers(0, 60, 400).astype(np.uint64)) for mask in (1, 3, 5, 7)]
    fps = np.unique(np.concatenate([base, *near]))
    tree = simhash.VantageTree(fps[::3], 4)
    index, leaf, home = tree.route(fps, 2)
    assert np.bincount(index[home], minlength=len(fps)).tolist() == [1] * len(fps)
    found = []
    for x in np.unique(leaf):
        own = leaf == x
        if (own & home).any():
            found += zip(*simhash.pairs_within(np.sort(fps[index[own & home]]), np.sort(fps[index[own & ~home]]), 2))
    left, right = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert sorted(tuple(sorted(p)) for p in found) == sorted(zip(fps[left], fps[right]))


def test_line_groups(spark, docs):
    near = [(700, "The quick brown fox jumps over the lazy dog near the river bank today\nanother line"), (701, "the quick  brown fox jumps over the lazy dog near the river bank Today!"), (702, "The quick brown fox sleeps")]
    both = docs.select("doc_id", "text", "h").unionByName(spark.createDataFrame(near, "doc_id long, text string").withColumn("h", F.lit(0)))
    places, texts = defaultdict(list), {}
    for doc_id, text in {(r.doc_id, r.text) for r in both.collect()}:
        for number, line in enumerate((text or "").split("\n")):
            plain = " ".join(re.findall(r"[^ \t\n\x0b\x0c\r]+", line.lower()))
            if plain:
                places[plain].append((doc_id is None, doc_id or 0, number))
    lines = sorted(places)
    sets = [linededup.shingles(x) for x in lines]
    holders = defaultdict(list)
    label = list(range(len(lines)))

    def root(x):
        return x if label[x] == x else root(label[x])

    for k, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in holders[s]).items():
            if common >= 0.8 * (len(own) + len(sets[j]) - common):
                label[root(k)] = root(j)
        for s in own:
            holders[s].append(k)
    first = {}
    for k, line in enumerate(lines):
        first[root(k)] = min([*places[line], first.get(root(k), (True, math.inf, 0))])
    want = {p: first[root(k)] for k, line in enumerate(lines) for p in places[line]}
    rows = linededup.line_groups(both).collect()
    got = {(r.doc_id is None, r.doc_id or 0, r.line_no): (r.group_doc is None, r.group_doc or 0, r.group_line) for r in rows}
    assert got == want
    assert {(r.doc_id, r.line_no) for r in rows if r.kept} == {(None if p[0] else p[1], p[2]) for p in first.values()}
    kept = {r.doc_id: r.text for r in linededup.drop_lines(both).collect()}
    assert kept[700].startswith("The quick") and 701 not in kept and kept[702] == near[2][1]
    assert kept[9002] == "a b\n c" and kept[9000] == "" and kept[9003] == EDGE[5][1]
    assert linededup.drop_lines(both).columns == both.columns
    assert linededup.line_groups(both.limit(0)).count() == 0


def test_lines_outside_their_buckets_smallest_are_compared_too(spark):
    """Lines a-b and b-c are near, a-c are not: all three are one group, whatever line a bucket is held against."""
    body = [f"word{k}" for k in range(60)]
    chain = [" ".join(body[s : s + 50]) for s in (0, 4, 8)]
    rows = linededup.line_groups(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).collect()
    a, b, c = (linededup.shingles(x) for x in chain)
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
    assert {(r.group_doc, r.group_line) for r in rows} == {(0, 0)}


def test_a_short_lines_bands_are_its_own(spark):
    """Lines shorter than a shingle have the same bands whatever follows them, and do not meet in the second scan with others."""
    def bands(*lines):
        body = np.frombuffer("".join(lines).encode(), np.uint8)
        return linededup.band_keys(body, np.cumsum([0, *(len(x.encode()) for x in lines)]))

    for line in ("a", "ab", "日本", "abcdefg", "abcdefgh", "abcdefghi"):
        alone = bands(line)[0].tolist()
        for rest in (["x"], ["cdefghij klm"], ["日本", "y"], ["b", "c", "d", "e", "f", "g", "h", "i"]):
            assert bands(line, *rest)[0].tolist() == alone
    # both begin with the same eight characters if the next line is read on
    texts = ["ab\ncdefgh ij", "abc\ndefgh kl", "one line more", "ab\ncdefgh ij"]
    rows = linededup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.group_doc, r.group_line) for r in rows} == {(0, 0): (0, 0), (0, 1): (0, 1), (1, 0): (1, 0), (1, 1): (1, 1), (2, 0): (2, 0), (3, 0): (0, 0), (3, 1): (0, 1)}


def test_toxicity(spark):
    pick = random.Random(4)
    plain = "the quiet river runs past green hills and old stone houses where people meet".split()
    bad = ["vermin", "idiotic", "loathsome"]

    def text(toxic):
        words = [pick.choice(plain) for _ in range(60)]
        for k in range(4 * toxic):
            words[pick.randrange(60)] = pick.choice(bad) + pick.choice(["", "s", "ly"])
        return " ".join(words)

    rows = [(k, text(k % 4 == 0), "clash") for k in range(1200)]
    docs = spark.createDataFrame([*rows, (None, None, ""), (5000, "", ""), (5001, "VERMIN idiotic loathsome " * 2000, ""), (3, rows[3][1], "")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)] + [(None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 1200 and (r.held_out or r.doc_id >= 900)]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in known) >= 0.97 * len(known)
    by = {r.doc_id: r for r in out}
    assert by[5001].predicted == 1 and by[5000].score == by[None].score
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id) for r in out if not r.predicted or r.doc_id is None)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_no_model_removes_no_document(spark):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7}") for k in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("toxic"))
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.where(toxicity.held_out(F.col("doc_id")))):
        assert sorted(map(str, toxicity.keep_clean(docs, none).collect())) == sorted(map(str, docs.collect()))


def test_a_sample_is_chosen_from_crowded_parts(spark):
    known = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as y")
    for most, bits in ((16, 2), (5, 1), (1000, 2)):
        chosen = [r.doc_id for r in toxicity.choose(known, most, bits).collect()]
        assert 0 < len(chosen) == len(set(chosen)) <= most
    assert toxicity.choose(known.limit(0), 16, 2).count() == 0


def test_labels_of_held_out_documents_are_not_learnt(spark):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7}") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, turned).collect())


def test_lm_score(spark, docs):
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    texts = {k: r.text for k, r in enumerate(docs.collect())}
    aimed = {k for k, r in enumerate(docs.collect()) if r.doc_id is not None and r.doc_id % 3 == 0}
    words = {k: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w] for k, t in texts.items()}
    total = Counter(w for own in words.values() for w in own)
    known = max(({w for w in total if total[w] >= n} for n in set(total.values()) if sum(m >= n for m in total.values()) < 1 << 16), key=len)
    classes = {k: [w if w in known else None for w in own] for k, own in words.items()}

    def model(own):
        pairs = Counter(p for k in own for p in zip([None, *classes[k][:-1]], classes[k]))
        single, before = Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b] += n
            before[a] += n
        mass = sum(single.values()) + lmscore.ALPHA * (len(total) + 1)
        return lambda a, b: -math.log((pairs[a, b] + lmscore.MU * (single[b] + lmscore.ALPHA) / mass) / (before[a] + lmscore.MU))

    background, goal = model(list(classes)), model(aimed)
    want = sorted((len(c), sum(goal(a, b) - background(a, b) for a, b in zip([None, *c[:-1]], c)) / max(len(c), 1)) for c in classes.values())
    got = sorted((r.n_tokens, r.score) for r in lmscore.cross_entropy_difference(docs, target).collect())
    assert [n for n, _ in got] == [n for n, _ in want]
    assert sorted(s for _, s in got) == pytest.approx(sorted(s for _, s in want), abs=1e-5)
    assert lmscore.cross_entropy_difference(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_lm_score_tells_rare_words_apart(spark, monkeypatch, held):
    """Far more words than the table of frequent ones holds, most of them equally rare: each counts as itself, also
    those with more occurrences than a task may hold."""
    monkeypatch.setattr(lmscore, "HELD", held)
    pick = random.Random(5)
    texts = [" ".join(pick.choice([f"w{pick.randrange(7000)}", f"{'ab'[k % 2]}{pick.randrange(3000)}", "the", "of"]) for _ in range(pick.randrange(120))) for k in range(400)]
    texts += ["solo", "solo solo solo", "the", "", "a1 the a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    assert len({w for own in words for w in own}) > lmscore.FREQUENT

    def model(own):
        pairs = Counter(p for w in own for p in zip([None, *w[:-1]], w))
        single, before = Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b] += n
            before[a] += n
        mass = sum(single.values()) + lmscore.ALPHA * (len({w for own in words for w in own}) + 1)
        return lambda a, b: -math.log((pairs[a, b] + lmscore.MU * (single[b] + lmscore.ALPHA) / mass) / (before[a] + lmscore.MU))

    background, goal = model(words), model(words[::2])
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, docs.where("doc_id % 2 = 0")).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(words):
        want = sum(goal(a, b) - background(a, b) for a, b in zip([None, *w[:-1]], w)) / max(len(w), 1)
        assert got[k].n_tokens == len(w) and got[k].score == pytest.approx(want, abs=1e-5)


def test_digests_of_the_queries(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in queries.op9_bpe_lexicon(spark, SF_SMALL).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    start = 0
    for r in sorted(queries.op6_token_files(spark, SF_SMALL).collect()):
        ids = ids_of(library, texts[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    pieces = queries.op10_packing(spark, SF_SMALL).collect()
    for r in pieces:
        ids = ids_of(library, texts[r.doc_id]) + [1]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), crc(ids[r.start : r.start + r.length]))
    assert sum(r.length for r in pieces) >= 0.95 * 2048 * len({r.sequence_id for r in pieces})


def test_buckets_with_the_same_lines_are_compared_once(spark):
    """Of equal buckets the one of the first band stays; others stay, and single lines have none."""
    rows = [(1, [10, 20, 30]), (2, [10, 20, 30]), (3, [50, 60, 30]), (9, [40, 41, 42]), (4, [50, 60, 7]), (4, []), (4, [50, 60, 7])]
    got = linededup.whole_buckets(spark.createDataFrame(rows, "h long, bands array<long>")).collect()
    assert sorted(tuple(r) for r in got) == [(10, 1), (10, 2), (30, 1), (30, 2), (30, 3), (50, 3), (50, 4)]


def test_band_keys_equal_a_plain_form(spark):
    """Lines that differ share few bands, equal shingle sets share all."""
    lines = ["the same line of text again and again", "the same line of text again and again", "short", "x", "another line with nothing in common 日本語 été"]
    body = np.frombuffer("".join(lines).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(x.encode()) for x in lines]))
    keys = linededup.band_keys(body, at)
    assert keys.shape == (5, linededup.BANDS) and (keys[0] == keys[1]).all()
    assert not (keys[0] == keys[4]).any() and not (keys[2] == keys[3]).any()
    # lines of a shingle or more do not depend on what they are read with
    alone = [linededup.band_keys(body[a:b], np.array([0, b - a])) for a, b in zip(at[:-1], at[1:])]
    assert (np.concatenate(alone) == keys)[[0, 1, 4]].all()


def plain_features(text):
    """Hashed features of a text by the definition: words, stems, word pairs, and pairs with one word skipped."""
    words, mask = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower()), 2**64 - 1
    h = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed)
    mixed = [h(w, 1) for w in words] + [h(w[:n], n) for n in toxicity.STEMS for w in words if len(w) > n]
    for skip, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        mixed += [(h(a, 1) * odd & mask) ^ (h(b, 1) + skip & mask) for a, b in zip(words, words[skip:])]
    return sorted({(m * 0x9E3779B97F4A7C15 & mask) >> (64 - toxicity.FEATURE_BITS) for m in mixed})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdefghB é日.-\n", max_size=60)), max_size=5))
def test_toxicity_features_equal_the_definition(texts):
    rows, found = toxicity.features(pa.array(texts, pa.string()))
    assert [sorted(set(found[rows == k].tolist())) for k in range(len(texts))] == [plain_features(t) for t in texts]


def test_ftrl_equals_a_plain_form():
    """Weights of the published update, coordinate by coordinate, from a dictionary."""
    pick = random.Random(7)
    examples = [(sorted({pick.randrange(40) for _ in range(8)} | ({63} if k % 3 == 0 else set())), int(k % 3 == 0)) for k in range(300)]
    model, z, g2, bias = toxicity.Ftrl(6), {}, {}, 64

    def weight(i):
        l1, own = (0 if i == bias else toxicity.L1), z.get(i, 0.0)
        return 0.0 if abs(own) <= l1 else -(own - math.copysign(l1, own)) / ((toxicity.BETA + math.sqrt(g2.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for features, y in examples:
        model.update(np.array(features), y)
        w = {i: weight(i) for i in [*features, bias]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            before = g2.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
            g2[i] = before + g * g
    found = {int(i): w for i, w in zip(*map(np.concatenate, zip(*model.non_zero())))}
    assert 63 in found and found.keys() == {i for i in range(65) if weight(i)}
    assert all(math.isclose(w, weight(i), rel_tol=1e-3) for i, w in found.items())


def test_stages_tell_rows_apart_by_id_and_text(spark):
    """Null and repeated ids, repeated rows, an empty table, and columns named as the stages' own."""
    words = [" ".join(f"w{n}{k}" for n in range(40)) for k in range(4)]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (2, words[1]), (None, words[2]), (None, words[2]), (None, words[0]), (None, words[3]), (5, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], "doc_id long, text string, key string, row string, fp int, lost int")
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    texts = Counter(r.text for r in one.collect())
    assert {r.text: r.doc_id for r in one.collect() if r.text} == {words[0]: 1, words[1]: 1, words[2]: None, words[3]: None}
    assert set(texts.values()) == {1} and sum(n for t, n in texts.items() if not t) == 1
    lines = linededup.drop_lines(docs)
    assert lines.columns == docs.columns
    assert Counter(r.text for r in lines.collect() if r.text) == Counter(words)
    for stage in (simhash.keep_one, linededup.drop_lines):
        assert stage(docs.limit(0)).collect() == []


def test_toxic_rows_go_whatever_their_id(spark):
    texts = ["calm words about the weather today", "vile loathsome vermin talk again"]
    rows = [(k, texts[k % 2] + f" n{k}") for k in range(300)]
    extra = [(None, texts[1]), (None, texts[0]), (1000, texts[1]), (1000, texts[0]), (1000, texts[0]), (None, None)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows + extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([r for r in rows if r[0] % 2 == 0] + [(None, texts[0]), (1000, texts[0]), (1000, texts[0]), (None, None)])
