"""Vocabulary: word counts, pair counts, exact BPE training, encoding.

The BPE state is the table of *distinct words* with their frequencies, not
the corpus: word counting (a partial + final aggregate) shrinks it first.
Pair counts are a running table, changed in each round by the signed
differences of the words that the round touched. A round takes the stretches
of words around the most frequent pairs, equal ones counted together, and
merges in them for as long as no other pair can come first. The learned model
(merges, vocabulary) is bounded by ``vocab_size`` and is the only thing that
lives on the driver.

Rule (P6): ids 0..3 are the specials, then the alphabet in code-point order,
then one id per merge. Each round merges the adjacent pair with the highest
frequency-weighted count, ties by smallest (left id, right id), replacing
left to right without overlap; stop at ``vocab_size`` or when the best count
is below ``min_frequency``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.functions.text import (
    NON_WS_CHAR_RE,
    PRE_TOKEN_RE,
    PRE_WS_BODY,
    SPECIALS,
    UNK_ID,
    chars,
    pretokenize,
)
from bitext.session import cut_lineage, scratch_path

# Special tokens found in the text are matched before pre-tokenization.
SPECIAL_RE = r"\[(?:PAD|UNK|SOS|EOS)\]"
ENCODE_WORD_RE = f"{SPECIAL_RE}|{PRE_TOKEN_RE}"
ENCODE_CHAR_RE = f"{SPECIAL_RE}|{NON_WS_CHAR_RE}"

VOCAB_SIZE = 32000
MIN_FREQUENCY = 2
#: Distinct stretches of words that one round of training looks at in one task (some 40 bytes a symbol).
TOUCHED = 1 << 20
#: Pairs of a round up to which half as many stretches are aimed at, as their number can't be told well from the last
#: round's; beyond them it is three quarters.
FEW_PAIRS = 512
#: Symbols that a stretch keeps on either side of the pairs it is taken for, and the symbol that stands for more.
CONTEXT, CUT = 2, -1
#: Words whose ids an encoding task remembers.
MEMO_WORDS = 1 << 19


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) over pre-tokens of every text."""
    return (
        texts.select(F.explode(pretokenize(text_col)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def adjacent_pairs(arr: Column) -> Column:
    """Array of (l, r) structs for adjacent elements."""
    n = F.size(arr)
    return F.arrays_zip(
        F.slice(arr, 1, F.greatest(n - 1, F.lit(0))).alias("l"),
        F.slice(arr, 2, F.greatest(n - 1, F.lit(0))).alias("r"),
    )


def pair_counts(words: DataFrame, sym_col: str = "syms") -> DataFrame:
    """D3: frequency-weighted counts of adjacent symbol pairs ``(l, r, n)``."""
    return (
        words.select(F.explode(adjacent_pairs(F.col(sym_col))).alias("p"), "freq")
        .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
        .agg(F.sum("freq").alias("n"))
    )


def alphabet(words: DataFrame) -> DataFrame:
    """Distinct characters of the words, ids from len(SPECIALS) in code-point
    order (UTF-8 byte order = code-point order). At most 1.1M rows (Unicode),
    so one ordered window is a bounded cost."""
    ch = words.select(F.explode(chars("word")).alias("token")).distinct()
    return ch.select("token", (F.row_number().over(Window.orderBy("token")) + len(SPECIALS) - 1).alias("id"))


def text_alphabet(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The same alphabet straight from the texts: the characters of all
    pre-tokens are exactly the characters that are not pre-tokenizer
    whitespace (one pass, partial distinct per task)."""
    body = F.regexp_replace(F.col(text_col), f"[{PRE_WS_BODY}]", "")
    ch = texts.select(F.explode(chars(body)).alias("token")).where(F.col("token") != "").distinct()
    return ch.select("token", (F.row_number().over(Window.orderBy("token")) + len(SPECIALS) - 1).alias("id"))


def char_vocab(spark: SparkSession, words: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """D5 with zero merges: specials + alphabet as ``(token, id)``, from a word
    table or directly from texts."""
    specials = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id int")
    alpha = alphabet(words) if words is not None else text_alphabet(texts)
    return specials.unionByName(alpha.select("token", F.col("id").cast("int").alias("id")))


def merge_pair_text(syms: Column, left: int, right: int, new_id: int) -> Column:
    """Merge adjacent (left, right) into ``new_id`` on the delimited form
    " 12 45 7 ", left to right without overlap, referencing the column once
    (chained merges stay linear). The merged id differs from both parts, so a
    replacement never creates a new occurrence.

    left != right: occurrences cannot overlap; one literal ``replace`` pass
    skips only an occurrence that directly follows a replaced one (its
    leading delimiter was consumed), so a second pass merges exactly the
    rest. left == right: a regex whose look-arounds do not consume the
    delimiters gives " a a a " -> " aa a "."""
    if left != right:
        pat, rep = F.lit(f" {left} {right} "), F.lit(f" {new_id} ")
        return F.replace(F.replace(syms, pat, rep), pat, rep)
    return F.regexp_replace(syms, f"(?<= ){left} {right}(?= )", str(new_id))


def _text_pairs(syms: Column) -> Column:
    return adjacent_pairs(F.split(F.trim(syms), " "))


@dataclass
class BpeModel:
    """A trained BPE model: ``vocab`` token -> id, ``merges`` in rank order as
    (left_id, right_id, new_id, count)."""

    vocab: dict[str, int] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def id_to_token(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.vocab.items(), key=lambda kv: kv[1]), "token string, id int")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        inv = self.id_to_token
        rows = [(r, inv[a], inv[b], inv[c], c, n) for r, (a, b, c, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string, token string, id int, count long")


class _Round:
    """Which merges of a round equal merging one at a time.

    ``head``: the most frequent pairs (l, r, n) in merge order (count, then
    ids); every other pair comes after its last one. ``triples``: (x, a, b) -> n
    where (x, a) or (a, b) is in the head: all with both there, and all with
    at least the last head pair's count.

    Merging (a, b) takes T(x, a, b) from (x, a) and T(a, b, y) from (b, y),
    and makes (x, ab) and (ab, y) with at most those counts. That is exact
    while a pair has lost neighbours on one side only and what took them was
    untouched itself. A pair beyond that is known by its upper bound only, and
    the round ends before it. A made pair ends the round too, after its own
    merge if its count is exact: what surrounds it has not been counted."""

    def __init__(self, head: list[tuple], triples: dict[tuple, int], complete: bool):
        self.count = {(left, right): n for left, right, n in head}
        self.last = None if complete or not head else (-head[-1][2], head[-1][0], head[-1][1])
        self.sides: dict[tuple, set] = {}
        self.vague: set[tuple] = set()
        self.made: list[tuple] = []  # made pairs: merge-order key, and the neighbour if the count was exact
        self.lefts: set[int] = set()  # symbols merged as left and as right parts
        self.rights: set[int] = set()
        self.over = False
        self.runs = {a for x, a, b in triples if x == a == b}
        self.before: dict[tuple, list] = {}
        self.after: dict[tuple, list] = {}
        for (x, a, b), n in triples.items():
            self.before.setdefault((a, b), []).append((x, n))
            self.after.setdefault((x, a), []).append((b, n))

    def next(self) -> tuple | None:
        """The next pair to merge and its count, or None at the round's end."""
        if not self.count or self.over:
            return None
        key, pair = min(((-n, *p), p) for p, n in self.count.items())
        if self.last is not None:
            key = min(key, (*self.last[:2], self.last[2] + 1))  # what comes right after the head
        if self.made and self.made[0][0] < key:
            (n, left, right), neighbour, before = self.made[0]
            self.over = True
            lost = self.rights if before else self.lefts
            return None if neighbour < 0 or neighbour in lost else ((left, right), -n)
        if pair in self.vague or (self.last is not None and (-self.count[pair], *pair) > self.last):
            return None
        if pair[0] == pair[1] and pair[0] in self.runs:  # occurrences overlap: a round of its own
            self.over = True
            return None if self.lefts else (pair, self.count[pair])
        return pair, self.count[pair]

    def merge(self, pair: tuple, new_id: int) -> None:
        if self.over:  # nothing follows
            return
        a, b = pair
        exact = pair not in self.sides
        del self.count[pair]
        self.lefts.add(a)
        self.rights.add(b)
        for x, n in self.before.get(pair, ()):
            heapq.heappush(self.made, ((-n, x, new_id), x if exact and x not in self.rights else -1, True))
            self._touch((x, a), "right", n, exact)
        for y, n in self.after.get(pair, ()):
            heapq.heappush(self.made, ((-n, new_id, y), y if exact and y not in self.lefts else -1, False))
            self._touch((b, y), "left", n, exact)

    def _touch(self, pair: tuple, side: str, n: int, exact: bool) -> None:
        if pair in self.count:
            sides = self.sides.setdefault(pair, set())
            sides.add(side)
            if not exact or len(sides) > 1 or pair[0] in self.runs and pair[0] == pair[1]:
                self.vague.add(pair)
            if pair not in self.vague:
                self.count[pair] -= n


def _symbols(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a column of id arrays, end to end, and its rows' offsets in them."""
    flat, at = ids.values.to_numpy().astype(np.int64), ids.offsets.to_numpy().astype(np.int64)
    return flat[at[0] : at[-1]], at - at[0]


def _every_other(begins: np.ndarray) -> np.ndarray:
    """Of runs of occurrences that overlap, given where one begins, the first, third and so on."""
    first = np.flatnonzero(begins)
    return (np.arange(len(begins)) - np.repeat(first, np.diff(np.append(first, len(begins))))) % 2 == 0


def _merge_rows(flat: np.ndarray, sizes: np.ndarray, ranks: dict):
    """Apply merges ``(left, right) -> (rank, merged id)`` to words that lie end to end: in each, lowest rank first, left
    to right. A merge is not applied to pairs that a later one makes. Gives the words (their numbers, symbols and sizes)
    as they are done."""
    pairs = np.array([left << 32 | right for left, right in ranks], np.int64)
    order = np.argsort(pairs)
    pairs, rank, made = pairs[order], *np.array(list(ranks.values()), np.int64)[order].T
    number, last = np.arange(len(sizes)), np.full(len(sizes), -1)
    while len(sizes):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(row[1:] == row[:-1])
        key = flat[at] << 32 | flat[at + 1]
        place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        own = np.flatnonzero((pairs[place] == key) & (rank[place] > last[row[at]]))
        at, place = at[own], place[own]
        best = np.full(len(sizes), len(pairs))
        np.minimum.at(best, row[at], rank[place])
        going = best < len(pairs)
        yield number[~going], flat[~going[row]], sizes[~going]
        now = np.flatnonzero(rank[place] == best[row[at]])
        at, place = at[now], place[now]
        if len(at):  # of occurrences that overlap every other one
            now = _every_other(np.append(True, np.diff(at) > 1))
            at, place = at[now], place[now]
        flat[at] = made[place]
        rest = going[row]
        rest[at + 1] = False
        flat, sizes = flat[rest], (sizes - np.bincount(row[at], minlength=len(sizes)))[going]
        number, last = number[going], best[going]


def _keys(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Each adjacent pair of a column of id arrays as ``left << 32 | right``, and its row."""
    flat, at = _symbols(ids)
    row = np.repeat(np.arange(len(ids)), np.diff(at))
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    return flat[inner] << 32 | flat[inner + 1], row[inner]


def _stretches(ids: pa.ListArray, pairs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """What surrounds the sorted ``pairs`` in a column of id arrays: each stretch's row and symbols, with ``CONTEXT``
    symbols on both sides and ``CUT`` where the word goes on beyond them. Stretches that meet are one, so that an
    adjacent pair lies in one at most."""
    flat, at = _symbols(ids)
    n, row = len(flat), np.repeat(np.arange(len(ids)), np.diff(at))
    if n < 2 or not len(pairs):
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32()))
    key = flat[:-1] << 32 | flat[1:]
    hit = np.flatnonzero((pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key) & (row[1:] == row[:-1]))
    begin, end = np.maximum(hit - CONTEXT, at[row[hit]]), np.minimum(hit + 2 + CONTEXT, at[row[hit] + 1])
    first = np.ones(len(hit), bool)
    first[1:] = (begin[1:] > end[:-1]) | (row[hit[1:]] != row[hit[:-1]])
    first = np.flatnonzero(first)
    begin, end = begin[first], end[np.append(first[1:], len(hit)) - 1] if len(hit) else end
    own = row[hit[first]]
    left, right = begin > at[own], end < at[own + 1]
    size = end - begin + left + right
    offsets = np.append(0, np.cumsum(size))
    # one more symbol at a cut side, overwritten
    taken = np.repeat(begin - left - offsets[:-1], size) + np.arange(offsets[-1])
    symbols = flat[taken].astype(np.int32)
    symbols[offsets[:-1][left]] = CUT
    symbols[offsets[1:][right] - 1] = CUT
    return own, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(symbols))


def _rows_with(ids: pa.ListArray, pairs: np.ndarray) -> np.ndarray:
    """Rows that hold one of the sorted ``pairs``."""
    key, row = _keys(ids)
    if not len(pairs):
        return np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    return np.unique(row[pairs[place] == key])


def _packed(pairs) -> np.ndarray:
    return np.sort(np.array([left << 32 | right for left, right in pairs], np.int64))


def _merging(words: pa.Table, head: np.ndarray | None):
    """A function that merges a pair in all words and gives what each pair gains or loses by it. The symbols are linked
    and the places of pairs are kept (at first those of the sorted ``head``, or of all pairs), so a merge costs what it
    changes, in words that hold few pairs and in many that hold one."""
    end, gone = CUT - 1, CUT - 2  # after each word, and in place of a merged pair's second symbol
    freq = words.column("freq").to_numpy()
    flat, at = _symbols(words.column("ids").combine_chunks())
    owner = np.repeat(np.arange(len(freq), dtype=np.int32), np.diff(at) + 1)
    owner = np.append(np.int32(0), owner)
    symbols = np.full(len(owner), end, np.int32)
    symbols[np.arange(1, len(flat) + 1) + np.repeat(np.arange(len(freq)), np.diff(at))] = flat
    del flat, at
    following = np.arange(1, len(owner) + 1, dtype=np.int32)
    before = following - 2

    def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of first symbols those of pairs, and the pairs."""
        left, right = symbols[at], symbols[following[at]]
        own = np.flatnonzero((left != end) & (right != end))
        return at[own], left[own].astype(np.int64) - end << 32 | right[own] - end

    def keep(at: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        bounds = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)).tolist() if len(keys) else [0]
        for key, a, b in zip(keys[bounds[:-1]].tolist(), bounds, bounds[1:]):
            where.setdefault(key, []).append(at[a:b])

    where: dict[int, list[np.ndarray]] = {}
    at, keys = pairs(np.arange(len(owner) - 1, dtype=np.int32))
    if head is not None:
        own = np.flatnonzero(np.isin(keys, head - (end << 32) - end))
        at, keys = at[own], keys[own]
    keep(at, keys)
    del at, keys

    def merge(pair: tuple, new: int) -> dict:
        left, right = pair
        at = where.pop(left - end << 32 | right - end, [])
        if not at:
            return {}
        at = np.unique(np.concatenate(at))
        at = at[(symbols[at] == left) & (symbols[following[at]] == right)]
        if left == right and len(at):  # of occurrences that overlap every other one
            at = at[_every_other(np.append(True, following[at[:-1]] != at[1:]))]
        second, prior = following[at], before[at]
        own = np.append(True, prior[1:] != second[:-1])[: len(at)]  # a pair between two occurrences counts once
        lost_at, lost = pairs(np.concatenate([prior[own], at, second]))
        symbols[at], symbols[second] = new, gone
        after = following[second]
        following[at], before[after] = after, at
        prior = before[at]
        own = np.append(True, prior[1:] != at[:-1])[: len(at)]
        made_at, made = pairs(np.concatenate([prior[own], at]))
        keep(made_at, made)
        keys, place = np.unique(np.concatenate([lost, made]), return_inverse=True)
        more = np.zeros(len(keys), np.int64)
        np.add.at(more, place, np.concatenate([-freq[owner[lost_at]], freq[owner[made_at]]]))
        moved = np.flatnonzero(more)
        return {((k >> 32) + end, (k & 0xFFFFFFFF) + end): n for k, n in zip(keys[moved].tolist(), more[moved].tolist())}

    return merge


def merge_touched(words: list | pa.Table, head: dict, floor: tuple | None, vocab: dict, room: int, least: int) -> list[tuple]:
    """The merges ``(left, right, id, count)`` that follow, from the words ``(freq, ids)`` (rows, or a table) that hold a
    pair of ``head`` (pair -> count in all words), or the stretches of them that do.

    Every other pair comes after ``floor`` (-count, left, right), or there is none. A merge makes pairs with its new
    symbol in these words only, so their counts are exact too, and merging goes on while the first known pair comes
    before ``floor``. Only a merge into a token that exists already can raise other pairs; what it adds to one raises
    the bound on all of them. A merge next to ``CUT`` makes pairs with a symbol unknown: none of them is more frequent
    than all those and the most frequent known pair together, which bounds them."""
    names = {i: t for t, i in vocab.items()}
    vocab, count = dict(vocab), dict(head)
    heap = [(-n, *p) for p, n in count.items()]
    heapq.heapify(heap)
    fresh, gained, out, done = set(), {}, [], set()
    bound = floor

    def tracked(p: tuple) -> bool:
        return p in count or p[0] in fresh or p[1] in fresh or floor is None

    if not isinstance(words, pa.Table):
        freq, ids = zip(*words) if words else ((), ())
        words = pa.table([pa.array(freq, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["freq", "ids"])
    merged = _merging(words, None if floor is None else _packed(head))
    while heap and len(out) < room:
        n, left, right = heapq.heappop(heap)
        pair = (left, right)
        if pair not in count or -n != count[pair]:
            if count.get(pair, 0) > 0:
                heapq.heappush(heap, (-count[pair], left, right))
            continue
        if -n < least or (bound is not None and (n, left, right) >= bound) or pair in done:
            break
        token = names[left] + names[right]
        reused = token in vocab
        new = vocab.setdefault(token, len(vocab))
        names[new] = token
        if not reused:
            fresh.add(new)
        out.append((left, right, new, -n))
        done.add(pair)
        before = {}
        for p, more in merged(pair, new).items():
            if tracked(p):
                before[p] = count.get(p, 0)
                count[p] = before[p] + more
            elif reused:
                gained[p] = gained.get(p, 0) + more
        count.pop(pair, None) if count.get(pair, 0) <= 0 else None
        if reused and any(CUT in p and more > 0 for p, more in gained.items()):
            break
        for p in [p for p in before if CUT in p]:
            del before[p]
            more, side = count.pop(p), 0 if p[1] == CUT else 1  # the known symbol's place
            if more > 0:
                near = max((count.get(q, 0) for q in before if q[side] == p[side] and CUT not in q), default=0)
                bound = min(bound, (-near - more, -1, -1))
        for p, was in before.items():
            if count.get(p, 0) > was:
                heapq.heappush(heap, (-count[p], *p))
        if reused and floor is not None and gained:
            bound = min(bound, (floor[0] - max(0, max(gained.values())), -1, -1))
    return out


def train_bpe(
    words: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    max_merges: int | None = None,
    candidates_per_round: int = 8192,
    touched: int = TOUCHED,
    on_round=None,
) -> BpeModel:
    """Exact BPE training over a ``(word, freq)`` table.

    ``pairs(l, r, n, w)`` (count, and occurrences in distinct words) runs along with the words. A round reads its head
    (at most ``candidates_per_round`` pairs), takes the stretches of words around the first of them, equal ones counted
    together, and merges in these (:func:`merge_touched`, one task of at most ``touched`` stretches). Equal stretches
    recur in many words, so their number grows far slower than that of the words, and so does the number of rounds; how
    many pairs a round takes follows from how often stretches recurred in the last one. Then one pass applies the
    merges to the words that hold them and counts what changed; the differences are added to ``pairs``. Both tables are
    written to the shared checkpoint folder every round.

    Where one pair alone has more than ``touched`` stretches, it is merged from counts alone: adjacent triples are
    counted where they are, and the head and the triples around it tell which merges of the round provably equal
    merging one at a time (:class:`_Round`).
    """
    words = cut_lineage(words.select("word", F.col("freq").cast("long").alias("freq")))
    model = BpeModel(vocab={t: i for i, t in enumerate(SPECIALS)})
    for token, i in alphabet(words).orderBy("id").collect():  # bounded by Unicode size
        model.vocab[token] = int(i)
    inv = model.id_to_token
    state = words.where("word is not null").select("freq", "word").mapInArrow(_letters(list(model.vocab)[len(SPECIALS) :]), "freq long, ids array<int>")
    state = _written(state.where(F.size("ids") > 1), "words")
    pairs = state.select("freq", F.explode(adjacent_pairs(F.col("ids"))).alias("p"))
    pairs = pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("w"))
    pairs = _written(pairs, "pairs")
    floor = max(min_frequency, 1)
    rounds, goal = 0, 4 * touched

    def room() -> int:
        left = vocab_size - len(model.vocab)
        return left if max_merges is None else min(left, max_merges - len(model.merges))

    while room() > 0:
        top = [tuple(r) for r in pairs.where(F.col("n") >= floor).orderBy(F.desc("n"), "l", "r").limit(candidates_per_round + 1).collect()]
        if not top:
            break
        size, used = 1, top[0][3]
        while size < min(len(top), candidates_per_round) and used + top[size][3] <= goal:
            used += top[size][3]
            size += 1
        limit = None if size == len(top) else (-top[size][2], top[size][0], top[size][1])
        if limit is None:  # pairs below the least frequency are left out of the head
            limit = (-(floor - 1), -1, -1) if floor > 1 else None
        found, stretches = _next_merges(state, {(x, y): n for x, y, n, _ in top[:size]}, limit, model.vocab, room(), floor, touched)
        if stretches <= touched:
            aim = touched // 2 if size <= FEW_PAIRS else touched * 3 // 4
            goal = min(8 * goal, max(1, used * aim // max(stretches, 1)))
        elif size > 1:
            goal = max(1, used // 4)
            continue
        else:
            found = _counted_merges(state, top[:candidates_per_round], len(top) <= candidates_per_round, model.vocab, room(), floor)
        if not found:
            break
        ranks: dict = {}
        for left, right, new_id, n in found:
            token = inv[left] + inv[right]
            model.vocab.setdefault(token, new_id)
            inv[new_id] = token
            model.merges.append((left, right, new_id, n))
            ranks[left, right] = (len(ranks), new_id)
        rounds += 1
        if on_round is not None:
            on_round(rounds, len(ranks))
        both = _written(state.mapInArrow(_applied(ranks), "freq long, ids array<int>, l int, r int, n long, w long"), "merged")
        state = both.where("ids is not null").select("freq", "ids")
        changed = pairs.unionByName(both.where("ids is null").select("l", "r", "n", "w"))
        pairs = _written(changed.groupBy("l", "r").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > 0"), "pairs")
    return model


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _applied(ranks: dict):
    """A pass over ``(freq, ids)``: the words after the merges (those left with one symbol drop out), and in rows
    without ids what each pair has gained or lost."""
    pairs = _packed(ranks)

    def run(batches):
        for batch in batches:
            column, freq = batch.column("ids"), batch.column("freq").to_numpy()
            rows = _rows_with(column, pairs)
            rest = np.ones(batch.num_rows, bool)
            rest[rows] = False
            freq, touched = freq[rows], column.take(pa.array(rows))
            lost, lost_row = _keys(touched)
            flat, at = _symbols(touched)
            number, symbols, sizes = (np.concatenate(x) for x in zip(*_merge_rows(flat, np.diff(at), ranks))) if len(rows) else [np.zeros(0, np.int64)] * 3
            merged = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(symbols, pa.int32()))
            made, made_row = _keys(merged)
            keys, place = np.unique(np.concatenate([lost, made]), return_inverse=True)
            n, w = np.zeros((2, len(keys)), np.int64)
            np.add.at(n, place, np.concatenate([-freq[lost_row], freq[number[made_row]]]))
            np.add.at(w, place, np.repeat([-1, 1], [len(lost), len(made)]))
            kept = np.flatnonzero(sizes > 1)
            same, names = batch.filter(pa.array(rest)), ["freq", "ids", "l", "r", "n", "w"]
            none = lambda k, kind: pa.nulls(k, kind)
            for f, ids in ((same.column("freq"), same.column("ids")), (pa.array(freq[number[kept]]), merged.take(pa.array(kept)))):
                k = len(f)
                yield pa.record_batch([f, ids.cast(pa.list_(pa.int32())), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int64())], names)
            moved = np.flatnonzero((n != 0) | (w != 0))
            k, keys = len(moved), keys[moved]
            yield pa.record_batch(
                [none(k, pa.int64()), none(k, pa.list_(pa.int32())), pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(n[moved]), pa.array(w[moved])],
                names,
            )

    return run


def _letters(alphabet: list[str]):
    """A pass over ``(freq, word)``: the words as arrays of ids, one for each character of the ordered alphabet."""
    points = np.array([ord(c) for c in alphabet], np.uint32)

    def run(batches):
        for batch in batches:
            text = [w.encode("utf-32-le") for w in batch.column("word").to_pylist()]
            at = np.append(0, np.cumsum([len(t) // 4 for t in text])).astype(np.int32)
            ids = np.searchsorted(points, np.frombuffer(b"".join(text), np.uint32)).astype(np.int32) + np.int32(len(SPECIALS))
            yield pa.record_batch([batch.column("freq"), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], ["freq", "ids"])

    return run


def _next_merges(state: DataFrame, head: dict, floor: tuple | None, vocab: dict, room: int, least: int, most: int) -> tuple[list[tuple], int]:
    """Merges found by merging in the stretches around the pairs of ``head``, which meet in one task, and the number
    of distinct stretches; no merges if there are more than ``most``."""
    pairs = _packed(head)
    sent = state.sparkSession.sparkContext.broadcast((head, vocab))  # both bounded

    def select(batches):
        for batch in batches:
            row, ids = _stretches(batch.column("ids"), pairs)
            yield pa.record_batch([batch.column("freq").take(pa.array(row)), ids], ["freq", "ids"])

    def merge(batches):
        words, n = [], 0
        for batch in batches:
            n += batch.num_rows
            words = [*words, batch] if n <= most else []
        found = merge_touched(pa.Table.from_batches(words), sent.value[0], floor, sent.value[1], room, least) if words else []
        columns = zip(*found, (0, 0, 0, n))  # the last row has the number of stretches
        yield pa.record_batch([pa.array(range(len(found) + 1), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64())))], ["rank", "l", "r", "id", "n"])

    alike = state.mapInArrow(select, "freq long, ids array<int>").groupBy("ids").agg(F.sum("freq").alias("freq"))
    rows = alike.select("freq", "ids").repartition(1).mapInArrow(merge, "rank int, l int, r int, id int, n long").collect()  # at most ``room`` merges
    rows = sorted(rows, key=lambda r: r["rank"])
    return [(r["l"], r["r"], r["id"], r["n"]) for r in rows[:-1]], rows[-1]["n"] if rows else 0


def _counted_merges(state: DataFrame, top: list[tuple], complete: bool, vocab: dict, room: int, least: int) -> list[tuple]:
    """Merges proved from the counts of adjacent triples."""
    spark = state.sparkSession
    head = [(x, y, n) for x, y, n, _ in top[:1024]]
    complete = complete and len(top) <= 1024
    # -1 stands before a word's first symbol.
    at = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("i")
    triple = state.select("freq", "ids", at).select(
        "freq",
        F.when(F.col("i") > 1, F.expr("ids[i - 2]")).otherwise(F.lit(-1)).alias("x"),
        F.expr("ids[i - 1]").alias("a"),
        F.expr("ids[i]").alias("b"),
    )
    counts = triple.groupBy("x", "a", "b").agg(F.sum("freq").alias("n"))
    last = head[-1][2]
    keys = spark.createDataFrame([(left, right) for left, right, _ in head], "l int, r int")
    near = (
        counts.where("x >= 0")
        .join(F.broadcast(keys.select(F.col("l").alias("a"), F.col("r").alias("b"), F.lit(1).alias("_ab"))), ["a", "b"], "left")
        .join(F.broadcast(keys.select(F.col("l").alias("x"), F.col("r").alias("a"), F.lit(1).alias("_xa"))), ["x", "a"], "left")
        .where(F.coalesce("_ab", "_xa").isNotNull() & ((F.col("n") >= last) | F.col("_ab").isNotNull() & F.col("_xa").isNotNull()))
    )
    triples = {(r["x"], r["a"], r["b"]): r["n"] for r in near.select("x", "a", "b", "n").collect()}
    plan, vocab, out = _Round(head, triples, complete=complete), dict(vocab), []
    names = {i: t for t, i in vocab.items()}
    while len(out) < room and (found := plan.next()) is not None:
        (left, right), n = found
        if n < least:
            break
        token = names[left] + names[right]
        reused = token in vocab
        new_id = vocab.setdefault(token, len(vocab))
        names[new_id] = token
        out.append((left, right, new_id, n))
        plan.merge((left, right), new_id)
        if reused:  # pairs with an existing token may grow
            break
    return out


def save_model(spark: SparkSession, model: BpeModel, path: str) -> None:
    """A4 save: ``vocab(token, id)`` and ``merges(rank, left_id, right_id,
    id, count)`` as Parquet (bounded by ``vocab_size``)."""
    model.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    rows = [(r, a, b, c, n) for r, (a, b, c, n) in enumerate(model.merges)]
    spark.createDataFrame(rows, "rank int, left_id int, right_id int, id int, count long").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/merges")


def load_model(spark: SparkSession, path: str) -> BpeModel:
    """A4 load (raises if the model was never saved)."""
    vocab = {r["token"]: int(r["id"]) for r in spark.read.parquet(f"{path}/vocab").collect()}
    merges = [
        (int(r["left_id"]), int(r["right_id"]), int(r["id"]), int(r["count"]))
        for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    ]
    return BpeModel(vocab=vocab, merges=merges)


def load_or_build(spark: SparkSession, path: str, build) -> BpeModel:
    """A4 load-or-build: reuse a saved model at ``path``, else ``build()`` it
    and save it there."""
    from pyspark.errors import AnalysisException

    try:
        return load_model(spark, path)
    except AnalysisException:
        model = build()
        save_model(spark, model, path)
        return model


def encode_chars(
    df: DataFrame,
    key: str,
    text_col: str | list[str],
    vocab: DataFrame,
    out_col: str | list[str] = "ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """Character-level encode (BPE with no merges) of one or more text
    columns: special-token literals first, then each non-whitespace
    character; lookup by a broadcast join on the vocabulary (bounded);
    [UNK] for unknown characters.

    One pass for all columns: the rows are hash-partitioned on ``key`` (which
    must be unique) once; the explode and the broadcast join keep that
    partitioning, so the regroup by ``key`` needs no second shuffle. Texts
    without tokens keep their row with an empty array (outer explode).
    ``keep`` columns are carried through (one value per key)."""
    cols = [text_col] if isinstance(text_col, str) else list(text_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    sides = F.array(
        *[
            F.struct(F.lit(i).alias("_side"), F.regexp_extract_all(F.col(c), F.lit(ENCODE_CHAR_RE), 0).alias("_t"))
            for i, c in enumerate(cols)
        ]
    )
    keep = list(keep or [])
    toks = (
        df.select(key, *keep, *cols)
        .repartition(key)
        .select(key, *keep, F.explode(sides).alias("_s"))
        .select(key, *keep, "_s._side", F.posexplode_outer("_s._t").alias("_pos", "token"))
    )
    ided = toks.join(F.broadcast(vocab.select("token", "id")), "token", "left").withColumn(
        "id", F.when(F.col("token").isNotNull(), F.coalesce(F.col("id"), F.lit(UNK_ID)))
    )

    def ids_of(i: int) -> Column:
        picked = F.collect_list(F.when((F.col("_side") == i) & F.col("token").isNotNull(), F.struct("_pos", "id")))
        return F.array_sort(picked).getField("id").cast("array<int>")

    return ided.groupBy(key).agg(
        *[F.first(c).alias(c) for c in keep], *[ids_of(i).alias(o) for i, o in enumerate(outs)]
    )


def bpe_encode_column(model: BpeModel, text: Column) -> Column:
    """BPE-encode a text column (no template) with an Arrow-batched pandas
    UDF, without a shuffle. The model is bounded by ``vocab_size`` and broadcast; a
    memo of at most ``MEMO_WORDS`` words means that a task merges its distinct words once."""
    ranks = {(a, b): (r, c) for r, (a, b, c, _n) in reversed(list(enumerate(model.merges)))}  # the first of equal merges
    sent = SparkSession.active().sparkContext.broadcast((dict(model.vocab), ranks))
    memo: dict[str, list[int]] = {}  # a task's own copy

    # Pre-tokenization stays on the JVM (regexp_extract_all); the UDF gets the
    # word arrays and only applies merges.
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def encode_words(words: pd.Series) -> pd.Series:
        vocab, ranks = sent.value
        if len(memo) > MEMO_WORDS:
            memo.clear()

        def ids(w: str) -> list[int]:
            got = memo.get(w)
            if got is None:
                got = memo[w] = [vocab[w]] if w in SPECIALS else _encoded([vocab.get(ch, UNK_ID) for ch in w], ranks)
            return got

        return words.map(lambda ws: [ids(w) for w in ws] if ws is not None else None)

    words = F.regexp_extract_all(text, F.lit(ENCODE_WORD_RE), 0)
    return F.flatten(encode_words(words))


def _encoded(ids: list[int], ranks: dict) -> list[int]:
    """A word's ids with the merge of lowest rank applied for as long as there is one; all its occurrences at once,
    left to right."""
    while len(ids) > 1:
        rank, new = min((ranks[p] for p in zip(ids, ids[1:]) if p in ranks), default=(None, None))
        if rank is None:
            break
        out, k = [], 0
        while k < len(ids):
            if k + 1 < len(ids) and ranks.get((ids[k], ids[k + 1])) == (rank, new):
                out.append(new)
                k += 2
            else:
                out.append(ids[k])
                k += 1
        ids = out
    return ids
