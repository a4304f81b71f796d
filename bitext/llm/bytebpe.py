"""Exact byte-level BPE over whole Arrow batches.

Reads the JSON file of a public byte-level BPE tokenizer and gives the ids that the ``tokenizers`` library gives with
``add_special_tokens=False`` and without truncation or padding. A batch is split into words and its *distinct* words
are merged together, one numpy step per merge round, so the cost per token is that of a table lookup.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import distinct_slices, flat_ranges

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

#: Code points with Unicode's White_Space property, and the contractions that are words of their own.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

NONE = np.iinfo(np.int32).max


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    general = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    classes[general == "L"], classes[general == "N"] = LETTER, NUMBER
    for first, last in WHITE_SPACE:
        classes[first : last + 1] = SPACE
    return classes


@functools.cache
def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 bytes stand for themselves, the
    others for code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def word_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of the rows start. Words tile the rows: each ends where the next starts.

    A word is a contraction, or letters, numbers or other visible characters with at most one space in front, or
    white space (without its last character where something visible follows)."""
    if not len(raw):
        return np.zeros(0, np.int64)
    text = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (text >= 0x80).astype(np.int8) + (text >= 0x800) + (text >= 0x10000)
    byte_at = np.zeros(len(text) + 1, np.int64)
    np.cumsum(size, out=byte_at[1:])
    rows = np.searchsorted(byte_at, at)
    first = np.zeros(len(text) + 1, bool)
    first[rows] = True
    kind = char_classes()[text]
    before = np.empty_like(kind)
    before[0], before[1:] = SPACE, kind[:-1]
    blank = text == 0x20
    after_blank = np.zeros(len(text), bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first[:-1]
    is_space = kind == SPACE
    start = np.where(is_space, before != SPACE, (kind != before) & ~after_blank)
    # In a run of white space, the last character starts a word if something visible follows in the row.
    follows = np.zeros(len(text), bool)
    follows[:-1] = ~is_space[1:] & ~first[1:-1]
    start |= is_space & follows
    start |= first[:-1]
    quotes = np.flatnonzero((text == 0x27) & (first[:-1] | ((before != OTHER) & ~after_blank)))
    if len(quotes):
        padded = np.concatenate([text, np.zeros(3, np.uint32)])
        row_end = rows[np.searchsorted(rows, quotes, "right")]
        for word in CONTRACTIONS:
            hit = quotes + len(word) <= row_end
            for k, char in enumerate(word[1:], 1):
                hit &= padded[quotes + k] == ord(char)
            stop = quotes[hit] + len(word)
            start[quotes[hit] + 1] = False
            stop = stop[(stop < len(text))]
            start[stop[~is_space[stop]]] = True
    return byte_at[np.flatnonzero(start)]


class PairTable:
    """Merge rank and merged id of symbol pairs; hashed, with a smaller table for the keys that collide."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        for bits, odd in ((20, 0x9E3779B97F4A7C15), (17, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (16, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F)):
            slot = (keys * np.uint64(odd)) >> np.uint64(64 - bits)
            _, taken = np.unique(slot, return_index=True)
            key_of = np.full(1 << bits, np.uint64(2**63), np.uint64)
            value_of = np.full(1 << bits, NONE, np.int32)
            key_of[slot[taken]], value_of[slot[taken]] = keys[taken], values[taken]
            self.levels.append((np.uint64(odd), np.uint64(64 - bits), key_of, value_of))
            rest = np.ones(len(keys), bool)
            rest[taken] = False
            keys, values = keys[rest], values[rest]
            if not len(keys):
                return
        raise ValueError("pairs collide at every level")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(len(keys), NONE, np.int32)
        for odd, shift, key_of, value_of in self.levels:
            slot = (keys * odd) >> shift
            hit = key_of[slot] == keys
            found[hit] = value_of[slot[hit]]
        return found


class ByteBpe:
    """The tokenizer in a file. Rejects files whose settings this class does not cover."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab = model["vocab"]
        chars = byte_chars()
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        self.pairs = PairTable(keys, np.arange(len(pairs), dtype=np.int32))
        of_char = {c: b for b, c in enumerate(chars)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        self.token_bytes = {i: (w.encode() if w in special else bytes(of_char[c] for c in w)) for w, i in {**vocab, **special}.items()}

    def encode_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, end to end, and the words' offsets in them."""
        _, offsets, data = distinct.buffers()
        at = np.frombuffer(offsets, np.int64, len(distinct) + 1, distinct.offset * 8)
        if at[-1] == at[0]:
            return np.zeros(0, np.int32), np.zeros(len(distinct) + 1, np.int64)
        symbol = self.byte_id[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
        lengths = np.diff(at)
        word = np.flatnonzero(lengths)
        lengths = lengths[word]
        done_word, done_symbol = [], []
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.pairs.rank(symbol[:-1], symbol[1:])
        starts = np.cumsum(lengths) - lengths
        rank[starts + lengths - 1] = NONE
        while len(word):
            best = np.minimum.reduceat(rank, starts)
            ready = best == NONE
            if ready.any():
                gone = np.repeat(ready, lengths)
                done_word.append((word[ready], lengths[ready]))
                done_symbol.append(symbol[gone])
                symbol, rank, word, lengths, best = symbol[~gone], rank[~gone], word[~ready], lengths[~ready], best[~ready]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(word)), lengths)
            hits = np.flatnonzero(rank == best[owner])
            touch = np.flatnonzero(np.diff(hits) == 1)
            if len(touch):  # x x x: the pairs overlap; take every other one of such a run
                new_run = np.ones(len(hits), bool)
                new_run[touch + 1] = False
                run = np.cumsum(new_run) - 1
                hits = hits[(np.arange(len(hits)) - np.flatnonzero(new_run)[run]) % 2 == 0]
            symbol[hits] = self.merged[rank[hits]]
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            lengths = lengths - np.bincount(owner[hits], minlength=len(word))
            moved = hits - np.arange(len(hits))  # where the merged symbols are now
            last = rank[hits + 1] == NONE
            symbol, rank, owner = symbol[keep], rank[keep], owner[keep]
            starts = np.cumsum(lengths) - lengths
            ends = starts + lengths - 1
            again = np.concatenate([moved, moved[moved > starts[owner[moved]]] - 1])
            again = again[again != ends[owner[again]]]
            rank[moved[last]] = NONE
            rank[again] = self.pairs.rank(symbol[again], symbol[again + 1])
            rank[ends] = NONE
        ids, count = np.concatenate(done_symbol), np.zeros(len(distinct), np.int64)
        for w, n in done_word:
            count[w] = n
        sizes = np.concatenate([n for _, n in done_word])
        order = np.concatenate([w for w, _ in done_word])
        where = np.zeros(len(distinct), np.int64)
        where[order] = np.cumsum(sizes) - sizes
        out = np.zeros(len(distinct) + 1, np.int64)
        np.cumsum(count, out=out[1:])
        return ids[flat_ranges(where, count)], out

    def encode(self, raw: np.ndarray, at: np.ndarray, encode_words=None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of UTF-8 text, end to end, and the rows' offsets in them. ``encode_words`` may stand in
        for the method of that name."""
        body = raw.tobytes()
        marks = [(k, t, i) for t, i in self.special.items() for k in _occurrences(body, t, at)]
        if not marks:
            return self._encode(raw, at, encode_words or self.encode_words)
        # A special token's string is one id and parts the text like a row's end.
        marks.sort()
        cuts = np.array(sorted({*at.tolist(), *(k for k, _, _ in marks), *(k + len(t) for k, t, _ in marks)}))
        ids, parts = self._encode(raw, cuts, encode_words or self.encode_words)
        piece = {int(c): n for n, c in enumerate(cuts)}
        pieces = [ids[a:b] for a, b in zip(parts[:-1], parts[1:])]
        for k, _, i in marks:
            pieces[piece[k]] = np.array([i], np.int32)
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=bounds[1:])
        return np.concatenate(pieces), bounds[[piece[int(a)] for a in at]]

    def _encode(self, raw, at, encode_words):
        starts = word_starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        codes, distinct = distinct_slices(raw, starts, np.append(starts[1:], len(raw)))
        ids, offsets = encode_words(distinct)
        count = np.diff(offsets)[codes]
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        return ids[flat_ranges(offsets[codes], count)], before[np.searchsorted(starts, at)]


def _occurrences(body: bytes, token: bytes, at: np.ndarray) -> list[int]:
    """Where ``token`` stands in the rows, from left to right without overlap, never across a row's end."""
    found, k = [], body.find(token)
    while k >= 0:
        inside = np.searchsorted(at, k, "right") == np.searchsorted(at, k + len(token) - 1, "right")
        if inside:
            found.append(k)
        k = body.find(token, k + (len(token) if inside else 1))
    return found


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer in ``path``, read once in each Python worker."""
    return ByteBpe(path)


class WordMemo:
    """Ids of the words met so far in this worker: a word is merged once. Holds ``most`` words, then starts anew."""

    def __init__(self, bpe: ByteBpe, most: int = 200_000):
        self.bpe, self.most = bpe, most
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.most:
            self.clear()
        known = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            unseen = distinct.take(pa.array(new))
            ids, bounds = self.bpe.encode_words(unseen)
            known[new] = np.arange(len(new)) + len(self.words)
            self.words = pa.concat_arrays([self.words, unseen])
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        starts, count = self.bounds[known], self.bounds[known + 1] - self.bounds[known]
        out = np.zeros(len(known) + 1, np.int64)
        np.cumsum(count, out=out[1:])
        return self.ids[flat_ranges(starts, count)], out


@functools.lru_cache(maxsize=2)
def memo(path: str) -> WordMemo:
    """The memo of this Python worker for the tokenizer in ``path``."""
    return WordMemo(tokenizer(path))
