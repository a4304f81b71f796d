"""BPE encoding and decoding with a minimal acyclic transducer.

The corpus's most frequent words are compiled, with their ids, into an automaton in which words share prefixes and
suffixes. Its arcs carry numbers that add up to a word's place in the list of outputs. Its file goes to every executor
and is memory-mapped there, so workers share one copy. Words that the automaton does not know are merged exactly.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, tokenizer, word_starts
from .common import distinct_slices, first_values, flat_ranges, saved, shared_dir, slices, utf8

#: Words of the lexicon, and their bytes at most (rarer and longer words are merged).
WORDS, WORD_BYTES = 1 << 16, 32


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[bytes]:
    """The most frequent words in all of ``docs(text)``, sorted: all that occur at least as often as the rarest."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = utf8(part.column("text"))
                starts = word_starts(raw, at)
                if len(starts):
                    codes, distinct = distinct_slices(raw, starts, np.append(starts[1:], len(raw)))
                    yield pa.record_batch([distinct.cast(pa.binary()), pa.array(np.bincount(codes))], ["w", "n"])

    counts = docs.select("text").mapInArrow(count, "w binary, n long").where(F.octet_length("w") <= WORD_BYTES).groupBy("w").agg((-F.sum("n")).alias("rarity"))
    return sorted(bytes(r.w) for r in first_values(saved(counts, "words"), "rarity", most).select("w").collect())


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and finality of the states of the minimal automaton of sorted distinct words, and its start state. States
    are frozen from the longest suffix up as soon as no later word can change them; equal ones become one."""
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[list] = [[{}, False]]  # states along the last word, still open: arcs, finality

    def freeze(node: list) -> int:
        key = (node[1], tuple(node[0].items()))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(node[0])
            final.append(node[1])
        return known[key]

    last = b""
    for word in words:
        common = len(os.path.commonprefix([word, last]))
        while len(path) > common + 1:
            state = freeze(path.pop())
            path[-1][0][last[len(path) - 1]] = state
        path += [[{}, False] for _ in range(len(word) - common)]
        path[-1][1] = True
        last = word
    while len(path) > 1:
        state = freeze(path.pop())
        path[-1][0][last[len(path) - 1]] = state
    return arcs, final, freeze(path[0])


def compile_lexicon(words: list[bytes], bpe: ByteBpe) -> bytes:
    """The lexicon's file: little-endian 64-bit integers.

    8 numbers: slots, states, words, ids, start state, 3 reserved. For each slot of a hash table with linear probing:
    state * 256 + byte of an arc (or -1), the arc's target, and the number of words that come before those through the
    arc. For each state: 1 if a word ends there. For each word: its first id's place; then the number of ids. The ids.
    """
    arcs, final, start = automaton(words)
    below = [0] * len(arcs)  # words from each state on; targets are frozen before their sources
    for state, own in enumerate(arcs):
        below[state] = final[state] + sum(below[t] for t in own.values())
    keys, targets, adds = [], [], []
    for state, own in enumerate(arcs):
        before = int(final[state])
        for byte, target in sorted(own.items()):
            keys.append(state * 256 + byte)
            targets.append(target)
            adds.append(before)
            before += below[target]
    slots = 1 << max(1, (3 * len(keys)).bit_length())
    table = np.full((3, slots), -1, np.int64)
    home = slot_of(np.array(keys, np.int64), slots)
    todo = np.arange(len(keys))
    while len(todo):  # all arcs still homeless claim their slot; one of each slot's claimants gets it
        free = table[0][home[todo]] == -1
        slot, first = np.unique(home[todo[free]], return_index=True)
        won = todo[free][first]
        table[:, slot] = np.array(keys, np.int64)[won], np.array(targets, np.int64)[won], np.array(adds, np.int64)[won]
        todo = np.setdiff1d(todo, won)
        home[todo] = (home[todo] + 1) % slots
    ids, bounds = bpe.encode_words(pa.array(words, pa.large_binary()))
    head = [slots, len(arcs), len(words), len(ids), start, 0, 0, 0]
    return np.concatenate([head, table.ravel(), np.array(final, np.int64), bounds, ids]).astype("<i8").tobytes()


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % slots


class Lexicon:
    """A compiled lexicon's file, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", "r")
        self.slots, states, count, n, self.start = (int(x) for x in data[:5])
        at = [8]
        for size in (self.slots, self.slots, self.slots, states, count + 1, n):
            at.append(at[-1] + size)
        self.key, self.target, self.add, self.final, self.bounds, self.ids = (data[a:b] for a, b in zip(at[:-1], at[1:]))

    def look_up(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each word ``raw[at[i]:at[i + 1]]`` in the lexicon, or -1. All words walk together."""
        lengths = np.diff(at)
        out = np.full(len(lengths), -1, np.int64)
        own = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES))
        state, number = np.full(len(own), self.start), np.zeros(len(own), np.int64)
        for k in range(WORD_BYTES + 1):
            done = lengths[own] == k
            ends = done & (self.final[state] == 1)
            out[own[ends]] = number[ends]
            own, state, number = own[~done], state[~done], number[~done]
            if not len(own):
                break
            key = state * 256 + raw[at[own] + k]
            slot = slot_of(key, self.slots)
            open_ = np.arange(len(own))
            while len(open_):  # linear probing
                open_ = open_[(self.key[slot[open_]] != key[open_]) & (self.key[slot[open_]] != -1)]
                slot[open_] = (slot[open_] + 1) % self.slots
            hit = self.key[slot] == key
            own, slot = own[hit], slot[hit]
            state, number = self.target[slot], number[hit] + self.add[slot]
        return out

    def encode_words(self, bpe: ByteBpe, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, end to end, and the words' offsets in them."""
        _, offsets, data = distinct.buffers()
        at = np.frombuffer(offsets, np.int64, len(distinct) + 1, distinct.offset * 8)
        number = self.look_up(np.frombuffer(data, np.uint8), at)
        new = np.flatnonzero(number < 0)
        merged, ends = bpe.encode_words(distinct.take(pa.array(new)))
        all_ids = np.concatenate([self.ids, merged.astype(np.int64)])
        starts, count = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        known = number >= 0
        starts[known], count[known] = self.bounds[number[known]], self.bounds[number[known] + 1] - self.bounds[number[known]]
        starts[new], count[new] = len(self.ids) + ends[:-1], np.diff(ends)
        out = np.zeros(len(number) + 1, np.int64)
        np.cumsum(count, out=out[1:])
        return all_ids[flat_ranges(starts, count)].astype(np.int32), out


@functools.lru_cache(maxsize=2)
def opened(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, end to end, and each id's start and length in them."""
    of = tokenizer(path).token_bytes
    sizes = np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)
    return np.frombuffer(b"".join(of.get(i, b"") for i in range(len(sizes))), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[str]:
    """The texts of rows of ids; bytes that aren't UTF-8 become U+FFFD."""
    data, start, size = token_table(path)
    body = data[flat_ranges(start[ids], size[ids])].tobytes()
    run = np.append(0, np.cumsum(size[ids]))[bounds].tolist()
    return [body[a:b].decode("utf-8", "replace") for a, b in zip(run[:-1], run[1:])]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) and ``decoded``, the text of those ids, of each row
    of ``docs(doc_id, text)``.

    The lexicon is compiled from the words of all documents and handed to the executors as a file. Null and empty
    texts have no ids and the empty text; rows with a null doc_id and repeated rows are returned each; an empty table
    gives no rows; other columns are ignored; very long texts are read whole."""
    spark = docs.sparkSession
    content = compile_lexicon(frequent_words(docs), tokenizer(tokenizer_path))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    store, root = pafs.FileSystem.from_uri(shared_dir(spark))
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(content)
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")

    def run(batches):
        bpe, own = tokenizer(tokenizer_path), opened(name)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(*utf8(part.column("text")), functools.partial(own.encode_words, bpe))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(bounds)), packed, pa.array(decode(ids, bounds, tokenizer_path))], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
