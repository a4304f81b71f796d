"""SimHash near-duplicates: 64-bit fingerprints, and a vantage-point tree over Hamming distance that finds every pair
of fingerprints within a few bits.

The tree's inner nodes (a vantage point and a radius each) are fitted to a bounded sample; the fingerprints themselves
are all routed. A fingerprint lives in one leaf, its home. It also visits each leaf whose members can lie within the
wanted distance: by the triangle inequality, members beyond a node's radius r are out of reach of a fingerprint at a
distance below r + 1 - bits from the vantage point, and those within it of one at a distance above r + bits. Where the
home lies within the radius, only the fingerprint that lives inside visits the outside, so a pair meets once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved, slices, utf8, words
from .components import connected_components, star_edges

#: Fingerprints that a leaf is meant to hold, and levels of the tree at most (65,535 inner nodes of 9 bytes).
LEAF = 512
DEPTH = 16
#: Sampled fingerprints to fit a leaf's way to, so 1 << 20 (8 MB) at most in all.
SAMPLE_PER_LEAF = 16

#: Bytes of text whose shingles are hashed at a time (they take some 75 times as much). Longer texts are read in pieces.
SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def pieces(raw: np.ndarray, shingle: int, most: int):
    """Cut a long text at white space into pieces of about ``most`` bytes, of which each repeats the last
    ``shingle - 1`` words before it: every shingle lies in exactly one piece. Longer words make longer pieces."""
    start, size = 0, most
    while True:
        part = raw[start : start + size]
        starts, ends, _ = words(part, np.array([0, len(part)]), GAP[part])
        if start + size >= len(raw):
            if start == 0 or len(starts) >= shingle:  # else nothing but words that the last piece had
                yield part
            return
        whole = len(starts) - int(len(starts) > 0 and ends[-1] == len(part))  # the last one may go on
        if whole < shingle:
            size *= 2
            continue
        yield part[: ends[whole - 1]]
        start += int(starts[whole - shingle + 1]) if shingle > 1 else int(ends[whole - 1])
        size = most


def tally(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit is set in the hashes of each row's shingles, and the number of these."""
    total = np.zeros((len(at) - 1, 64), np.int64)
    raw = LOWER[raw]
    gap = GAP[raw]
    starts, ends, bounds = words(raw, at, gap)
    count = np.diff(bounds)
    shingles = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    if not len(starts):
        return total, shingles
    keep = ~gap
    keep[ends[ends < len(raw)]] = True  # one gap byte after each word, as a space
    raw[gap] = 0x20
    place = np.cumsum(keep) - keep
    body = raw[keep].tobytes()
    lengths = ends - starts
    starts = place[starts]
    ends = starts + lengths
    rows = np.flatnonzero(shingles)
    first = np.cumsum(shingles) - shingles
    word = np.arange(int(shingles.sum())) + np.repeat((bounds[:-1] - first)[rows], shingles[rows])
    last = word + np.repeat(np.minimum(count, shingle)[rows] - 1, shingles[rows])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], 42) for a, b in zip(starts[word].tolist(), ends[last].tolist())], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total[rows] = np.add.reduceat(bits, first[rows], axis=0, dtype=np.int32)
    return total, shingles


def fingerprint_rows(raw: np.ndarray, at: np.ndarray, shingle: int, most: int = SLICE_BYTES) -> np.ndarray:
    """The fingerprint of each row of text, as unsigned 64-bit integers. A single long row is read in pieces."""
    if len(at) == 2 and len(raw) > most:
        ones, count = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
        for piece in pieces(raw, shingle, most):
            more, n = tally(piece, np.array([0, len(piece)]), shingle)
            ones += more
            count += n
    else:
        ones, count = tally(raw, at, shingle)
    major = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(major).view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """``<key>, fp`` (the fingerprint's bits as a signed long) of each row of ``docs(<key>, text)``.

    The whole text is lower-cased (A-Z only) and cut into words at ASCII white space; a bit is 1 if it is set in over
    half of the XXH64 hashes (seed 42) of the shingles, repeats included. Fewer words than ``shingle`` are one
    shingle; no word, an empty or a null text gives 0."""

    def compute(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                fp = fingerprint_rows(*utf8(part.column("text")), shingle).view(np.int64)
                yield pa.record_batch([part.column(key), pa.array(fp)], [key, "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key) if key == "doc_id" else key, "text")
    return rows.mapInArrow(compute, StructType([rows.schema[key], StructField("fp", LongType())]))


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Inner nodes in heap order: vantage points and radii; the children of node i are 2i + 1 (within) and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.radius = np.zeros(2**depth - 1, np.int8)
        pick = np.random.default_rng(seed)
        own = {0: sample}
        for node in range(len(self.vantage)):
            members = own.pop(node, sample[:0])
            if len(members):
                tried = members[pick.integers(0, len(members), 8)]
                spread = [distance(members, v).std() for v in tried]
                self.vantage[node] = tried[int(np.argmax(spread))]
                far = distance(members, self.vantage[node])
                # the radius that halves the members best
                cut = np.sort(far)[(len(far) - 1) // 2]
                below, upto = (far < cut).mean(), (far <= cut).mean()
                self.radius[node] = cut - 1 if abs(below - 0.5) < abs(upto - 0.5) else cut
                inside = far <= self.radius[node]
                own[2 * node + 1], own[2 * node + 2] = members[inside], members[~inside]

    def route(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (index of the fingerprint, leaf, whether it is at home there)."""
        index, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            far = distance(fps[index], self.vantage[node])
            radius = self.radius[node].astype(np.int16)
            inside = far <= radius
            goes_in = np.where(home, inside, far <= radius + bits)
            goes_out = far >= radius + 1 - bits
            index = np.concatenate([index[goes_in], index[goes_out]])
            home = np.concatenate([home[goes_in], (home & ~inside)[goes_out]])
            node = np.concatenate([2 * node[goes_in] + 1, 2 * node[goes_out] + 2])
        return index, node, home


def pairs_within(home: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a leaf's members, and of a visitor and a member, within ``bits``. Both are first ordered by their
    distance to one more vantage point; only those whose distances differ by ``bits`` at most are compared."""
    pivot = home[0]
    both = np.concatenate([home, visitors])
    far = distance(both, pivot)
    lefts, rights = [], []
    for d in range(65):
        own = np.flatnonzero(far[: len(home)] == d)
        if not len(own):
            continue
        # members at the same or a larger distance (each pair once), visitors on both sides
        near = np.flatnonzero((np.abs(far - d) <= bits) & ((far >= d) | (np.arange(len(both)) >= len(home))))
        step = max(1, (1 << 21) // len(near))
        for k in range(0, len(own), step):
            block = own[k : k + step]
            i, j = np.nonzero(np.bitwise_count(both[block][:, None] ^ both[near][None, :]) <= bits)
            a, b = block[i], near[j]
            once = (b >= len(home)) | (far[b] > d) | (a < b)
            lefts.append(both[a[once]])
            rights.append(both[b[once]])
    if not lefts:
        return home[:0], home[:0]
    return np.concatenate(lefts), np.concatenate(rights)


def hamming_forest(fps: DataFrame, bits: int) -> DataFrame:
    """``src, dst``: for the distinct fingerprints in ``fp``, links between fingerprints that differ in ``bits`` bits
    or fewer: for each leaf a spanning forest of them, so that no connection is lost and no group's pairs are listed.
    """
    n = fps.count()
    depth = int(np.clip(np.ceil(np.log2(max(1, n / LEAF))), 0, DEPTH))
    want = SAMPLE_PER_LEAF << depth
    rate = max(1, n // want)
    sampled = fps.where(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).limit(2 * want)  # bounded: fits the tree only
    sample = np.array([r.fp for r in sampled.collect()], np.int64).view(np.uint64)
    tree = VantageTree(np.sort(sample), depth)

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 1024):
                own = fp[k : k + 1024]
                index, leaf, home = tree.route(own, bits)
                yield pa.record_batch([pa.array(leaf), pa.array(own[index].view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    def compare(leaf: pa.Table) -> pa.Table:
        fp, home = leaf.column("fp").to_numpy().view(np.uint64), leaf.column("home").to_numpy()
        left, right = pairs_within(np.sort(fp[home]), np.sort(fp[~home]), bits) if home.any() else (fp[:0], fp[:0])
        nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
        links = nodes[star_edges(len(nodes), ends[: len(left)], ends[len(left) :])].view(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], ["src", "dst"])

    routed = fps.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")
    return routed.groupBy("leaf").applyInArrow(compare, "src long, dst long")


def _components(rows: DataFrame, bits: int, best) -> DataFrame:
    """``fp, best``: the least ``best`` of the rows of each fingerprint's component."""
    distinct = saved(rows.groupBy("fp").agg(F.min(best).alias("own")), "distinct-fingerprints")
    parts = connected_components(hamming_forest(distinct, bits))
    named = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "own", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("own").alias("best"))
    return named.join(least, "component").select("fp", "best")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs(doc_id, text)``: ``component_id`` is the smallest doc_id that
    links of ``bits`` differing bits or fewer reach from the row's fingerprint.

    Rows with a null doc_id have a fingerprint and link like others, but their id is never a component's, unless no
    row of the component has one: then that is null. Repeated rows are returned each; texts without words share the
    fingerprint 0; an empty table gives no rows; other columns are ignored."""
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    owner = _components(rows, bits, F.col("doc_id")).select("fp", F.col("best").alias("component_id"))
    return rows.join(owner, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id (null ids last),
    then the smallest hash of its text, once.

    A document is a doc_id and a text: rows with the same doc_id and different texts are told apart, a row that repeats
    both goes. Texts without words are one group. An empty table stays empty; columns may have any names."""
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text")).alias("key"))
    rows = saved(fingerprints(keyed.select("key", F.col("row.text").alias("text")), shingle, "key"), "fingerprints")
    best = _components(rows, bits, F.col("key")).select(F.col("best").alias("key")).distinct()
    return keyed.join(best, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
