"""Line dedup: near-duplicate lines by MinHash, one line kept of each group.

Lines become sets of character shingles and one-permutation MinHash signatures; lines that share a band are candidates,
exact Jaccard similarity decides, and connected components make the groups. A bucket's pairs are never listed: each of
its lines goes once to the task that compares it, where lines that are connected already are not compared again. Large
buckets are cut into parts, of which every two meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, utf8
from .components import connected_components

#: Characters of a shingle, and the similarity from which lines are near-duplicates.
SHINGLE, SIMILARITY = 8, 0.8
#: Bands and hashes in each: a pair at the similarity 0.8 shares a band with a chance of 1 - (1 - 0.8**4)**10 = 0.995.
BANDS, ROWS = 10, 4
#: Bits of the map by which the second scan knows candidates (8 MB; what is let through in error costs time only).
MAP_BITS = 26

#: Bytes of text at a time: what is made of them stays in a core's cache and in memory that is used again.
SLICE_BYTES = 1 << 17
#: In place of an empty bin's smallest hash.
EMPTY = np.uint32(0xFFFFFFFF)

#: Lines in a part of a bucket.
TILE = 512

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def line_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The non-blank lines of lower-cased texts with white space trimmed and runs of it as one space: their bytes,
    their offsets in them, and each line's row and number in its row."""
    raw, at = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(raw):
        return raw, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.zeros(len(raw) + 1, bool)
    begin[at[:-1][np.diff(at) > 0]] = True
    begin[1:] |= raw == 0x0A
    begins = np.flatnonzero(begin[:-1])
    row = np.searchsorted(at, begins, "right") - 1
    number = np.arange(len(begins)) - np.searchsorted(row, row)
    gap = SPACE[raw]
    # words, and the last of each run of white space ..
    keep = ~gap
    keep[:-1] |= keep[1:]
    # .. but not the one before a line's first word
    ends = np.flatnonzero(gap & keep)
    before = begins[~gap[begins] & (begins > 0)] - 1
    keep[before[gap[before]]] = False
    first = np.searchsorted(ends, begins[gap[begins]])
    keep[ends[first[first < len(ends)]]] = False
    body = np.where(gap, np.uint8(0x20), raw)[keep]
    offsets = np.add.reduceat(keep.view(np.uint8), begins, dtype=np.int64)
    own = np.flatnonzero(offsets)
    return body, np.append(0, np.cumsum(offsets[own])), row[own], number[own]


def line_ids(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """XXH64 of each line, as signed longs: the line's id."""
    text = body.tobytes()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], 5) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64)


def band_keys(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band keys of each line, from one hash per shingle: hashes are dealt into bins by their top, the smallest in
    each bin is kept, and an empty bin takes the value of a bin that a hash of its number chooses. Lines shorter than
    a shingle are one shingle."""
    n, bins = len(at) - 1, BANDS * ROWS
    if not n:
        return np.zeros((0, BANDS), np.int64)
    text = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(text) != len(body):  # characters instead of bytes
        first = ((body & 0xC0) != 0x80).view(np.uint8)
        at = np.append(0, np.cumsum(np.add.reduceat(first, at[:-1], dtype=np.int64)))
    odd = np.random.default_rng(11).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes, term = text * odd[0], np.empty(len(text), np.uint64)
    for k in range(1, min(SHINGLE, len(text))):
        hashes[:-k] += np.multiply(text[k:], odd[k], out=term[:-k])
    # a shorter line's shingle ends with it: what follows it in the slice is no part of its hash
    lengths = np.diff(at)
    for k in range(1, SHINGLE):
        over = at[:-1][lengths <= k] + k
        over = over[over < len(text)]
        hashes[over - k] -= text[over] * odd[k]
    hashes ^= np.right_shift(hashes, np.uint64(31), out=term)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    hashes ^= np.right_shift(hashes, np.uint64(29), out=term)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    # a shingle starts at each character of a line but its last ones; a line's first character always starts one
    inside = np.ones(len(text), bool)
    for k in range(1, SHINGLE):
        late = at[1:] - k
        inside[late[late > at[:-1]]] = False
    starts = np.maximum(lengths - SHINGLE + 1, 1)
    hashes = hashes[inside]
    slot = np.repeat(np.arange(n, dtype=np.int64) * bins, starts)
    slot += ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
    least = np.full(n * bins, EMPTY, np.uint32)
    np.minimum.at(least, slot, np.minimum(hashes.astype(np.uint32), EMPTY - np.uint32(1)))
    least = least.reshape(n, bins)
    full = least != EMPTY
    pick = np.random.default_rng(13)
    empty_rows, empty_bins = np.nonzero(~full)
    values = least.copy()
    for _ in range(64):
        if not len(empty_rows):
            break
        other = pick.integers(0, bins, bins)[empty_bins]
        hit = full[empty_rows, other]
        values[empty_rows[hit], empty_bins[hit]] = least[empty_rows[hit], other[hit]]
        empty_rows, empty_bins = empty_rows[~hit], empty_bins[~hit]
    if len(empty_rows):
        values[empty_rows, empty_bins] = least[empty_rows].min(axis=1)
    bands = values.reshape(n, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (n, BANDS)).copy()
    for k in range(ROWS):
        keys = (keys ^ bands[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def shingles(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def whole_buckets(lines: DataFrame) -> DataFrame:
    """``band, h`` of the buckets with two lines or more, from ``lines(h, bands)``, where a line may occur without its
    bands. Of buckets with the same lines only the one whose band comes first is kept: near-copies share most of their
    bands, and would meet in each of them. A bit map keeps nearly all bands of one line from being shuffled again."""
    buckets = lines.select("h", F.explode("bands").alias("band")).groupBy("band").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    buckets = saved(buckets.where("x <> y").select("band"), "buckets")
    sent = bit_map(buckets, "band")

    def members(batches):
        for batch in batches:
            bands, h = batch.column("bands"), batch.column("h").to_numpy()
            values, sizes = bands.flatten().to_numpy(), np.diff(bands.offsets.to_numpy())
            own = np.flatnonzero(on_map(sent.value, values))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch([pa.array(values[own]), pa.array(place[own].astype(np.int32)), pa.array(np.repeat(h, sizes)[own])], ["band", "at", "h"])

    found = lines.select("h", "bands").mapInArrow(members, "band long, at int, h long")
    shared = saved(found.join(buckets, "band").distinct(), "bucket-lines")
    named = shared.groupBy("band").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    first = named.groupBy("n", "x", "y").agg(F.min(F.struct("at", "band")).alias("b")).select(F.col("b.band").alias("band"))
    return shared.select("band", "h").join(saved(first, "first-buckets"), "band", "left_semi")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def bit_map(rows: DataFrame, column: str):
    """A broadcast map of fixed size that has a bit set for each value (long) of the column."""
    slot = F.pmod(column, F.lit(1 << MAP_BITS))
    maps = rows.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(((1 << MAP_BITS) // 32768 + 2, 4096), np.uint8)  # 4 KB for each of 2,048 parts
    for r in maps:
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def on_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the values' bits are set: all that were put on the map, and few others."""
    slot = values & ((1 << MAP_BITS) - 1)
    # numbers and places as bitmap_bucket_number and bitmap_bit_position give them
    number = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    place = np.where(slot > 0, (slot - 1) % 32768, 0)
    return (bits[number, place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, line, bands`` of the lines in ``wanted(h)``, from another scan of the documents. A bit map of fixed size
    keeps nearly all other lines from being shuffled."""
    sent = bit_map(wanted, "h")

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                body, at, _, _ = line_slices(part.column("text"))
                ids = line_ids(body, at)
                hit = on_map(sent.value, ids)
                yield _banded(body, at, ids, hit, texts=True)

    found = docs.select("text").mapInArrow(find, "h long, line string, bands array<long>")
    return found.join(wanted, "h", "left_semi").dropDuplicates(["h"])


def _banded(body: np.ndarray, at: np.ndarray, ids: np.ndarray, chosen: np.ndarray, texts: bool = False) -> pa.RecordBatch:
    """Ids and bands of the chosen lines, each id once, and their texts if wanted."""
    _, once = np.unique(ids, return_index=True)
    own = np.zeros(len(ids), bool)
    own[once] = True
    own &= chosen
    lengths = np.diff(at)
    part, bounds = body[np.repeat(own, lengths)], np.append(0, np.cumsum(lengths[own]))
    keys = band_keys(part, bounds)
    columns = {"h": pa.array(ids[own])}
    if texts:
        text = part.tobytes()
        columns["line"] = pa.array([text[a:b].decode("utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())
    columns["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
    return pa.record_batch(list(columns.values()), list(columns))


def _links(ids: np.ndarray, bands: np.ndarray, lines: list[str], band: int) -> list[tuple[int, int]]:
    """Links that connect what is similar among a bucket's lines. Pairs that share an earlier band are left to that
    band's bucket; sets are made for lines that need a comparison."""
    where = int(np.flatnonzero(bands[0] == band)[0])
    label, found, sets = np.arange(len(ids)), [], {}

    def of(k: int) -> set[str]:
        if k not in sets:
            sets[k] = shingles(lines[k])
        return sets[k]

    for i in range(len(ids) - 1):
        apart = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        apart = apart[(bands[apart, :where] != bands[i, :where]).all(axis=1)]
        for j in apart.tolist():
            if label[j] != label[i]:
                common = len(of(i) & of(j))
                if common >= SIMILARITY * (len(of(i)) + len(of(j)) - common):
                    found.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
    return found


def _bucket_links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """``src, dst``: links between the lines of each bucket in ``shared(band, h)``."""
    sizes = shared.groupBy("band").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    placed = shared.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("h", F.lit(1)), F.col("parts")))
    # every two parts meet: a part alone only where the bucket has no other
    last = F.col("parts") - 1
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("part <> other or parts = 1")
    tiles = tiles.select("band", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "h").join(texts, "h")
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tiles.repartition(n, "band", "a", "b").sortWithinPartitions("band", "a", "b", "h").select("band", "a", "b", "h", "line", "bands")

    def compare(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            ids = np.stack([table.column(c).to_numpy() for c in ("band", "a", "b")])
            bounds = np.append(0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1)
            yield from links(table, bounds)
            carry = table.slice(bounds[-1])
        if carry is not None:
            yield from links(carry, np.array([0, carry.num_rows]))

    def links(table, bounds):
        band, h, found = table.column("band").to_numpy(), table.column("h").to_numpy(), []
        bands, lines = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS), table.column("line").to_pylist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found += _links(h[a:b], bands[a:b], lines[a:b], band[a])
        left, right = zip(*found) if found else ((), ())
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["src", "dst"])

    return saved(ordered.mapInArrow(compare, "src long, dst long"), "line-links")


def line_groups(docs: DataFrame) -> DataFrame:
    """The groups of near-duplicate lines of ``docs(doc_id, text)``.

    One row per non-blank line: ``doc_id, text_hash, line_no`` (from 0, blank lines counted), ``group_doc, group_text,
    group_line`` (the group's first line by doc_id, then text hash, then number) and ``kept`` (this is it). Lines are
    compared lower-cased and with white space evened out; near means a Jaccard similarity of 0.8 or more of 8-character
    shingles. Lines are identified by 64-bit hashes.

    A document is a doc_id and a text: a row that repeats both counts once, rows with the same doc_id and different
    texts are told apart by the text's hash. Null doc_ids come last; null, empty and blank texts have no lines; an
    empty table gives no rows; other columns are ignored. Lines of any length are read whole.
    """
    keyed = _keyed(docs)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                body, at, row, number = line_slices(part.column("text"))
                ids = line_ids(body, at)
                banded = _banded(body, at, ids, np.ones(len(ids), bool))
                first = np.zeros(len(ids), np.int64)
                first[np.unique(ids, return_index=True)[1]] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)), pa.int32()), banded.column("bands").flatten())
                take = pa.array(row)
                yield pa.record_batch([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(number), pa.array(ids), bands], ["doc_id", "text_hash", "line_no", "h", "bands"])

    lines = saved(keyed.mapInArrow(scan, "doc_id long, text_hash long, line_no long, h long, bands array<long>"), "lines")
    shared = saved(whole_buckets(lines), "shared-lines")
    texts = saved(_texts(keyed, shared.select("h").distinct()), "line-texts")
    parts = connected_components(_bucket_links(shared, texts))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "line_no")
    own = lines.groupBy("h").agg(F.min(first).alias("first")).join(parts.select(F.col("node").alias("h"), "component"), "h", "left").select("h", "first", F.coalesce("component", "h").alias("component"))
    own = saved(own, "first-lines")
    best = own.groupBy("component").agg(F.min("first").alias("best"))
    named = own.join(best, "component").select("h", "best")
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "line_no")
    rows = lines.select("doc_id", "text_hash", "line_no", "h").join(named, "h")
    return rows.select("doc_id", "text_hash", "line_no", F.col("best.doc_id").alias("group_doc"), F.col("best.text_hash").alias("group_text"), F.col("best.line_no").alias("group_line"), at.eqNullSafe(F.col("best")).alias("kept")).distinct()


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one line of each group: other lines of the group are cut out of their texts. Documents that lose
    every non-blank line go; those without any line stay; a row that repeats a doc_id and its text goes."""
    groups = line_groups(docs)
    lost = groups.where("not kept").groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("lost"))
    count = groups.groupBy("doc_id", "text_hash").agg(F.min((~F.col("kept")).cast("int")).alias("all_lost"))
    lost = lost.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    verdict = count.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    verdict = saved(verdict.select(F.struct(F.col("doc_id"), F.col("text_hash")).alias("key"), F.struct("all_lost", "lost").alias("lost")), "lost-lines")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    # columns of the documents stay inside one struct, so that they may have any names
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key")).dropDuplicates(["key"])
    joined = keyed.join(verdict, "key", "left").where("lost is null or lost.all_lost = 0")
    rest = F.expr("concat_ws('\n', transform(filter(transform(split(row.text, '\n'), (x, i) -> struct(x as x, cast(i as bigint) as i)), y -> not array_contains(lost.lost, y.i)), y -> y.x))")
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(rest)
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
