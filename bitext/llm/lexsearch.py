"""Ranked lexical search by pipelined term partitioning.

The corpus becomes shards of documents; each shard's postings are split between a few owners of terms, rare terms first.
A bundle of items visits the owners of a shard one stage after the other: a cogroup brings its sparse accumulators (item,
document, sum so far) to the owner's postings, which add whole-number contributions. Between stages the k-th best sum of
each item over all shards becomes known; documents that cannot reach it with all that the later owners may still add are
dropped, which changes no result. The last stage selects.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_slices, saved, slices, utf8, words

#: Bytes that no term holds: ASCII other than letters and digits. Capital ASCII letters are lower-cased.
GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Text of a shard, and of the pieces that it is read in.
SHARD_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: Items that one pass over the corpus answers, and items in a bundle.
BLOCK, BUNDLE = 1024, 256
#: Up to which share of the work (items' postings) each stage's terms reach.
SHARES = (0.04, 0.2, 0.5, 1.0)


def pieces(raw: np.ndarray, at: np.ndarray, most: int = PIECE_BYTES):
    """Terms of rows of bytes, piece by piece of about ``most`` bytes: row of each term, its code and the distinct terms.
    Pieces are cut between terms, so that a long row needs no more memory than others."""
    start = 0
    while start < len(raw):
        end = min(start + most, len(raw))
        while end < len(raw) and not GAP[raw[end]]:  # not inside a term
            back = np.flatnonzero(GAP[raw[start:end]])
            if len(back):
                end = start + int(back[-1]) + 1
                break
            ahead = np.flatnonzero(GAP[raw[end : end + most]])
            end = end + int(ahead[0]) if len(ahead) else min(end + most, len(raw))
        first = int(np.searchsorted(at, start, "right")) - 1
        last = int(np.searchsorted(at, end, "left"))
        own = LOWER[raw[start:end]]
        begins, ends, bounds = words(own, np.clip(at[first : last + 1], start, end) - start, GAP[own])
        if len(begins):
            codes, distinct = distinct_slices(own, begins, ends)
            yield first + np.repeat(np.arange(last - first), np.diff(bounds)), codes, distinct
        start = end


def _tokenised(items: DataFrame) -> DataFrame:
    """``part, place, item_id, terms, times`` of each item with a term: its distinct terms and how often it has them."""

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in range(batch.num_rows):
                counts: dict[bytes, int] = {}
                for _, codes, distinct in pieces(*utf8(batch.column("text").slice(row, 1))):
                    for term, n in zip(distinct.to_pylist(), np.bincount(codes).tolist()):
                        counts[term] = counts.get(term, 0) + n
                if counts:
                    yield pa.record_batch(
                        [pa.array([part], pa.int32()), pa.array([place], pa.int32()), batch.column("item_id").slice(row, 1), pa.array([list(counts)], pa.list_(pa.binary())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
                        ["part", "place", "item_id", "terms", "times"],
                    )
                place += 1

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return saved(rows.mapInArrow(run, "part int, place int, item_id long, terms array<binary>, times array<long>"), "items")


def _index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """A row for each shard of documents: ``part, slice`` (its name), ``doc_id`` and ``n`` (terms with repeats) of its
    documents, and the postings of ``terms`` (by number) in them, ordered by document: how many each document has
    (``held``), ``term`` and ``tf``."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        wanted = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            for own in slices(batch, "text", SHARD_BYTES):
                rows = own.num_rows
                n, keys, counts = np.zeros(rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row, codes, distinct in pieces(*utf8(own.column("text"))):
                    n += np.bincount(row, minlength=rows)
                    term = pc.index_in(distinct, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                    key, count = np.unique(row[term >= 0] * len(wanted) + term[term >= 0], return_counts=True)
                    keys.append(key)
                    counts.append(count)
                key, place = np.unique(np.concatenate(keys), return_inverse=True)
                tf = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int32)
                held = np.bincount(key // max(1, len(wanted)), minlength=rows).astype(np.int32)
                lists = (own.column("doc_id"), pa.array(n), pa.array(held), pa.array((key % max(1, len(wanted))).astype(np.int32)), pa.array(tf))
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)],
                    ["part", "slice", "doc_id", "n", "held", "term", "tf"],
                )
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(run, "part int, slice int, doc_id array<long>, n array<long>, held array<int>, term array<int>, tf array<int>"), "index")


def _statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each wanted term is."""

    def run(batches):
        found = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            n, term = batch.column("n").flatten().to_numpy(), batch.column("term").flatten().to_numpy()
            found[:-2] += np.bincount(term, minlength=n_terms)
            found[-2:] += (n > 0).sum(), n.sum()
        own = np.flatnonzero(found)
        yield pa.record_batch([pa.array(own), pa.array(found[own])], ["key", "n"])

    sums = np.zeros(n_terms + 2, np.int64)
    for r in index.select("n", "term").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        sums[r.key] = r.n
    return int(sums[-2]), int(sums[-1]), sums[:-2]


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // total for x in n.tolist()], np.int64)
    return 25 + 75 * n * documents // max(total, 1)


class _Plan:
    """What every task knows of a block of items: each item's terms and times, the terms' weights and owners, and what
    later owners may add to an item at most."""

    def __init__(self, items: list, number: dict[bytes, int], documents: int, total: int, df: np.ndarray, k: int):
        self.k, self.documents, self.total = k, documents, total
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.terms = [np.array([number[t] for t in r.terms], np.int64) for r in items]
        self.times = [np.array(r.times, np.int64) for r in items]
        users = np.bincount(np.concatenate(self.terms), minlength=len(df)) if items else np.zeros(len(df), np.int64)
        order = np.argsort(-self.weight, kind="stable")
        work = np.cumsum((users * df)[order])
        self.owner = np.zeros(len(df), np.int64)
        self.owner[order] = np.searchsorted(np.array(SHARES) * (work[-1] if len(work) else 0), work, "left").clip(max=len(SHARES) - 1)
        self.later = [np.array([int((q * self.weight[t])[self.owner[t] > s].sum()) * 1_000_000 for t, q in zip(self.terms, self.times)], np.int64) for s in range(len(SHARES))]


def _owned(index: DataFrame, plan, stage: int, bundles: int) -> DataFrame:
    """The postings of a stage's owner: ``part, slice, bundle, doc, term, tf`` and the documents' ``m``."""

    def run(batches):
        p = plan.value
        for batch in batches:
            for k in range(batch.num_rows):
                n, held, term, tf = (batch.column(c)[k].values.to_numpy() for c in ("n", "held", "term", "tf"))
                own = p.owner[term] == stage
                doc = np.repeat(np.arange(len(n), dtype=np.int32), held)[own]
                lists = [pa.array(doc), pa.array(term[own]), pa.array(tf[own]), pa.array(length_factor(n, p.documents, p.total)), batch.column("doc_id")[k].values]
                yield pa.record_batch([batch.column("part").slice(k, 1), batch.column("slice").slice(k, 1), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)], ["part", "slice", "doc", "term", "tf", "m", "doc_id"])

    rows = index.mapInArrow(run, "part int, slice int, doc array<int>, term array<int>, tf array<int>, m array<long>, doc_id array<long>")
    return rows.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))


def _added(plan: _Plan, stage: int, bundle: int, state: pa.Table, posted: pa.Table):
    """For each item of the bundle with what it has in the shard after the stage: item, documents and their sums."""
    doc, term, tf, m = (posted.column(c)[0].values.to_numpy() for c in ("doc", "term", "tf", "m"))
    order = np.argsort(term, kind="stable")
    doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
    worth = plan.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    items = range(bundle * BUNDLE, min((bundle + 1) * BUNDLE, len(plan.terms)))
    if state.num_rows:
        sizes, at_doc, at_sum = (state.column(c)[0].values.to_numpy() for c in ("sizes", "doc", "sum"))
        ends = np.cumsum(sizes)
    for j, item in enumerate(items):
        sums = np.zeros(len(m), np.int64)
        if state.num_rows and sizes[j]:
            own = slice(ends[j] - sizes[j], ends[j])
            sums[at_doc[own]] = at_sum[own]
        mine = plan.owner[plan.terms[item]] == stage
        terms, times = plan.terms[item][mine], plan.times[item][mine]
        for a, b, q in zip(np.searchsorted(term, terms, "left").tolist(), np.searchsorted(term, terms, "right").tolist(), times.tolist()):
            if a < b:
                sums[doc[a:b]] += q * worth[a:b]
        has = np.flatnonzero(sums)
        yield item, has, sums[has]


def _kth(sums: np.ndarray, k: int) -> int:
    return int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0


def _stage(state: DataFrame, posted: DataFrame, plan, stage: int, least: np.ndarray) -> DataFrame:
    """The bundles after a stage: ``sizes`` (documents by item), ``doc``, ``sum``, and ``top_item, top``, the best sums
    of each item."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p, bundle = plan.value, key[2].as_py()
        sizes, docs, sums, top_item, top = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        for item, has, own in _added(p, stage, bundle, left, right):
            best = own if len(own) <= p.k else -np.partition(-own, p.k - 1)[: p.k]
            best = best[best > least[item]]
            top_item += [item] * len(best)
            top.append(best)
            alive = own + p.later[stage][item] >= max(int(least[item]), _kth(own, p.k))
            sizes.append(int(alive.sum()))
            docs.append(has[alive].astype(np.int32))
            sums.append(own[alive])
        lists = (pa.array(sizes, pa.int32()), pa.array(np.concatenate(docs)), pa.array(np.concatenate(sums)), pa.array(top_item, pa.int32()), pa.array(np.concatenate(top)))
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key] + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists], ["part", "slice", "bundle", "sizes", "doc", "sum", "top_item", "top"])

    name = ["part", "slice", "bundle"]
    made = state.groupBy(name).cogroup(posted.groupBy(name)).applyInArrow(run, "part int, slice int, bundle int, sizes array<int>, doc array<int>, sum array<long>, top_item array<int>, top array<long>")
    return saved(made, f"bundles-{stage}")


def _reached(state: DataFrame, least: np.ndarray, k: int) -> np.ndarray:
    """The k-th best sum of each item over all shards, or what was known before."""
    rows = state.select(F.explode(F.arrays_zip("top_item", "top")).alias("x")).select(F.col("x.top_item").alias("item"), F.col("x.top").alias("v"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("v")))).where(F.col("r") <= k)
    out = least.copy()
    for r in ranked.where(F.col("r") == k).collect():  # a row for each item of the block
        out[r["item"]] = max(int(out[r["item"]]), int(r["v"]))
    return out


def _selected(state: DataFrame, posted: DataFrame, plan, stage: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: the k best of each item in each shard that may be among the best of all."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p, bundle = plan.value, key[2].as_py()
        ids = right.column("doc_id")[0].values
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        items, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, has, own in _added(p, stage, bundle, left, right):
            good = own >= max(int(least[item]), _kth(own, p.k))
            has, own = has[good], own[good]
            order = np.lexsort((number[has], null[has], -own))[: p.k]
            items += [item] * len(order)
            docs.append(has[order])
            scores.append(own[order])
        return pa.table([pa.array(items, pa.int32()), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    name = ["part", "slice", "bundle"]
    return state.groupBy(name).cogroup(posted.groupBy(name)).applyInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs(doc_id, text)`` with the highest scores above 0
    for each row of ``items(item_id, text)`` (all, if fewer), best first, equal scores by doc_id.

    Every row of either table counts for itself, repeated ones and those with a null id too; a null doc_id comes after
    all others of the same score. Null and empty texts and those without terms are no documents, and such items have no
    rows; an empty table gives none. Other columns are ignored. Texts are read whole, in pieces.

    Items are answered in blocks of about ``BLOCK``, of which every task holds the terms, and one pass over the corpus
    is made for each block."""
    spark = docs.sparkSession
    asked = _tokenised(items)
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("part", "place"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        own = asked.where(F.col("block") == block).orderBy("part", "place").collect()  # about BLOCK items
        terms = sorted({t for r in own for t in r.terms})
        if not terms:
            continue
        index = _index(docs, terms)
        plan = _Plan(own, {t: k for k, t in enumerate(terms)}, *_statistics(index, len(terms)), k)
        sent = spark.sparkContext.broadcast(plan)
        bundles = math.ceil(len(own) / BUNDLE)
        least = np.zeros(len(own), np.int64)
        state = index.select("part", "slice").where("1 = 0").selectExpr("part", "slice", "0 AS bundle", "array(0) AS sizes", "array(0) AS doc", "array(0L) AS sum")
        for stage in range(len(SHARES) - 1):
            state = _stage(state, _owned(index, sent, stage, bundles), sent, stage, least)
            least = _reached(state, least, k)
            state = state.drop("top_item", "top")
        best = _selected(state, _owned(index, sent, len(SHARES) - 1, bundles), sent, len(SHARES) - 1, least)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(own)], "item int, item_id long")
        ranked = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
