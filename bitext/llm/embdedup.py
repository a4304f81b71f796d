"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected onto many random directions. Near vectors lie in each other's window on most of them, so
the number of windows in which a pair collides, counted over all directions, tells near pairs from others. Counting
for every pair would be quadratic in the rows; so the projections, cut into sorted intervals at random offsets, are
taken in groups, and a pair is counted if all projections of at least one group fall into the same intervals. What
passes the recall-calibrated count is verified by its cosine in double precision.

Sizes follow from the number of rows alone: a group has as many projections as leave one chance neighbour per row, and
there are as many groups as give a pair at the threshold the wanted recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_ranges, saved
from .components import connected_components, star_edges

#: Width of an interval, where projections of unit vectors have about the variance 1.
INTERVAL = 2.0
#: Directions whose windows are counted, and the chances with which a pair at the threshold meets in a group and
#: passes the count.
COUNTED, MEETS, PASSES = 64, 0.99, 0.999
#: Rows of a cell that are compared at a time; larger cells are cut into pairs of such parts, dealt to all tasks.
TILE = 512
#: Pairs held at a time.
PAIRS = 1 << 19


def plan(rows: int, cosine: float) -> tuple[int, int, float, int]:
    """Projections in a group, groups, half-width of the window, and collisions that a pair must reach."""
    apart = math.sqrt(2 - 2 * cosine)  # distance of unit vectors at the threshold

    def same(spread: float) -> float:  # chance of one interval for projections that differ by N(0, spread)
        z = INTERVAL / spread
        return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))

    size = max(2, round(math.log(max(rows, 2)) / -math.log(same(math.sqrt(2)))))
    groups = math.ceil(math.log(1 - MEETS) / math.log(1 - same(apart) ** size))
    hit = math.erf(1 / math.sqrt(2))  # in a window of one standard deviation to either side
    below, least = 0.0, 0
    while below + math.comb(COUNTED, least) * hit**least * (1 - hit) ** (COUNTED - least) <= 1 - PASSES:
        below += math.comb(COUNTED, least) * hit**least * (1 - hit) ** (COUNTED - least)
        least += 1
    return size, groups, apart, least


def directions(width: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, count))


def unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of little-endian doubles of one width."""
    x = np.array([np.frombuffer(v.as_buffer(), "<f8") for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Links of ``vectors(vec_id, embedding)`` with at least the given cosine.

    One row per vec_id: ``vec_id, n_links`` (other vectors linked directly), ``component_id`` (smallest vec_id that
    links reach, itself included) and ``kept`` (vec_id = component_id). Every link returned is verified; a link at the
    threshold is found with a chance of 0.99, closer ones with a higher one. Identical vectors are one class, whose
    links count for each.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing, vectors of
    different widths do not link. Of rows that repeat a vec_id, the one with the smallest vector counts; rows without
    a vec_id are left out; an empty table gives no rows; other columns are ignored.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = saved(rows.select("vec_id", F.when(usable, F.transform("x", lambda v: v + F.lit(0.0))).alias("x")), "vectors")  # -0.0 is 0.0
    classes = saved(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    size, groups, window, least = plan(classes.count(), cosine)

    def project(batches):
        mix = np.random.default_rng(5).integers(1, 2**63, (groups, size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = np.random.default_rng(6).random(groups * size) * INTERVAL
        for batch in batches:
            lists = batch.column("x")
            width = np.diff(lists.offsets.to_numpy())
            for w in np.unique(width):
                own = pa.array(np.flatnonzero(width == w))
                part = batch.take(own)
                raw = part.column("x").flatten().to_numpy().reshape(-1, w).astype("<f8")
                vector = pa.array([v.tobytes() for v in raw], pa.binary())
                cell = np.floor((unit(vector) @ directions(w, groups * size, 1) + offset) / INTERVAL).astype(np.int64).view(np.uint64)
                key = (cell.reshape(-1, groups, size) * mix).sum(axis=2, dtype=np.uint64)
                key = ((key ^ np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * groups, pa.int32()), pa.array(key.ravel()))
                yield pa.record_batch([part.column("rep"), part.column("n"), vector, keys], ["rep", "n", "vector", "keys"])

    projected = saved(classes.mapInArrow(project, "rep long, n long, vector binary, keys array<int>"), "projected")
    cell = projected.select("rep", F.posexplode("keys").alias("g", "key"))
    crowded = saved(cell.groupBy("g", "key").count().where("count > 1").select("g", "key", F.ceil(F.col("count") / TILE).alias("parts")), "cells")
    placed = cell.join(crowded, ["g", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = tiles.select("rep", "g", "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).join(projected, "rep")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["g", "key", "a", "b", "rep"]
    ordered = tiles.repartition(partitions, "g", "key", "a", "b").sortWithinPartitions(*sort).select(*sort, "part", "n", "vector", "keys")

    def compare(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            ids = np.stack([table.column(c).to_numpy() for c in sort[:4]])
            fresh = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            cut = int(fresh[-1]) if len(fresh) else 0
            if cut:
                yield from links(table.slice(0, cut), np.append(0, fresh))
            carry = table.slice(cut)
        if carry is not None:
            yield from links(carry, np.array([0, carry.num_rows]))

    def links(table: pa.Table, bounds: np.ndarray):
        widths = np.array([v.as_buffer().size for v in table.column("vector").combine_chunks()])
        rep, n, g, part = (table.column(c).to_numpy() for c in ("rep", "n", "g", "part"))
        cross = table.column("a").to_numpy() != table.column("b").to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, groups)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        where = np.arange(len(rep))
        vectors_of, projection = {}, {}
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            u = unit(table.column("vector").combine_chunks().take(pa.array(own)))
            vectors_of[w], projection[w] = (own, u), u @ directions(w // 8, COUNTED, 2)
        partners = ends - where - 1
        steps = np.append(0, np.flatnonzero(np.diff(np.cumsum(partners) // PAIRS)) + 1)
        for first, last in zip(steps, np.append(steps[1:], len(rep))):
            left = np.repeat(where[first:last], partners[first:last])
            right = flat_ranges(where[first:last] + 1, partners[first:last])
            ok = (widths[left] == widths[right]) & (~cross[left] | (part[left] != part[right]))
            left, right = left[ok], right[ok]
            # a pair belongs to the first group in which it meets
            earliest = (keys[left] == keys[right]).argmax(axis=1)
            left, right = (side[earliest == g[left]] for side in (left, right))
            found = []
            for w, (own, u) in vectors_of.items():
                i, j = (np.searchsorted(own, side[widths[left] == w]) for side in (left, right))
                p = projection[w]
                collide = (np.abs(p[i] - p[j]) <= window).sum(axis=1) >= least
                i, j = i[collide], j[collide]
                near = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
                found.append((own[i[near]], own[j[near]]))
            left, right = (np.concatenate(side) for side in zip(*found))
            nodes, at = np.unique(np.concatenate([rep[left], rep[right]]), return_inverse=True)
            count = np.bincount(at, np.concatenate([n[right], n[left]]), len(nodes)).astype(np.int64)
            stars = star_edges(len(nodes), at[: len(left)], at[len(left) :])
            reach = np.arange(len(nodes))
            reach[stars[:, 0]] = stars[:, 1]
            yield pa.record_batch([pa.array(nodes.astype(np.int64)), pa.array(count), pa.array(nodes[reach].astype(np.int64))], ["rep", "links", "reach"])

    found = saved(ordered.mapInArrow(compare, "rep long, links long, reach long"), "links")
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("reach").alias("dst")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    total = classes.join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    total = total.select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(total, "x", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
