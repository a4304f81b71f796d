"""Exact top-k search by distributed histogram selection.

Every round scores all candidates against all queries and adds up one histogram of scores per query; the bin that
holds a query's k-th best score becomes its next range, until the range is one integer. A last round keeps what beats
that value and, of the ties, the smallest ids. Tasks send what can still matter only: the k best places of a histogram,
the k best rows of the last round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch, spread

#: Scale of the integer components, and queries that are scored at a time.
SCALE, BLOCK = 1024, 4096
#: Bins of a round's histogram. Scores have 63 bits, so there are 8 rounds at most.
BINS = 256
#: Candidates scored at a time against a block of queries.
STEP = 512
#: Queries, and their components, that are sent to every task at a time (8 MB); a task's histograms take 32 MB.
SENT, SENT_CELLS = 16384, 1 << 20
#: Rows that a task of the last round holds before it keeps each query's k best of them only.
HELD = 1 << 20


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, q`` (floor(1024 * x) of each component). Rows without an id, null and empty vectors, vectors with a
    null or non-finite component, and those whose components could overflow a score take no part. Of rows that repeat
    an id, the one with the smallest vector counts."""
    x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * SCALE))
    # no sum of products of d such components reaches 2 ** 62
    top = F.sqrt(F.lit(2.0**61) / F.size(embedding))
    usable = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < top))
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & usable)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(column[0].as_py())
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of each query by integer inner product.

    ``vectors`` and ``queries`` come from :func:`quantised`. Candidates are all vectors of the query's width but those
    with the query's own id. Returns ``query_id, rank`` (from 1)``, vec_id, score``: all, if there are fewer than k;
    ties go to smaller ids; queries without candidates have no rows; empty tables give no rows.

    Queries are sent to all tasks in groups of fixed size, and every task scores its own candidates against a group: no
    candidate is shuffled, and no pair's score leaves a task unless it can be among the best.
    """
    spark = vectors.sparkSession
    vectors, queries = saved(spread(vectors), "vectors"), saved(queries, "queries")
    sizes = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("cells")).first()
    groups = max(1, -(-sizes.n // SENT), -(-sizes.cells // SENT_CELLS))
    bound = vectors.select(F.size("q").alias("width"), F.aggregate("q", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v))).alias("top")).groupBy("width").agg(F.max("top").alias("top"))
    state = saved(
        queries.join(F.broadcast(bound), F.size("q") == F.col("width"))
        .select(F.col("vec_id").alias("query_id"), (F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + F.abs(v)) * F.col("top")).alias("reach"))
        .select("query_id", (-F.col("reach")).alias("lo"), (F.col("reach") + 1).alias("hi"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("all")),
        "ranges",
    )

    def sent(ranges: DataFrame, group: int):
        """The group's queries with their ranges, in blocks of one width, for every task."""
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == group).join(ranges.select(F.col("query_id").alias("vec_id"), "lo", "hi", "need"), "vec_id")
        rows = own.select("vec_id", "q", "lo", "hi", "need").toArrow().combine_chunks()
        widths = pc.list_value_length(rows["q"]).to_numpy()
        blocks = []
        for width in np.unique(widths):
            same = rows.filter(pa.array(widths == width))
            for at in range(0, len(same), BLOCK):
                part = same.slice(at, BLOCK)
                blocks.append((_matrix(part["q"]), *(part[c].to_numpy() for c in ("vec_id", "lo", "hi", "need"))))
        return spark.sparkContext.broadcast(blocks)

    def scored(batch: pa.RecordBatch, blocks):
        """A batch's candidates against each block of queries of their width, a step at a time: the block's number, the
        candidates' ids, and the scores (queries by candidates)."""
        widths = pc.list_value_length(batch.column("q")).to_numpy()
        for width in np.unique(widths):
            own = batch.filter(pa.array(widths == width))
            cm, ids = _matrix(own.column("q")), own.column("vec_id").to_numpy()
            top = np.sqrt(np.square(cm.astype(np.float64)).sum(axis=1).max())
            for n, block in enumerate(blocks):
                if block[0].shape[1] == width:
                    # no sum of products is beyond the norms' product: floats hold it and are fast
                    reach = 1.01 * top * np.sqrt(np.square(block[0].astype(np.float64)).sum(axis=1).max())
                    kind = np.float32 if reach < 2.0**24 else np.float64 if reach < 2.0**53 else np.int64
                    left, right = block[0].astype(kind), cm.astype(kind)
                    for at in range(0, len(ids), STEP):
                        yield n, ids[at : at + STEP], left @ right[at : at + STEP].T

    def reaching(s: np.ndarray, least: np.ndarray, own: np.ndarray, ids: np.ndarray):
        """Query, candidate and score of the pairs with ``least`` of their query or more, but a query with itself."""
        # a bound beyond what the scores' type holds exactly is rounded down at most
        bound = least.astype(s.dtype)
        if s.dtype != np.int64:
            bound = np.where(bound > least, np.nextafter(bound, s.dtype.type(-np.inf)), bound)
        row, column = np.nonzero(s >= bound[:, None])
        score = s[row, column].astype(np.int64)
        keep = (own[row] != ids[column]) & (score >= least[row])
        return row[keep], column[keep], score[keep]

    def histogram(blocks):
        def count(batches):
            totals, floors, steps = {}, {}, {}
            for batch in batches:
                for n, ids, s in scored(batch, blocks.value):
                    _, own, lo, hi, need = blocks.value[n]
                    if n not in totals:
                        totals[n], floors[n], steps[n] = np.zeros((len(own), BINS), np.int64), lo, 0
                    width = np.maximum(1, -(-(hi - lo) // BINS))
                    row, _, score = reaching(s, floors[n], own, ids)
                    inside = score < hi[row]
                    row, score = row[inside], score[inside]
                    np.add.at(totals[n].reshape(-1), row * BINS + (score - lo[row]) // width[row], 1)
                    steps[n] += 1
                    if not steps[n] & (steps[n] - 1):  # scores in places below the first ones that hold enough cannot matter
                        enough = np.cumsum(totals[n][:, ::-1], axis=1)[:, ::-1] >= need[:, None]
                        floors[n] = lo + np.maximum(0, enough.sum(axis=1) - 1) * width
            for n, total in totals.items():
                # places from the top until the task alone has enough; lower ones cannot hold the k-th best
                above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
                row, place = np.nonzero((total > 0) & (above < blocks.value[n][4][:, None]))
                yield pa.record_batch([pa.array(blocks.value[n][1][row]), pa.array(place), pa.array(total[row, place])], ["query_id", "place", "n"])

        return count

    def each_group(ranges: DataFrame, rows, name: str, schema: str) -> DataFrame:
        """``rows`` of each group's queries, given what was sent of them, written to one table."""
        path = scratch(spark, name)
        for group in range(groups):
            blocks = sent(ranges, group)
            rows(blocks).write.mode("append").parquet(path)
            blocks.destroy()
        return spark.read.schema(schema).parquet(path)

    w = Window.partitionBy("query_id").orderBy(F.desc("place"))
    while not state.where("hi - lo > 1 and not all").isEmpty():
        open_ = state.where("hi - lo > 1 and not all")

        def places(blocks, open_=open_):
            counts = vectors.mapInArrow(histogram(blocks), "query_id long, place long, n long").groupBy("query_id", "place").agg(F.sum("n").alias("n"))
            # at most BINS rows a query
            reached = counts.withColumn("upto", F.sum("n").over(w)).join(open_.select("query_id", "need"), "query_id").where("upto >= need")
            return reached.groupBy("query_id").agg(F.max(F.struct("place", "upto", "n")).alias("b"))

        found = each_group(open_, places, "places", "query_id long, b struct<place:long,upto:long,n:long>")
        step = F.expr("greatest(1, (hi - lo + %d) div %d)" % (BINS - 1, BINS))
        new = open_.join(found, "query_id", "left").select(
            "query_id",
            F.when(F.col("b").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("b.place") * step).alias("lo"),
            F.when(F.col("b").isNull(), F.col("hi")).otherwise(F.least("hi", F.col("lo") + (F.col("b.place") + 1) * step)).alias("hi"),
            F.when(F.col("b").isNull(), F.col("need")).otherwise(F.col("need") - F.col("b.upto") + F.col("b.n")).alias("need"),
            F.col("b").isNull().alias("all"),  # fewer than k in all: every candidate is returned
        )
        state = saved(state.where("hi - lo <= 1 or all").unionByName(new), "ranges")

    def cut(kept: list) -> list:
        """The k best of each query in ``kept``."""
        query, ids, s = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((ids, -s, query))
        query, ids, s = query[order], ids[order], s[order]
        own = np.arange(len(query)) - np.searchsorted(query, query) < k
        return [(query[own], ids[own], s[own])]

    def best(blocks):
        def choose(batches):
            kept, n_kept, most = [], 0, HELD
            for batch in batches:
                for n, ids, s in scored(batch, blocks.value):
                    _, own, lo, _, _ = blocks.value[n]
                    row, column, score = reaching(s, lo, own, ids)
                    kept.append((own[row], ids[column], score))
                    n_kept += len(row)
                    if n_kept > most:
                        kept = cut(kept)
                        n_kept = len(kept[0][0])
                        most = n_kept + HELD
            if kept:
                yield pa.record_batch([pa.array(x) for x in cut(kept)[0]], ["query_id", "vec_id", "score"])

        return choose

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(blocks):
        rows = vectors.mapInArrow(best(blocks), "query_id long, vec_id long, score long")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return each_group(state, ranked, "best", "query_id long, rank int, vec_id long, score long")
