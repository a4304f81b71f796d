"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Single words are hashed whole and by their first 4, 5 and 6 characters: inflected and compound forms, of which each is
rare, share a stem."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_slices, first_values, saved, slices, utf8, words

#: Hashed features: 4 M, so the weights are 16 MB at most.
FEATURE_BITS = 22
#: Lengths of the stems.
STEMS = (4, 5, 6)
#: Labelled documents that the model is fitted to at most (chosen by their ids' hashes); documented bound.
TRAIN_ROWS = 16_000
#: Learning rate, its smoothing, L1, L2, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 5.0, 1.0, 2

#: A word is a run of ASCII letters and digits and of characters beyond ASCII.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each word, stem, word pair, and pair with one word skipped, of the lower-cased
    texts."""
    raw, at = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, bounds = words(raw, at, GAP[raw])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, distinct = distinct_slices(raw, starts, ends)
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w, 1) for w in distinct.to_pylist()], np.uint64)[codes]
    row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    rows, found = [row], [word * np.uint64(0x9E3779B97F4A7C15)]
    texts = [w.decode("utf-8", "replace") for w in distinct.to_pylist()]
    for size in STEMS:
        longer = np.array([len(t) > size for t in texts], bool)[codes]
        rows.append(row[longer])
        found.append(np.array([digest(t[:size], size) for t in texts], np.uint64)[codes[longer]] * np.uint64(0x9E3779B97F4A7C15))
    for skip, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        same = row[skip:] == row[:-skip]
        rows.append(row[skip:][same])
        found.append(((word[:-skip] * np.uint64(odd)) ^ (word[skip:] + np.uint64(skip)))[same] * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate of its own for each coordinate. The last coordinate (``1 << FEATURE_BITS``) is the bias,
    which has no L1. Its state is two arrays of 4 M floats, however many examples it sees."""

    def __init__(self, bits: int = FEATURE_BITS):
        self.z, self.g2 = np.zeros((1 << bits) + 1, np.float32), np.zeros((1 << bits) + 1, np.float32)
        self.bias = 1 << bits

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, g2 = self.z[i].astype(np.float64), self.g2[i].astype(np.float64)
        l1 = np.where(i == self.bias, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))

    def update(self, features: np.ndarray, label: int) -> None:
        i = np.append(features, self.bias)
        w, g2 = self.weights(i), self.g2[i].astype(np.float64)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[i] += g - (np.sqrt(g2 + g * g) - np.sqrt(g2)) / ALPHA * w
        self.g2[i] += g * g

    def non_zero(self):
        """The weights that are not 0 and their indices, block by block."""
        for k in range(0, self.bias + 1, 1 << 18):
            i = np.arange(k, min(k + (1 << 18), self.bias + 1))
            w = self.weights(i)
            yield i[w != 0], w[w != 0]


def choose(known: DataFrame, most: int, bits: int = 16) -> DataFrame:
    """Rows of ``known(doc_id, ..)`` (distinct ids): as many whole parts by the id's hash as make at most ``most``
    rows. If the first part alone has more, it is split by the hash's next bits, so that some row is always chosen."""
    rows = saved(known.withColumn("hash", F.xxhash64("doc_id")), "labels")
    for done in range(0, 64, bits):
        parts = rows.withColumn("part", F.shiftrightunsigned("hash", done).bitwiseAND(F.lit((1 << bits) - 1)))
        chosen = first_values(parts, "part", most)
        if not chosen.isEmpty():
            break
        first = parts.agg(F.min("part")).first()[0]
        if first is None:
            break
        rows = parts.where(F.col("part") == first).drop("part")
    return chosen


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Fit to at most ``TRAIN_ROWS`` of the labelled documents (``labels(doc_id, <label>)``).

    Null labels and ids are left out, a document with several labels counts as 1 if any is, one with several texts
    has its smallest. Executors make the features; one task fits the bounded sample, which it reads as a stream, so that
    its memory does not follow the texts' lengths. Without labels there is no
    weight, and every score is 0.5."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = choose(known, TRAIN_ROWS)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, found = features(part.column("text"))
                key = np.unique((rows << FEATURE_BITS) | found)
                bounds = np.searchsorted(key, np.arange(part.num_rows + 1) << FEATURE_BITS)
                own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((key & ((1 << FEATURE_BITS) - 1)).astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), part.column("y"), own], ["doc_id", "y", "f"])

    def fit(batches):
        model = Ftrl()
        for batch in batches:
            f, y = batch.column("f"), batch.column("y").to_numpy()
            flat, at = f.values.to_numpy(), f.offsets.to_numpy()
            for k in range(batch.num_rows):
                model.update(flat[at[k] : at[k + 1]], y[k])
        for i, w in model.non_zero():
            yield pa.record_batch([pa.array(i), pa.array(w)], ["i", "w"])

    # every pass over the sample has an order of its own; one task reads the passes as a stream
    made = saved(sample.mapInArrow(extract, "doc_id long, y int, f array<int>"), "examples")
    passes = made.withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(EPOCHS)])))
    stream = passes.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id").select("y", "f")
    fitted = stream.mapInArrow(fit, "i long, w double").toPandas()  # what L1 leaves
    return fitted["i"].to_numpy(np.int64), fitted["w"].to_numpy(np.float64)


def chances(texts: pa.Array, dense: np.ndarray) -> np.ndarray:
    """The chance of the label by the weights ``dense``, of each text."""
    rows, found = features(texts)
    hit = dense[found] != 0
    key = np.unique((rows[hit] << FEATURE_BITS) | found[hit])
    total = np.bincount(key >> FEATURE_BITS, dense[key & ((1 << FEATURE_BITS) - 1)], len(texts)) + dense[-1]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, score`` (0 to 1) of each row of ``docs(doc_id, text)``: the whole text is read, and each feature
    counts once. Null and empty texts have the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        dense = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array(chances(part.column("text"), dense))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    """Documents that labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` of documents that aren't held out. Repeated rows are scored each, also those
    with a null doc_id (which are never held out, and have no label); an empty table gives no rows; other columns are
    ignored."""
    return predict(docs, learn(docs, labels))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic, each row judged by its own text: rows with a null or
    repeated doc_id, null and empty texts too. All stay if no model could be learnt; an empty table stays empty."""
    model = learn(docs, labels)
    if not len(model[0]):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        dense = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(chances(part.column("text"), dense) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
