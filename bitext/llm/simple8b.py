"""Token-id files in Simple-8b: 64-bit words of which a selector tells how many ids of which width they hold.

A file holds the ids of whole documents, in order, as one stream cut into blocks of ``BLOCK`` ids:

    magic  8 bytes  b"S8BIDS01"
    counts 5 x u64  documents, ids, blocks, words, escapes
    words     u64   the blocks' words, end to end
    offsets   u64   for each block, its first word; then the number of words
    escapes   u64   ids of 2**60 and more
    doc_id    i64   of each document
    known     u8    1 if the document has an id, 0 if that is null
    lengths   u64   ids of each document

All integers are little-endian. The top 4 bits of a word are the selector. Selector 0 is an escape: the other bits
number the id in the file's escapes. Places of a block's last word beyond the block's ids are zero.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import memo, tokenizer
from .common import saved, slices, utf8

MAGIC = b"S8BIDS01"
BLOCK = 4096
#: A task starts another file after so many ids, which bounds what a reader holds.
FILE_IDS = 4 << 20

#: Fixed values of the code: ids in a word and bits of each, by selector (0 is the escape).
SELECTORS = [(1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of unsigned 64-bit ids, the blocks' offsets in them, and the escapes. The selector of a word is the
    one that holds most of the ids that follow; all blocks choose their next word at the same time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    block_end = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    # The widest id among the next 1, 2, 3 ... ids of the block; places beyond its end are zeros and fit anywhere.
    bits_of = np.zeros((blocks, BLOCK + SELECTORS[1][0]), np.uint8)
    width = np.zeros(blocks * BLOCK, np.uint8)
    width[:n] = np.frexp(ids.astype(np.float64))[1]
    bits_of[:, :BLOCK] = width.reshape(blocks, BLOCK)
    widest, span = bits_of[:, :BLOCK].copy(), 1
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for k in range(len(SELECTORS) - 1, 0, -1):  # from few wide ids to many narrow ones, which override them
        count, bits = SELECTORS[k]
        while span < count:
            np.maximum(widest, bits_of[:, span : span + BLOCK], out=widest)
            span += 1
        selector[widest <= bits] = k
    selector = selector.reshape(-1)[:n]
    step = np.array([c for c, _ in SELECTORS])[selector]
    at, last = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    chosen = np.zeros(n, bool)
    while len(at):
        chosen[at] = True
        at = at + step[at]
        more = at < last
        at, last = at[more], last[more]
    starts = np.flatnonzero(chosen)
    offsets = np.searchsorted(starts, np.append(np.arange(blocks) * BLOCK, n))
    kinds, ends = selector[starts], block_end[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    escapes = ids[starts[kinds == 0]]
    words[kinds == 0] |= np.arange(len(escapes), dtype=np.uint64)
    for k, (count, bits) in list(enumerate(SELECTORS))[1:]:
        own = np.flatnonzero(kinds == k)
        for j in range(count if len(own) else 0):
            own = own[starts[own] + j < ends[own]]
            words[own] |= ids[starts[own] + j] << np.uint64(j * bits)
    return words, offsets.astype(np.uint64), escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again: words of one selector are unpacked together, to where the blocks' offsets place them."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    holds = np.array([c for c, _ in SELECTORS])[kinds]
    first = offsets[:-1].astype(np.int64)
    run = np.cumsum(holds) - holds
    block = np.repeat(np.arange(len(first)), np.diff(offsets.astype(np.int64)))
    start = run - run[first][block] + block * BLOCK if len(words) else run
    stop = np.minimum((block + 1) * BLOCK, n)
    ids = np.zeros(n, np.uint64)
    own = np.flatnonzero(kinds == 0)
    ids[start[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    for k, (count, bits) in list(enumerate(SELECTORS))[1:]:
        own = np.flatnonzero(kinds == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(own) else 0):
            own = own[start[own] + j < stop[own]]
            ids[start[own] + j] = (words[own] >> np.uint64(j * bits)) & mask
    return ids


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's content."""
    words, offsets, escapes = encode(ids)
    counts = np.array([len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes)], "<u8")
    parts = [counts, words.astype("<u8"), offsets.astype("<u8"), escapes.astype("<u8"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.array(lengths, "<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_bytes(content) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a file's content. Raises ValueError if that isn't such a file."""
    if bytes(content[:8]) != MAGIC:
        raise ValueError("not a file of Simple-8b ids")
    docs, n, blocks, words, escapes = (int(x) for x in np.frombuffer(content, "<u8", 5, 8))
    at, found = 48, []
    for count, kind in ((words, "<u8"), (blocks + 1, "<u8"), (escapes, "<u8"), (docs, "<i8"), (docs, "u1"), (docs, "<u8")):
        found.append(np.frombuffer(content, kind, count, at))
        at += found[-1].nbytes
    if at != len(content):
        raise ValueError("the file's length doesn't match its counts")
    ids = decode(found[0], found[1], found[2], n)
    return [d if k else None for d, k in zip(found[3].tolist(), found[4].tolist())], found[5].astype(np.int64), ids


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file whole: under another name first, so that a task that is lost or repeated leaves no torn file."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = posixpath.join(root, f"_{name}.{TaskContext.get().taskAttemptId()}")
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, posixpath.join(root, name))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids to Simple-8b files in ``folder`` (a URI that executors share).

    Files ``ids-<task>-<number>.s8b``, by name, hold the documents in ascending doc_id order. Returns one row per
    file: ``name, task, number, n_docs, n_ids``.

    Null and empty texts have the end id alone; a null doc_id comes first and stays null; rows with the same doc_id
    are ordered by their text's hash and kept each; other columns are ignored; an empty table gives no file.
    The rows are dealt out by ranges of (doc_id, hash, row), so neither one id nor one row that repeats very often
    ends up in one task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(n, "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]):
        bpe, words = tokenizer(tokenizer_path), memo(tokenizer_path)
        task, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[int] = []
        chunks: list[np.ndarray] = []

        def file():
            nonlocal number, doc_ids, lengths, chunks
            name, ids = f"ids-{task:07d}-{number:05d}.s8b", np.concatenate(chunks)
            put(folder, name, to_bytes(doc_ids, lengths, ids))
            row = pa.record_batch([pa.array([x]) for x in (name, task, number, len(doc_ids), len(ids))], ["name", "task", "number", "n_docs", "n_ids"])
            number, doc_ids, lengths, chunks = number + 1, [], [], []
            return row

        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(*utf8(part.column("text")), words)
                count = np.diff(bounds)
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    count = count + 1
                doc_ids += part.column("doc_id").to_pylist()
                lengths += count.tolist()
                chunks.append(ids.astype(np.uint32))
                if sum(map(len, chunks)) >= FILE_IDS:
                    yield file()
        if doc_ids:
            yield file()

    return saved(ordered.mapInArrow(write, "name string, task long, number long, n_docs long, n_ids long"), "token-files")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The documents in the files that :func:`write_token_files` wrote: ``doc_id, start`` (ids of all documents
    before it), ``n_tokens, ids`` (little-endian unsigned 32-bit). ``files`` is its result: a row per file, whose
    running sum places the files."""
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    order = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def read(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                doc_ids, lengths, ids = from_bytes(content.as_buffer())
                ends = np.cumsum(lengths)
                step = 2048  # documents at a time
                for k in range(0, len(doc_ids), step):
                    own = slice(k, k + step)
                    starts = (ends - lengths)[own]
                    body = ids[starts[0] : ends[own][-1]].astype("<u4").tobytes()
                    at = np.append(starts, ends[own][-1]) - starts[0]
                    yield pa.record_batch(
                        [pa.array([name.as_py()] * len(starts)), pa.array(doc_ids[own], pa.int64()), pa.array(starts), pa.array(lengths[own]), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(body)])],
                        ["name", "doc_id", "at", "n_tokens", "ids"],
                    )

    found = spark.read.format("binaryFile").load(f"{folder}/*.s8b").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = found.mapInArrow(read, "name string, doc_id long, at long, n_tokens long, ids binary")
    # One short row per file: the files hold FILE_IDS ids each, so this side stays small beside the documents.
    return rows.join(offsets, "name").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
