"""Packing documents into fixed windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows are cut off first; what is left of it
goes whole into the open window that it fills best. If it fits nowhere, the fullest window is emitted and a new one
opened. What is open when a partition ends is merged: the leftovers of a bounded number of partitions meet in one
group, which fills windows to the brim, so a group ends with one partly filled window at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import memo, tokenizer
from .common import saved, slices, utf8

#: Leftovers of so many partitions are merged in one group (at most this times ``open_windows`` windows of ids).
MERGED_PARTITIONS = 32
#: Sequence ids: the partition (or group of leftovers) above, the sequence's number in it below.
SEQUENCE_BITS = 32

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_())])
COLUMNS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


class Windows:
    """The open windows of one task: (doc_id, start, ids, doc_tokens) pieces by window."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, piece: tuple, size: int) -> Iterator[tuple[int, list[tuple]]]:
        """Place a piece; yields the windows that this completes."""
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):  # fits in none
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                yield fullest, self.pieces.pop(fullest)
                at = len(self.free)
            self.free.append((self.window, self.opened))
            self.free.sort()
            self.pieces[self.opened] = []
            self.opened += 1
            at = bisect_left(self.free, (size, -1))
        room, own = self.free.pop(at)
        self.pieces[own].append(piece)
        if room == size:
            yield own, self.pieces.pop(own)
        else:
            insort(self.free, (room - size, own))


def _rows(windows: list[tuple[int, list[tuple]]], task: int, leftover: bool) -> pa.RecordBatch:
    out = []
    for number, pieces in windows:
        at = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, (task << SEQUENCE_BITS) + number, at, leftover))
            at += len(ids) // 4
    columns = list(zip(*out)) if out else [()] * len(PIECES)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, open_windows: int = 64) -> DataFrame:
    """Pack the ids of ``docs(doc_id, text)``, each followed by ``end_id``, into windows of ``window`` ids.

    Returns one row per piece: ``doc_id, start`` (ids of its document before it), ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (ids of its document, the end id included), ``sequence_id, offset`` (place in its
    sequence, gapless from 0). Every id lies in exactly one piece.

    Null and empty texts are documents of the end id alone; a null doc_id stays null; repeated rows are packed each
    by themselves; other columns are ignored; an empty table gives no rows. A very long text becomes full windows and
    one remainder, and only one slice of a batch is held as ids at a time.
    """

    def online(batches):
        bpe, words = tokenizer(tokenizer_path), memo(tokenizer_path)
        task, windows = TaskContext.get().partitionId(), Windows(window, open_windows)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(*utf8(part.column("text")), words)
                body = memoryview(ids.astype("<u4").tobytes())
                end = np.array([end_id], "<u4").tobytes()
                done = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = bytes(body[4 * a : 4 * b]) + end
                    total = b - a + 1
                    for start in range(0, total, window):
                        piece = own[4 * start : 4 * (start + window)]
                        if len(piece) == 4 * window:
                            done.append((windows.opened, [(doc, start, piece, total)]))
                            windows.opened += 1
                        else:
                            done += windows.add((doc, start, piece, total), len(piece) // 4)
                yield _rows(done, task, False)
        yield _rows(sorted(windows.pieces.items()), task, True)

    first = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(online, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean"), "packed")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))))
        done, now, used = [], [], 0
        for doc, start, ids, total in pieces:
            while ids:
                head = ids[: 4 * (window - used)]
                now.append((doc, start, head, total))
                used += len(head) // 4
                start += len(head) // 4
                ids = ids[len(head) :]
                if used == window:
                    done.append(now)
                    now, used = [], 0
        batch = _rows(list(enumerate(done + [now] * bool(now))), key[0].as_py(), False)
        return pa.Table.from_batches([batch]).select(COLUMNS)

    # Groups of leftovers take negative numbers, so that their sequences have ids of their own.
    group = (-1 - F.floor(F.shiftright("sequence_id", SEQUENCE_BITS) / MERGED_PARTITIONS)).cast("long")
    leftovers = first.where("leftover").select(*COLUMNS, group.alias("task"))
    merged = leftovers.groupBy("task").applyInArrow(merge, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return first.where("not leftover").select(COLUMNS).unionAll(merged)
