"""Best-fit packing of documents into token sequences.

A task packs the documents of its partition as they come. It keeps a fixed number of open
sequences; a bitset keyed by free space finds, in one shift, the one that a piece fills best.
When a sequence must be opened and all are in use, the fullest is closed. Only documents
longer than a sequence are cut, into full pieces and a last one.

A null text is empty and has its end id alone; repeated rows are packed one by one; an empty
table gives no pieces. Memory is bounded by one Arrow batch and the open sequences. A task
that runs again packs the same rows in the same order and gives the same numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .token_cache import encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Online best fit with at most ``most_open`` open bins."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free = 0  # bit f is set while an open bin has f places free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, room: int) -> int:
        held = self.bins[room]
        n = held.pop()
        if not held:
            self.free ^= 1 << room
        self.open -= 1
        return n

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item of 1 to ``capacity`` places."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            n = self._take(room)
        else:
            n, room = self.made, self.capacity
            self.made += 1
        left = room - length
        if left:
            if self.open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(n)
            self.free |= 1 << left
            self.open += 1
        return n, self.capacity - room


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 256, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text). with_ids: adds ``ids``, the piece's ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fit = encoder(tokenizer, words=True), BestFit(capacity, open_bins)
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[list] = [[] for _ in range(8)]
            for i, ids in coder.encode(batch.column(1)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity].tobytes()
                    n, offset = fit.add(len(part) // 4)
                    for column, x in zip(rows, (doc_ids[i], piece, start, len(part) // 4, zlib.crc32(part), task | n, offset, part)):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.binary()] * with_ids
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
