"""Token ids in files of fixed-width bits, with random access.

The file has blocks, then a footer, then a trailer of fixed size:

* a block holds ``BLOCK`` ids (the last one fewer, filled with zeros), each in as many bits
  as the vocabulary needs, packed into little-endian 64-bit words: id ``i`` starts at bit
  ``i * width`` of its block;
* the footer holds, for each document, a byte (0: the id is null), the id (int64), the start
  of its ids in the file (uint64), and for each block its byte offset (uint64);
* the trailer: numbers of documents, ids, blocks, footer offset (uint64), width, magic (uint32).

Documents are sorted by id (nulls first, repeated ids in the input's order) over all files
in turn. A task writes one file under a name of its own and returns that name, so a task that
runs again leaves another file and only the one of the attempt that counted is named; nothing
is moved. The folder may be any that pyarrow opens (local or shared file systems, HDFS, S3, GCS).
An id that the width cannot hold is an error.

A null text is empty and has its end id alone. An empty table writes no documents. Memory is
bounded by an Arrow batch when writing and by ``READ_IDS`` ids or one document when reading.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_folder, written
from .token_cache import encoder

BLOCK = 1 << 16
READ_IDS = 1 << 20
MAGIC = 0x314B4254
TRAILER = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8"), ("footer", "<u8"), ("width", "<u4"), ("magic", "<u4")])


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill ``width`` words exactly; each of the 64 places is shifted in for all words at once."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} does not fit in {width} bits")
    rows = -(-len(ids) // 64)
    table = np.zeros((rows, 64), np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, width), "<u8")
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= table[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= table[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(data: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    table = np.empty((len(words), 64), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        table[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            table[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return (table & np.uint64((1 << width) - 1)).astype("<u4").reshape(-1)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", folder))


class Writer:
    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.blocks: list[int] = []
        self.ids = 0
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, most: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, most, BLOCK):
            self.blocks.append(self.at)
            self._put(pack_bits(ids[k : min(k + BLOCK, most)], self.width))
        self.held, self.waiting = [ids[most:]], len(ids) - most

    def close(self) -> None:
        self._flush(self.waiting)
        footer = self.at
        self._put(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array(self.blocks, "<u8").tobytes())
        self._put(np.array([(len(self.docs), self.ids, len(self.blocks), footer, self.width, MAGIC)], TRAILER).tobytes())


class TokenFile:
    """Reads any range of a file's ids."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.trailer = t = np.frombuffer(file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if t["magic"] != MAGIC:
            raise ValueError("not a token file")
        n, at = int(t["docs"]), int(t["footer"])
        footer = file.read_at(size - TRAILER.itemsize - at, at)
        self.valid = np.frombuffer(footer, np.uint8, n)
        self.docs = np.frombuffer(footer, "<i8", n, n)
        self.starts = np.append(np.frombuffer(footer, "<u8", n, 9 * n), t["ids"]).astype(np.int64)
        self.blocks = np.append(np.frombuffer(footer, "<u8", int(t["blocks"]), 17 * n), t["footer"]).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        at = self.blocks[first]
        data = self.file.read_at(int(self.blocks[last + 1] - at), int(at))
        return unpack_bits(data, int(self.trailer["width"]))[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the document, its ids), many documents a read."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + READ_IDS, "right")) - 1)
            ids = self.read(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield k, ids[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), as wide as the tokenizer's vocabulary and
    ``end_id`` need. Returns a row per file: part, path, n_docs, n_ids; parts are in the order
    of the document ids."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    width = width_of(max(encoder(tokenizer).vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        name = f"{part:08d}-{uuid.uuid4().hex}.tok"
        with where.open_output_stream(f"{path}/{name}", compression=None) as stream:
            out = Writer(stream, width)
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for i, ids in coder.encode(batch.column(1)):
                    out.add(doc_ids[i], np.append(ids, np.uint32(end_id)))
            out.close()
        yield pa.record_batch([pa.array([x]) for x in (part, f"{folder}/{name}", len(out.docs), out.ids)], names=["part", "path", "n_docs", "n_ids"])

    # The place in the input splits a repeated id over several files.
    placed = docs.select(docs["doc_id"].cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    dealt = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return written(dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """The files' documents: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    tasks = files.agg(F.max("part")).first()[0]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.filter("n_docs > 0").select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, path, base in zip(*[c.to_pylist() for c in batch.columns]):
                folder, name = path.rsplit("/", 1)
                where, root = _open(folder)
                with where.open_input_file(f"{root}/{name}") as f:
                    t = TokenFile(f)
                    crcs = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in t.documents()), np.int64, len(t.docs))
                    yield pa.record_batch(
                        [pa.array(t.docs, mask=t.valid == 0), pa.array(t.starts[:-1] + base), pa.array(np.diff(t.starts)), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A task for each file: the rows are paths, too few for Spark to see the work behind them.
    return placed.repartitionById((tasks or 0) + 1, F.col("part").cast("int")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
