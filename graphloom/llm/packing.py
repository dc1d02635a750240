"""Operator 10: token-id output packed by best-fit decreasing.

Texts are encoded, cut losslessly into pieces of at most ``length`` ids, and packed into rows of
``length`` ids.  Full pieces fill a row alone; shorter ones are sorted by length and each goes
to the fullest open row it fits in.  Open rows are kept by free capacity, and a
segment tree over the capacities finds the least one that is large enough.

A task packs its rows in groups of about ``group_tokens`` ids, so memory is bounded and a
task that runs again makes the same rows.  No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import text_slices

LENGTH = 2048
PAD = 50256


class CapacityTree:
    """Segment tree over capacities 0..size-1 that counts open rows; ``least`` finds the smallest used capacity >= c."""

    def __init__(self, size: int):
        self.n = 1 << max(0, size - 1).bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, capacity: int) -> int:
        """-1 if no capacity is large enough."""
        count, i = self.count, capacity + self.n
        if count[i]:
            return capacity
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of piece numbers; each piece has 1..size ids."""
    tree, open_rows, rows = CapacityTree(size + 1), [[] for _ in range(size + 1)], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        free = tree.least(need)
        if free < 0:
            row, free = len(rows), size
            rows.append([])
        else:
            row = open_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(piece)
        if free > need:
            open_rows[free - need].append(row)
            tree.add(free - need, 1)
    return rows


SCHEMA = "pack_id long, n_tokens int, n_segments int, ids binary, position_ids binary, cu_seqlens array<int>, segments array<struct<doc_id:long,piece:int,length:int>>"
SEGMENT = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int32())])


def pack_rows(docs: list, flat: np.ndarray, offsets: np.ndarray, length: int, pad: int, dtype: str, first: int) -> pa.RecordBatch:
    """Pack one group of encoded documents."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][owner] + number * length
    size = np.minimum(length, offsets[1:][owner] - start)
    rows = best_fit_decreasing(size, length)
    order = np.array([p for r in rows for p in r], np.int64)
    per_row = np.array([len(r) for r in rows], np.int64)
    row_of = np.repeat(np.arange(len(rows)), per_row)
    n = size[order]
    ends = np.cumsum(n)
    row_end = ends[np.cumsum(per_row) - 1]
    row_start = np.concatenate([[0], row_end[:-1]])
    inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)  # position within its segment
    matrix, positions = np.full(len(rows) * length, pad, dtype), np.zeros(len(rows) * length, dtype)
    at = np.repeat(row_of * length + (ends - n) - row_start[row_of], n) + inside
    matrix[at] = flat[np.repeat(start[order], n) + inside]
    positions[at] = inside
    width = np.dtype(dtype).itemsize * length
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * width
    binary = lambda a: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(a)])
    cut = np.concatenate([[0], np.cumsum(per_row)])
    cu = np.zeros(len(order) + len(rows), np.int32)
    lead = cut[:-1] + np.arange(len(rows))
    body = np.ones(len(cu), bool)
    body[lead] = False
    cu[body] = ends - row_start[row_of]
    segments = pa.StructArray.from_arrays(
        [pa.array([docs[i] for i in owner[order]], pa.int64()), pa.array(number[order], pa.int32()), pa.array(n, pa.int32())], fields=list(SEGMENT)
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first + np.arange(len(rows)), pa.int64()), pa.array(row_end - row_start, pa.int32()), pa.array(per_row, pa.int32()), binary(matrix), binary(positions),
            pa.ListArray.from_arrays(pa.array(cut + np.arange(len(cut)), pa.int32()), pa.array(cu)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), segments),
        ],
        ["pack_id", "n_tokens", "n_segments", "ids", "position_ids", "cu_seqlens", "segments"],
    )


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, pad: int = PAD, group_tokens: int = 1_000_000) -> DataFrame:
    """Packed rows of all documents (columns doc_id, text).

    ids and position_ids are little-endian matrices of ``length`` numbers a row, 16 bits wide if the
    vocabulary and the length allow, else 32; positions restart at 0 in each segment; padding has
    position 0.  cu_seqlens holds the running segment ends from 0; segments tell each one's document, piece
    number and length.  A null or empty text has no segment; a null doc_id stays null; repeated rows are packed
    each time; an empty table gives no rows.  Other columns are ignored.
    """
    path = path or bpe.tokenizer_path()
    wide = max(bpe.load(path).size, length, pad + 1) > 1 << 16

    def run(batches):
        model, part = bpe.load(path), TaskContext.get().partitionId()
        made, held, ids = 0, 0, []
        flats, ends = [], [np.zeros(1, np.int64)]

        def flush():
            nonlocal made, held
            out = pack_rows(ids, np.concatenate(flats), np.concatenate(ends), length, pad, "<u4" if wide else "<u2", (part << 33) + made)
            made += out.num_rows
            held = 0
            ids.clear(), flats.clear()
            ends[:] = [np.zeros(1, np.int64)]
            for i in range(0, out.num_rows, 1000):
                yield out.slice(i, 1000)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                flat, offsets = model.encode_batch(texts)
                ids.extend(doc_ids[a:b])
                flats.append(flat)
                ends.append(offsets[1:] + held)
                held += len(flat)
                if held >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet files."""
    pack(docs, **options).write.parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
