"""Token-ID / binary output (operator 9): best-fit-decreasing packing into id matrices.

Documents (ids plus an end id) longer than a row are split without loss into row-long pieces and a
rest. The pieces of a block are placed longest first, each in the open row whose free space fits it
most tightly. Open rows hang on the leaves of a segment tree over free capacity, and the tree finds
the smallest sufficient capacity in log(length) steps. Blocks are `BLOCK` ids long, tasks are input
splits, and nothing is shuffled.

A row of output is a row of the matrix: `input_ids` (length little-endian uint32, padded with
`pad_id`), `cu_seqlens` (cumulative segment lengths, from 0) and `position_ids` (restarting at 0 with
each segment, 0 in the padding).

Defined cases: null and empty texts are the end id alone; texts of any length are split without loss;
repeated rows are packed as often as they occur; an empty table gives no rows; the input's other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import materialize, tidy
from quarrymap.llm.words import blocks, load_words, taken

LENGTH = 2048
BLOCK = 4_000_000
ROWS = 100  # matrix rows a batch, so that writers hold little
ROW_GROUP = 16 << 20


class FreeSpace:
    """Open rows by free capacity; a segment tree of row counts over the capacities 0..length."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.width + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of least capacity of at least `size`."""
        count, node = self.count, self.width + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # climb to a right sibling with rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.width
        row = self.rows[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Item numbers of each row; ties in size go by item number."""
    free, rows = FreeSpace(length), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = free.take(size)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        capacity, row = found
        rows[row].append(item)
        if capacity > size:
            free.add(capacity - size, row)
    return rows


def binary_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive bytes of `data` as binary values of these sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def packed_rows(
    df: DataFrame, tokenizer: str, end_id: int, pad_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", pieces: bool = False
) -> DataFrame:
    """Matrix rows, or with `pieces` the rows of `piece_rows` over matrix rows written under the checkpoint folder."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for documents, stream, counts in blocks(load_words(tokenizer), it, end_id, BLOCK):
            per = -(-counts // length)
            doc = np.repeat(np.arange(len(counts)), per)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * length
            sizes = np.minimum(counts[doc] - starts, length)
            rows, keys = best_fit_decreasing(sizes, length), documents.take(pa.array(doc))
            for k in range(0, len(rows), ROWS):
                yield as_matrix(first + k, rows[k : k + ROWS], keys, starts, sizes, stream)
            first += len(rows)

    def as_matrix(first: int, rows: list[list[int]], keys: pa.Array, starts: np.ndarray, sizes: np.ndarray, stream: np.ndarray) -> pa.RecordBatch:
        order = np.array([i for r in rows for i in r])
        stream, size = taken(stream, sizes, order), sizes[order]
        inside = np.arange(len(stream), dtype=np.uint32) - np.repeat((np.cumsum(size) - size).astype(np.uint32), size)
        per = np.array([len(r) for r in rows])
        row = np.repeat(np.arange(len(rows)), per)
        before = np.cumsum(size) - size
        before -= before[np.repeat(np.cumsum(per) - per, per)]  # ids of the row before each segment
        at = np.repeat(row * length + before, size) + inside
        ids, positions = np.full((len(rows), length), pad_id, "<u4"), np.zeros((len(rows), length), "<u4")
        ids.reshape(-1)[at], positions.reshape(-1)[at] = stream, inside
        # Each row's cumulative lengths: 0 and the end of every segment.
        ends = np.insert((before + size).astype("<u4"), np.cumsum(per) - per, 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
        columns = [
            pa.array(np.arange(first, first + len(rows)), pa.int64()),
            binary_rows(ids, np.full(len(rows), 4 * length)),
            binary_rows(ends, 4 * (per + 1)),
            binary_rows(positions, np.full(len(rows), 4 * length)),
            pa.ListArray.from_arrays(offsets, keys.take(pa.array(order))),
            pa.ListArray.from_arrays(offsets, pa.array(starts[order], pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["row_id", "input_ids", "cu_seqlens", "position_ids", "keys", "starts"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"row_id long, input_ids binary, cu_seqlens binary, position_ids binary, keys array<{kind}>, starts array<long>"
    matrix = df.select(id_col, text_col).mapInArrow(tidy(run, ("words", tokenizer)), schema)
    return piece_rows(materialize(matrix, "token-rows", {"parquet.block.size": ROW_GROUP}), id_col) if pieces else matrix


def piece_rows(matrix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment of the matrix rows: which part of a document it holds, where it lies, and the digest of its ids."""

    def cum(k: Column) -> Column:
        """The k-th little-endian number of cu_seqlens."""
        at = [F.substring("cum", 8 * k + n, F.lit(2)) for n in (7, 5, 3, 1)]
        return F.conv(F.concat(*at), 16, 10).cast("int")

    def segment(k: Column) -> Column:
        start, size = cum(k), cum(k + 1) - cum(k)
        return F.struct(
            F.get("keys", k).alias(id_col),
            F.get("starts", k).alias("start"),
            size.cast("long").alias("length"),
            F.crc32(F.substring("input_ids", 4 * start + 1, 4 * size)).alias("ids_crc32"),
            F.col("row_id"),
            k.cast("long").alias("segment"),
            start.cast("long").alias("offset"),
        )

    segments = F.transform(F.sequence(F.lit(0), F.size("keys") - 1), segment)
    return matrix.withColumn("cum", F.hex("cu_seqlens")).select(F.inline(segments))


def write_packed(df: DataFrame, path: str, tokenizer: str, end_id: int, pad_id: int, **options) -> None:
    """Write the matrix rows as Parquet (`input_ids`, `cu_seqlens`, `position_ids`, `keys`, `starts`) to a shared path."""
    packed_rows(df, tokenizer, end_id, pad_id, **options).write.parquet(path)
