"""Packing (operator 10): order-preserving dynamic programming over window cuts.

The documents of a task are one stream of ids. Cuts may lie at document ends (no penalty), sentence
ends (a small one) and, inside sentences longer than `HARD` ids, every `HARD` ids (a large one). With
c the stream position of a candidate cut, the least cost of ending a window there is

    f(j) = penalty(j) + length - c(j) + min { f(i) + c(i) : c(j) - length <= c(i) < c(j) }

whose sliding minimum a monotone queue keeps, so the whole costs one pass. The last window of a block
is cut into powers of two, which need no padding. Blocks are `BLOCK` ids long (memory is bounded for
any partition), tasks are input splits, and nothing is shuffled.

Defined cases: null and empty texts are the end id alone; documents of any length are cut without
loss; repeated rows are packed as often as they occur; an empty table gives no rows; the input's other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarrymap.llm.common import tidy
from quarrymap.llm.words import blocks, load_words

LENGTH = 2048
HARD = 256
BLOCK = 4_000_000
SENTENCE_PENALTY, HARD_PENALTY = 4, 64


def candidates(ends: np.ndarray, documents: np.ndarray, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts and their penalties.

    ends: whether each id ends a sentence; documents: stream positions after each document.
    """
    at = np.union1d(np.flatnonzero(ends) + 1, documents)
    penalty = np.where(np.isin(at, documents), 0, SENTENCE_PENALTY)
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > hard)
    if len(wide):
        more = np.concatenate([np.arange(at[k] - gaps[k] + hard, at[k], hard) for k in wide])
        at, penalty = np.concatenate([at, more]), np.concatenate([penalty, np.full(len(more), HARD_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Window ends of least total padding plus penalty; `at` rises, by at most `length` a step."""
    c, pen = [0, *at.tolist()], [0, *penalty.tolist()]
    n = len(c)
    back, value = [0] * n, [0] * n  # value: f(i) + c(i)
    queue, head = [0], 0
    for j in range(1, n):
        x = c[j]
        while c[queue[head]] < x - length:
            head += 1
        i = queue[head]
        back[j] = i
        v = value[j] = value[i] + pen[j] + length
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(c[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int) -> list[int]:
    """Ends that cut [start, end) into powers of two."""
    cuts = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        cuts.append(start)
    return cuts


def pack_block(keys: pa.Array, stream: np.ndarray, sizes: np.ndarray, ends: np.ndarray, length: int, first: int) -> tuple[dict, int]:
    """Pieces of one block of documents, and the number of sequences; `first` is its first sequence id."""
    after = np.cumsum(sizes)
    at, penalty = candidates(ends[stream], after, min(HARD, length))
    cuts = best_cuts(at, penalty, length)
    begin = cuts[-2] if len(cuts) > 1 else 0
    cuts = np.array(cuts[:-1] + tail_cuts(begin, int(after[-1])))
    bounds = np.union1d(cuts, after)  # every piece ends at a cut or a document's end
    starts = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(after, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    opened = np.concatenate([[0], cuts])[sequence]
    raw = memoryview(stream).cast("B")
    return {
        "key": keys.take(pa.array(doc)),
        "start": starts - (after - sizes)[doc],
        "length": bounds - starts,
        "crc": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), bounds.tolist())],
        "tokens": sizes[doc],
        "sequence": first + sequence,
        "offset": starts - opened,
        "ids": lambda: [stream[a:b].astype(np.int32) for a, b in zip(starts.tolist(), bounds.tolist())],
    }, len(cuts)


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_words(tokenizer)
        ends = words.ends.copy()
        ends[end_id] = False
        first = TaskContext.get().partitionId() << 33
        for keys, stream, sizes in blocks(words, it, end_id, BLOCK):
            made, n = pack_block(keys, stream, sizes, ends, length, first)
            first += n
            columns = [made["key"], *(pa.array(made[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "sequence", "offset"))]
            if with_ids:
                columns.append(pa.array(made["ids"](), pa.list_(pa.int32())))
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            for k in range(0, whole.num_rows, 20_000):
                yield whole.slice(k, 20_000)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return df.select(id_col, text_col).mapInArrow(tidy(run, ("words", tokenizer)), schema)
