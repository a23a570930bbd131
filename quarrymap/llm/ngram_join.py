"""N-gram Jaccard join (operator 1): exact near-duplicate classes by parity sketches.

A text's set holds its distinct 5-word shingles (64-bit hashes). Two texts of a and b shingles link if
100 * intersection >= 80 * union, so their sets differ in at most D = (a + b) / 9 shingles.

1. Blocks. In a size band [2**k, 2**(k+1)) a wide bit sketch is cut into about 0.6 * 2**k blocks; each
   shingle flips one bit of one block, so a block is the XOR of its shingles' hashes, and the number of
   differing blocks is a lower bound of the symmetric difference, as is the Hamming distance. Texts near
   the upper end of a band are also sketched for the next band. Sets under 64 have a block per shingle.
2. Pigeonhole. A linked pair differs in at most D <= a / 4 blocks. Blocks are counted over all texts; one
   that only its own text has differs from every partner's, so a text with more than D of those has no
   partner. Of the others the rarest D + 1 (less the unshared ones) are kept, in an order that all texts
   share, and a linked pair has one of them in common.
3. Texts with equal kept blocks are candidates. A block first pairs every text with the block's least
   text (a star, linear in its size). Pairs are dropped if the Hamming distance of their dense parity
   sketches exceeds (a + b) / 9; the rest are verified on whole sets. Linked texts are joined to
   components; only blocks that still hold several components then give further pairs, between those
   components, until none is left untested.

Equal sets are one class, represented by its least id, before any pair is made. Blocks travel as packed
arrays (a row per batch and bucket), so hot blocks cost bytes, not rows, and pairs are made by shuffled
joins that adaptive execution can split.

Defined cases: null, empty and word-less texts have the empty set and link with nothing; a row with a
null id gets its set size and a null component; rows that repeat an id are separate texts of the same
component only if linked (both components may have that id as their least); equal sets always share a component; an empty table gives no rows; the input's
other columns are ignored. The chance that a text of 64 or more shingles has too few blocks for step 2
is below 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import fresh, held, materialize, slices, tidy

WORDS, SMALL, BUCKET_BITS, BUCKET_TEXTS = 5, 64, 10, 2000
LINK, UNION = 100, 80
ODD = np.uint64(0x9E3779B97F4A7C15)
PASS = 1 << 19  # bytes of text a pass
FLUSH = 1_500_000
TILE, TILE_BYTES = 2048, 16 << 20  # members of a bucket of a block, and bytes of their sketches, on average
# ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, modulo 2 ** 64."""
    kept = held("ngram", list)
    if not kept or len(kept[0]) < n:
        n = max(n, 2 * PASS)
        up, down = np.full(n, ODD, np.uint64), np.full(n, pow(int(ODD), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept[:] = [np.cumprod(up), np.cumprod(down)]
    return kept[0], kept[1]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and each text's count."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    space = SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * down[: len(data)])])
    word = mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    n_words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    full = len(word) - words + 1
    if full > 0:
        h = word[:full]
        for k in range(1, words):
            h = h * ODD + word[k : k + full]
        inside = text[:full] == text[words - 1 :]
        h, owner = mixed(h[inside]), text[:full][inside]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for t in np.flatnonzero((n_words > 0) & (n_words < words)):
        own = int(n_words[t])
        for w in word[first[t] : first[t] + words - 1][:own]:
            own = (own * int(ODD) + int(w)) & (1 << 64) - 1
        h, owner = np.append(h, mixed(np.array([own], np.uint64))), np.append(owner, t)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def blocks_of_band(band: int) -> int:
    """Number of blocks; 0: a block per shingle."""
    if band < 6:
        return 0
    return int({6: 0.8, 7: 0.7, 8: 0.65}.get(band, 0.6) * 2**band) + 1


def band_of(n: np.ndarray) -> np.ndarray:
    """Band of each set size (5 for all sizes under SMALL)."""
    return np.maximum(np.frexp(np.maximum(n, 1).astype(float))[1] - 1, 5)


def block_sketch(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of texts: signature, text number, view (1: for the next band up); and needs [texts, 2].

    need: how many of a view's blocks a linked partner shares at least (0 for a view not made).
    """
    band = band_of(counts)
    signatures, texts, views = [], [], []
    need = np.zeros((len(counts), 2), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for view in (0, 1):
        made = band + view
        takes = (counts > 0) & ((view == 0) | (counts * 10 >= 8 * 2.0**made))
        for b in np.unique(made[takes]):
            mine = takes & (made == b)
            at = mine[owner]
            x, t = h[at], owner[at]
            parts = blocks_of_band(int(b))
            salt = mixed(np.array([int(b) + 1], np.uint64))[0]
            if parts:
                part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                place = t.astype(np.uint64) * np.uint64(parts) + part
                order = np.argsort(place, kind="stable")
                place, x, t = place[order], x[order], t[order]
                begin = np.flatnonzero(np.diff(place, prepend=np.uint64((1 << 64) - 1)) != 0)
                x = mixed(np.bitwise_xor.reduceat(mixed(x ^ salt), begin) + (part[order][begin] + np.uint64(1)) * ODD) if len(begin) else x
                t = t[begin]
            else:
                x = mixed(x ^ salt)
            signatures.append(x)
            texts.append(t)
            views.append(np.full(len(x), view, np.uint8))
            full = np.bincount(t, minlength=len(counts))
            need[mine, view] = np.maximum(full - counts // 4, 1)[mine]
    if not signatures:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), need
    return np.concatenate(signatures), np.concatenate(texts), np.concatenate(views), need


def parity_sketch(h: np.ndarray, n: int) -> bytes:
    """Dense parity sketch of 2 ** (band + 1) bits."""
    bits = 2 << int(band_of(np.array([n]))[0])
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer folded onto the shorter: at most the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def links(n_a: int, n_b: int, common: int) -> bool:
    return LINK * common >= UNION * (n_a + n_b - common)


# -- passes over the texts -----------------------------------------------------------------------


def encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def set_stats(docs: DataFrame) -> DataFrame:
    """(id, tfp, n, fa, fb, need0, need1, sketch) of every row of `docs` (id, text, tfp)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = encoded(b.column(1))
            for s in slices([len(t) for t in texts], PASS):
                h, counts = shingle_sets(texts[s])
                need = block_sketch(h, counts)[3]
                ends = np.cumsum(counts)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (h, mixed(h ^ ODD))]
                fa, fb = ((x[ends] - x[ends - counts]).view(np.int64) for x in sums)
                sketches = [parity_sketch(h[e - n : e], n) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[s], b.column(2)[s], *(pa.array(x, pa.int64()) for x in (counts, fa, fb, need[:, 0], need[:, 1])), pa.array(sketches, pa.binary())], names=["id", "tfp", "n", "fa", "fb", "need0", "need1", "sketch"])

    return docs.select("id", "text", "tfp").mapInArrow(tidy(run, "ngram"), "id long, tfp long, n long, fa long, fb long, need0 long, need1 long, sketch binary")


def by_bucket(bucket: np.ndarray, names: list[str], columns: list[np.ndarray], **more: int) -> Iterator[pa.RecordBatch]:
    """A row of packed arrays per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    for k in range(0, len(cuts) - 1, 256):
        part = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[a]) for a, _ in part], pa.int32()), *(pa.array([v] * len(part), pa.int32()) for v in more.values()), *(pa.array([c[a:z].tobytes() for a, z in part], pa.binary()) for c in columns)],
            names=["bucket", *more, *names],
        )


def bucket_bits(texts: int) -> int:
    """Buckets are 2 ** bits: at least 2 ** BUCKET_BITS, and as many as keep one under the blocks of about BUCKET_TEXTS texts."""
    return max(BUCKET_BITS, (texts // BUCKET_TEXTS).bit_length())


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def packed_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, signature, id, view): packed blocks of `docs` (id, text), bucketed by signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            signature, ids, view = (np.concatenate(x) for x in zip(*held))
            yield from by_bucket(bucket_of(signature, bits), ["signature", "id", "view"], [signature, ids, view])

        for b in it:
            texts, ids = encoded(b.column(1)), b.column(0).to_numpy()
            for s in slices([len(t) for t in texts], PASS):
                signature, text, view, _ = block_sketch(*shingle_sets(texts[s]))
                held.append((signature, ids[s][text], view))
                size += len(signature)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("id", "text").mapInArrow(tidy(run, "ngram"), "bucket int, signature binary, id binary, view binary")


def unpacked(rows: list[tuple], kinds: list[type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, k) for x in column]) for column, k in zip(zip(*rows), kinds)]


def by_key(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of consecutive equal buckets."""
    bucket, rows = None, []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield bucket, rows


def dealt(df: DataFrame) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, "bucket").sortWithinPartitions("bucket")


def shared_blocks(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks of at least two texts, bucketed by id, with the number of texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, rows in by_key(it):
            signature, ids, view = unpacked(rows, [np.uint64, np.int64, np.uint8])
            order = np.argsort(signature, kind="stable")
            signature = signature[order]
            begin = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
            times = np.diff(np.append(begin, len(signature)))
            times = np.repeat(times, times)
            some = times > 1
            held.append((signature[some], ids[order][some], view[order][some], times[some].astype(np.int32)))
            size += int(some.sum())
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        signature, ids, view, times = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        signature, ids, view, times = (x[order] for x in (signature, ids, view, times))
        yield from by_bucket(bucket_of(mixed(ids.view(np.uint64)), bits), ["signature", "id", "view", "times"], [signature, ids, view, times], kind=1)

    return dealt(blocks).mapInArrow(tidy(run, "ngram"), "bucket int, kind int, signature binary, id binary, view binary, times binary")


def rare_blocks(shared: DataFrame, stats: DataFrame, bits: int) -> DataFrame:
    """(signature, id): the kept blocks of class representatives that may have a partner."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, *need = (b.column(k).to_numpy().astype(np.int64) for k in range(3))
            if len(ids):
                yield from by_bucket(bucket_of(mixed(ids.view(np.uint64)), bits), ["signature", "id", "view", "times"], [need[0], ids, need[1], need[1]], kind=0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(it):
            heads = [r[1:] for r in rows if r[0] == 0]
            tails = [r[1:] for r in rows if r[0] == 1]
            if not heads or not tails:
                continue
            need0, known, need1, _ = unpacked(heads, [np.int64] * 4)
            signature, ids, view, times = unpacked(tails, [np.uint64, np.int64, np.uint8, np.int32])
            turn = np.argsort(known, kind="stable")
            known, need = known[turn], np.stack([need0[turn], need1[turn]], 1)
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            mine = known[at] == ids
            signature, ids, view, times, at = (x[mine] for x in (signature, ids, view, times, at))
            order = np.lexsort((signature, times, view, ids))
            signature, ids, view, at = (x[order] for x in (signature, ids, view, at))
            if not len(ids):
                continue
            begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (view[1:] != view[:-1])]))
            count = np.diff(np.append(begin, len(ids)))
            keep = count - need[at[begin], view[begin]] + 1
            some = np.arange(len(ids)) - np.repeat(begin, count) < np.repeat(keep, count)
            found = np.flatnonzero(some)
            for k in range(0, len(found), 100_000):
                f = found[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(signature[f].view(np.int64), pa.int64()), pa.array(ids[f], pa.int64())], names=["signature", "id"])

    head = stats.select("id", "need0", "need1").mapInArrow(tidy(pack, "ngram"), "bucket int, kind int, signature binary, id binary, view binary, times binary")
    return dealt(shared.unionByName(head)).mapInArrow(tidy(run, "ngram"), "signature long, id long")


# -- pairs ---------------------------------------------------------------------------------------


def near_pairs(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sizes and parity sketches allow to link."""

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fits = [9 * sketch_distance(x, y) <= m + n for m, x, n, y in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield b.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = stats.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = stats.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").filter((F.col("na") * 10 >= F.col("nb") * 8) & (F.col("nb") * 10 >= F.col("na") * 8))
    return sized.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(tidy(near, "ngram"), "a long, b long")


def whole_sets(docs: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, h): sorted shingle hashes of the texts of some classes; `texts` has each class's row (id, doc, tfp)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = encoded(b.column(1))
            for s in slices([len(t) for t in texts], PASS):
                h, counts = shingle_sets(texts[s])
                ends = np.cumsum(counts).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array([h[e - n : e].tobytes() for e, n in zip(ends, counts.tolist())], pa.binary())], names=["id", "h"])

    rows = docs.join(texts.join(ids, "id", "left_semi"), ["doc", "tfp"])
    return rows.select("id", "text").mapInArrow(tidy(run, "ngram"), "id long, h binary").groupBy("id").agg(F.min("h").alias("h"))


def linked_pairs(pairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs verified on whole sets."""

    def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for x, y in zip(b.column(2), b.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                out.append(links(len(u), len(v), int((both[1:] == both[:-1]).sum())))
            yield b.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(whole_sets(docs, ids, texts), "sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "h": "ha"}), "a").join(sets.withColumnsRenamed({"id": "b", "h": "hb"}), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(tidy(linked, "ngram"), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), for ids that have an edge.

    Every round a node takes the least label among its neighbours', then its label's label.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("id"), F.col("l").alias("component"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "component": "l"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "l").alias("l"))
        jump = step.join(labels.select(F.col("id").alias("l"), F.col("component").alias("m")), "l").select("id", "component", F.least("l", "m").alias("next"))
        jump = materialize(jump, "labels")
        labels = jump.select("id", F.col("next").alias("component"))
        if jump.filter("next < component").isEmpty():
            return labels


def mixed_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (signature, id, n, sketch) of blocks with several components, with component c and the number of buckets the block is cut in."""
    labelled = members.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    whole = labelled.groupBy("signature").agg(F.count("*").alias("k"), F.sum(F.octet_length("sketch")).alias("bytes"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    buckets = F.ceil(F.greatest(F.col("k") / TILE, F.col("bytes") / TILE_BYTES)).cast("int").alias("buckets")
    return materialize(labelled.join(materialize(whole.select("signature", buckets), "mixed"), "signature"), "rest")


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to `size` bytes."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] * 8 > size:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def close_pairs(ids: np.ndarray, n: np.ndarray, component: np.ndarray, bucket: np.ndarray, sketches: list[bytes], within: bool) -> np.ndarray:
    """Pairs of different components (and buckets, unless `within`) whose sizes and sketches allow a link."""
    length = np.array([len(x) for x in sketches])
    groups = {size: np.flatnonzero(length == size) for size in np.unique(length).tolist()}
    found = []
    for small, rows in groups.items():
        for size, columns in groups.items():
            if size not in (small, 2 * small):
                continue
            x, y = folded([sketches[i] for i in rows], small), folded([sketches[i] for i in columns], small)
            step = max(1, (1 << 21) // max(1, len(columns) * x.shape[1]))
            for k in range(0, len(rows), step):
                i, j = rows[k : k + step, None], columns[None]
                distance = np.bitwise_count(x[k : k + step, None, :] ^ y[None]).sum(2, dtype=np.int64)
                fits = (9 * distance <= n[i] + n[j]) & (component[i] != component[j]) & ((ids[i] < ids[j]) | (size != small))
                fits &= (10 * n[i] >= 8 * n[j]) & (10 * n[j] >= 8 * n[i]) & (within | (bucket[i] != bucket[j]))
                u, v = np.nonzero(fits)
                found.append(np.stack([ids[rows[k + u]], ids[columns[v]]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def cross_pairs(rest: DataFrame) -> DataFrame:
    """Pairs of a block's members of different components that may link.

    A block's buckets hold about TILE members and TILE_BYTES bytes of sketches at most; each pair of buckets is a
    tile, whose sketches are compared as matrices, so a tile's memory is bounded and only close pairs are rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    yield from tile(rows)
                    key, rows = row[:3], []
                rows.append(row)
        yield from tile(rows)

    def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            _, p, q, bucket, ids, n, c, sketches = zip(*rows)
            pairs = close_pairs(*(np.array(x, np.int64) for x in (ids, n, c, bucket)), list(sketches), p[0] == q[0])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    rows = rest.withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.select("signature", F.least("bucket", "other").alias("p"), F.greatest("bucket", "other").alias("q"), "bucket", "id", "n", "c", "sketch")
    parts = max(1, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "signature", "p", "q").sortWithinPartitions("signature", "p", "q").mapInArrow(tidy(run, "ngram"), "a long, b long").distinct()


def classify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tfp, n, fa, fb, component, root) of every row; tfp is the hash of the row's text, root keys its component.

    Up to `root`, a class goes by its least row's id, or by a hash of that row if several classes have that id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tfp"))
    stats = materialize(set_stats(rows), "stats")
    docs = rows.filter(F.col("id").isNotNull()).withColumnRenamed("id", "doc")
    # Rows that share an id but not their text are kept apart by the set's fingerprint.
    classes = stats.filter("n > 0 AND id IS NOT NULL").groupBy("fa", "fb", "n").agg(F.min(F.struct("id", "tfp", "need0", "need1", "sketch")).alias("r"))
    classes = classes.select("fa", "fb", "n", "r.*").withColumnRenamed("id", "doc")
    alone = F.count("*").over(Window.partitionBy("doc")) == 1
    classes = materialize(classes.withColumn("id", F.when(alone, F.col("doc")).otherwise(F.xxhash64("doc", "fa", "fb", "n"))), "classes")
    texts = classes.select("id", "doc", "tfp")
    # Only representatives are sketched: copies would make a text's own blocks look common.
    chosen = docs.join(texts, ["doc", "tfp"])
    bits = bucket_bits(classes.count())
    kept = materialize(rare_blocks(shared_blocks(packed_blocks(chosen, bits), bits), classes, bits), "blocks")
    groups = materialize(kept.groupBy("signature").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("signature", "a"), "groups")
    grouped = materialize(kept.join(groups, "signature").select("signature", "a", F.col("id").alias("b")), "grouped")
    star = grouped.filter("a <> b").select("a", "b").distinct()
    edges = materialize(linked_pairs(materialize(near_pairs(star, classes), "star"), docs, texts), "links")
    found = components(edges)
    members = grouped.select("signature", F.col("b").alias("id")).join(classes.select("id", "n", "sketch"), "id")
    more = materialize(cross_pairs(mixed_blocks(members, found)), "more")
    if not more.isEmpty():
        found = components(edges.unionByName(linked_pairs(more, docs, texts)))
    least = found.join(texts, "id").groupBy("component").agg(F.min("doc").alias("first"))
    found = found.join(least, "component").select(F.col("id").alias("rep"), F.col("component").alias("root"), "first")
    member = stats.join(classes.select("fa", "fb", "n", "doc", F.col("id").alias("rep")), ["fa", "fb", "n"], "left").join(found, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first", "doc", "id"))
    return member.select("id", "tfp", "n", "fa", "fb", component.alias("component"), F.coalesce("root", "rep").alias("root"))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    return classify(df, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df`, all columns, less all but one row of each component: the least id's, of those the least text hash's.

    Rows with a null id or no word stay; of rows equal in id and text that are to stay, one does. Added
    columns have names that `df` doesn't have, so columns of any name pass through.
    """
    id_, tfp, first_, nth = fresh(df, "id", "tfp", "first", "nth")
    found = classify(df, id_col, text_col).filter("id = component AND n > 0")
    first = found.groupBy("root").agg(F.min(F.struct("id", "tfp")).alias("r")).select(F.col("r.id").alias(id_), F.col("r.tfp").alias(tfp), F.lit(True).alias(first_)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    free = F.col(id_col).isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    keyed = df.filter(~free).withColumns({id_: F.col(id_col).cast("long"), tfp: F.xxhash64(text)})
    chosen = keyed.join(first, [id_, tfp]).withColumn(nth, F.row_number().over(Window.partitionBy(id_, tfp).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    return df.filter(free).unionByName(chosen.select(*df.columns))
