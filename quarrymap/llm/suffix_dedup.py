"""Suffix-array dedup (operator 8): repeated byte strings of at least `LENGTH` bytes, by interval expansion.

1. Every window of LENGTH bytes is owned by its minimiser: the SEED-byte string in it of least hash
   (leftmost if tied). Equal windows have equal minimisers, so windows can only repeat among runs
   (consecutive windows of one owner) whose minimisers are equal. A run is a row: minimiser hash, run
   fingerprint, place.
2. Runs of minimisers that occur once are dropped. Equal runs are merged into one context with a count,
   so a group of thousands of copies is one short string. Runs of a minimiser with more than `HOT`
   different contexts (a passage in very many texts) are cut into pieces of `PIECE` windows, keyed by
   the 185 bytes that a piece's windows share, so no passage shorter than that gathers a group. Pieces of
   a key that still has more than `HOT` contexts are cut into their windows, which are counted by their
   whole 200 bytes: equal ones merge, so nothing is left to gather.
3. Contexts of equal key go to one block. A block's suffixes are sorted, and breadth-first backward
   extension on its Burrows-Wheeler transform derives the common prefixes of neighbours by increasing
   value: an interval of suffixes that begin with w, extended by c, is the interval of cw, and its right
   border, if still unset, gets the length of w. At LENGTH the expansion stops; borders still unset join
   the suffixes that share LENGTH bytes. Such a group repeats if its contexts' counts reach two.
4. Repeated windows are joined back to all places of their contexts, per document.

Joins that may meet a hot key are plain shuffled joins, which adaptive execution splits. A block holds
whole keys up to `BLOCK` bytes and the key that crosses it, at most `HOT` contexts of under 400 bytes.

Defined cases: null text is empty; texts shorter than LENGTH bytes lose nothing; rows equal in id and
text are repeats of each other; the input's other columns pass through `remove_repeats` untouched; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import Batches, fresh, held, materialize, slices, tidy

LENGTH, SEED = 200, 48
HOT, PIECE = 1000, 16
BUFFER, BLOCK, PASS = 1 << 19, 1 << 17, 4 << 20
MASK = np.uint64((1 << 24) - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for every byte; ODD ** i and its inverse, modulo 2 ** 64, for at least n powers."""
    kept = held("suffix", lambda: [np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)])
    if len(kept) == 1 or len(kept[1]) < n:
        n = max(n, 2 * BUFFER)
        up, down = np.full(n, ODD, np.uint64), np.full(n, pow(int(ODD), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept[1:] = [np.cumprod(up), np.cumprod(down)]
    return kept[0], kept[1], kept[2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from every position (SEED = 32 + 16)."""
    h, kept = tables(1)[0][data], {}
    for step in (1, 2, 4, 8, 16):
        h = mixed(h[:-step] * ODD + h[step:]) if step >= 4 else h[:-step] * ODD + h[step:]
        kept[2 * step] = h
    n = len(data) - SEED + 1
    return mixed(kept[32][:n] * ODD + kept[16][32 : 32 + n])


class Fingerprints:
    """64-bit fingerprints of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        value, self.up, down = tables(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value[data] * down[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.up[start]
        return mixed(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owners(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of the minimiser of the window from every position (len(data) - LENGTH + 1 of them)."""
    least = (hashes & ~MASK) | np.arange(len(hashes), dtype=np.uint64) & MASK
    span, width = LENGTH - SEED + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(data) - LENGTH + 1
    low = np.minimum(least[:n], least[span - width : span - width + n]) & MASK
    at = np.arange(n, dtype=np.int64)
    return at + ((low.astype(np.int64) - at) & int(MASK))


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of all texts: text number, first window, windows, minimiser hash, fingerprint."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH or not (sizes >= LENGTH).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    begin = np.cumsum(sizes) - sizes
    hashes = seed_hashes(data)
    own = owners(data, hashes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(own)]
    valid = np.arange(len(own)) + LENGTH <= (begin + sizes)[text]
    new = np.empty(len(own), bool)
    new[0] = True
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(own))
    end = stop[np.searchsorted(stop, first, side="right")]
    fp = Fingerprints(data).of(first, end - 1 + LENGTH)
    return text[first], first - begin[text[first]], end - first, hashes[own[first]].view(np.int64), fp.view(np.int64)


# -- a block's suffixes --------------------------------------------------------------------------


def suffix_order(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted suffixes, rank of each, common prefix of sorted neighbours where under 7, else 7).

    Separators differ from one another and come before all bytes; prefix doubling resolves what seven
    symbols don't tell apart.
    """
    n = len(data)
    symbol = np.where(separator, 0, data.astype(np.uint64) + np.uint64(1))
    stop = np.append(np.flatnonzero(separator), n)
    reach = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)  # symbols before the separator
    padded = np.concatenate([symbol, np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(reach > k, padded[k : k + n], np.uint64(0))
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    differ = key[a] ^ key[b]
    high = np.frexp(differ.astype(np.float64))[1] - 1  # may round up at a symbol's edge only upwards by one bit
    high -= (differ >> high.clip(0).astype(np.uint64)) == 0
    lead = np.where(differ == 0, 7, (62 - high) // 9)
    common = np.zeros(n, np.int64)
    common[1:] = np.minimum(lead, np.minimum(reach[a], reach[b]))
    start = np.ones(n, bool)
    start[1:] = (common[1:] < 7)
    group = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    rank = np.empty(n, np.int64)
    rank[order] = first[group]
    h = 7
    open_ = np.flatnonzero(np.diff(np.append(first, n))[group] > 1)  # places in `order` still tied
    while len(open_):
        at = order[open_]
        lead = rank[at]
        sub = (lead.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n - 1)].astype(np.uint64)
        turn = np.argsort(sub)
        at, sub, lead = at[turn], sub[turn], lead[turn]
        order[open_] = at
        begins = np.ones(len(at), bool)
        begins[1:] = sub[1:] != sub[:-1]
        first = np.flatnonzero(begins)
        number = np.cumsum(begins) - 1
        rank[at] = open_[first[number]]
        open_ = open_[np.diff(np.append(first, len(at)))[number] > 1]
        h *= 2
    return order, rank, common


def expand(order: np.ndarray, rank: np.ndarray, common: np.ndarray, data: np.ndarray, separator: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it, -1 where it is `length` or more.

    Breadth-first backward extension: the intervals of the strings w of one length whose right border
    was just set are extended by every symbol that precedes their suffixes; `longer` maps a sorted
    suffix to the one that is one symbol longer.
    """
    n = len(order)
    border = np.where(common < 7, common, -1)
    border[0] = 0
    before = np.maximum(order - 1, 0)
    can = (order > 0) & ~separator[before]
    longer, symbol = rank[before], data[before].astype(np.int64)
    known = np.flatnonzero(border >= 0)
    right = np.flatnonzero(border == 6)
    left = known[np.searchsorted(known, right) - 1]
    for size in range(7, length):
        if not len(right):
            break
        width = right - left
        interval = np.repeat(np.arange(len(right)), width)
        at = np.arange(len(interval)) - np.repeat(np.cumsum(width) - width, width) + left[interval]
        some = can[at]
        at, interval = at[some], interval[some]
        if not len(at):
            break
        part = interval * 256 + symbol[at]
        turn = np.argsort(part)
        part, to = part[turn], longer[at[turn]]
        begins = np.ones(len(part), bool)
        begins[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(begins)
        new_left, new_right = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        inside = new_right < n
        new_left, new_right = new_left[inside], new_right[inside]
        unset = border[new_right] < 0
        left, right = new_left[unset], new_right[unset]
        border[right] = size
    return border


def repeated_windows(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (context, first window, end) of windows that occur at least twice among counted contexts."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    separator = np.zeros(len(data), bool)
    separator[begin + sizes] = True
    order, rank, common = suffix_order(data, separator)
    border = expand(order, rank, common, data, separator, length)
    context = np.repeat(np.arange(len(contexts)), sizes + 1)[order]
    valid = order - begin[context] + length <= sizes[context]
    group = np.cumsum(border >= 0) - 1
    weight = np.bincount(group, np.where(valid, counts[context], 0))
    flag = np.zeros(len(data) + 1, np.int8)
    flag[order] = valid & (weight[group] >= 2)
    edge = np.diff(flag, prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, start, side="right") - 1
    return owner, start - begin[owner], end - begin[owner]


# -- the job -------------------------------------------------------------------------------------


def find_runs(docs: DataFrame) -> DataFrame:
    """(id, tfp, seed, fp, lo, n) of every run of `docs` (id, tfp, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            for part in slices([len(t) for t in texts], BUFFER):
                text, lo, n, seed, fp = runs_of(texts[part])
                for k in range(0, len(text), 50_000):
                    s = slice(k, k + 50_000)
                    place = pa.array(text[s] + part.start, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array(seed[s], pa.int64()), pa.array(fp[s], pa.int64()), pa.array(lo[s], pa.int32()), pa.array(n[s], pa.int32())], names=["id", "tfp", "seed", "fp", "lo", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tfp", "text").mapInArrow(tidy(run, "suffix"), f"id {kind}, tfp long, seed long, fp long, lo int, n int")


def cut_contexts(docs_with_runs: DataFrame) -> DataFrame:
    """(id, tfp, hot, key, fp, lo, times, bytes) from (id, tfp, text, runs): contexts, and pieces of hot runs.

    Of rows equal in id and tfp that follow one another, as a join leaves them, the first is cut.
    """

    def pieces(data: np.ndarray, prints: Fingerprints, own: np.ndarray, lo: int, n: int, seed: int) -> Iterator[tuple]:
        at = int(own[lo])
        first, last = at - lo, at - (lo + n - 1)  # distance of the owner from the first and last window
        for j in range(last // PIECE, first // PIECE + 1):
            a, z = max(lo, at - (j + 1) * PIECE + 1), min(lo + n - 1, at - j * PIECE)
            if a > z:
                continue
            shared = prints.of(np.array([at - j * PIECE, a]), np.array([at - j * PIECE + LENGTH - PIECE + 1, z + LENGTH]))
            key = mixed(shared[:1] + np.uint64(j) * ODD + np.uint64(seed & (1 << 64) - 1))[0]
            yield int(key.view(np.int64)), int(shared[1].view(np.int64)), a, z - a + 1, data[a : z + LENGTH].tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in it:
            out: list[tuple] = []
            size = 0
            for row, (own_id, tfp, text, runs) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if (own_id, tfp) == before:
                    continue
                before = own_id, tfp
                raw = (text or "").encode()
                hot = None
                for r in runs:
                    if not r["hot"]:
                        out.append((row, False, r["seed"], r["fp"], r["lo"], r["times"], raw[r["lo"] : r["lo"] + r["n"] - 1 + LENGTH]))
                        size += len(out[-1][-1])
                        continue
                    if hot is None:
                        data = np.frombuffer(raw, np.uint8)
                        hot = data, Fingerprints(data), owners(data, seed_hashes(data))
                    for key, fp, lo, _, held in pieces(*hot, r["lo"], r["n"], r["seed"]):
                        out.append((row, True, key, fp, lo, r["times"], held))
                        size += len(held)
                if size > 4 << 20 or len(out) > 20_000:
                    yield made(b, out)
                    out, size = [], 0
            if out:
                yield made(b, out)

    def made(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        row, hot, key, fp, lo, times, held = zip(*out)
        place = pa.array(row, pa.int64())
        columns = [pa.array(hot, pa.bool_()), pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(lo, pa.int32()), pa.array(times, pa.int64()), pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), *columns], names=["id", "tfp", "hot", "key", "fp", "lo", "times", "bytes"])

    kind = docs_with_runs.schema["id"].dataType.simpleString()
    return docs_with_runs.select("id", "tfp", "text", "runs").mapInArrow(tidy(run, "suffix"), f"id {kind}, tfp long, hot boolean, key long, fp long, lo int, times long, bytes binary")


def search_blocks(contexts: DataFrame) -> DataFrame:
    """(key, fp, a, z): repeated window ranges of contexts (key, fp, bytes, times), grouped by key; equal ones count once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held, counts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, fps, held, counts, size
            owner, a, z = repeated_windows(held, np.array(counts))
            out = pa.RecordBatch.from_arrays([pa.array(np.array(keys)[owner], pa.int64()), pa.array(np.array(fps)[owner], pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["key", "fp", "a", "z"])
            keys, fps, held, counts, size = [], [], [], [], 0
            return out

        for b in it:
            for key, fp, raw, count in zip(*(c.to_pylist() for c in b.columns)):
                if keys and (key, fp) == (keys[-1], fps[-1]):
                    continue  # of a row equal in id and text; the first has the count of all
                if size >= BLOCK and key != keys[-1]:
                    yield flush()
                keys.append(key)
                fps.append(fp)
                held.append(raw)
                counts.append(count)
                size += len(raw) + 1
        if keys:
            yield flush()

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.select("key", "fp", "bytes", "times").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(tidy(run, "suffix"), "key long, fp long, a int, z int")


def counted_windows(pieces: DataFrame) -> DataFrame:
    """(key, fp, a, z): repeated windows of pieces (key, fp, bytes, times), each counted by its whole bytes."""

    def run(it: Batches) -> Batches:
        for b in it:
            for s in slices(pc.binary_length(b.column(2)).to_pylist(), BUFFER):
                part = b.slice(s.start, s.stop - s.start)
                raw = part.column(2).to_pylist()
                sizes = np.array([len(x) for x in raw], np.int64)
                n = sizes - LENGTH + 1
                row = np.repeat(np.arange(len(raw)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = at + (np.cumsum(sizes) - sizes)[row]
                window = Fingerprints(np.frombuffer(b"".join(raw), np.uint8)).of(start, start + LENGTH).view(np.int64)
                place = pa.array(row)
                columns = [part.column(0).take(place), part.column(1).take(place), pa.array(at, pa.int32()), pa.array(window, pa.int64()), part.column(3).take(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "a", "window", "times"])

    rows = pieces.select("key", "fp", "bytes", "times").mapInArrow(tidy(run, "suffix"), "key long, fp long, a int, window long, times long")
    twice = rows.groupBy("window").agg(F.sum("times").alias("all")).filter(F.col("all") > 1).select("window")
    return rows.join(twice, "window").select("key", "fp", "a", (F.col("a") + 1).alias("z"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tfp, spans array<struct<a, z>>): byte ranges of repeated strings, of `docs` (id, tfp, text).

    Rows equal in id and tfp are counted as often as they occur and get one row.
    """
    runs = materialize(find_runs(docs), "runs")
    shared = runs.groupBy("seed").agg(F.count("*").alias("times")).filter("times > 1").select("seed")
    # Written first, so that the join has exchanges of its own, which adaptive execution can split.
    hits = materialize(runs.join(materialize(shared, "shared"), "seed"), "hits")
    stand = hits.groupBy("seed", "fp").agg(F.count("*").alias("times"), F.min(F.struct("id", "tfp", "lo", "n")).alias("at"))
    stand = materialize(stand.select("seed", "fp", "times", "at.*"), "contexts")
    hot = materialize(stand.groupBy("seed").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > HOT).select("seed"), "hot")
    columns = ["id", "tfp", "seed", "fp", "lo", "n", "times", "hot"]
    wanted = stand.join(hot, "seed", "left_anti").withColumn("hot", F.lit(False)).select(*columns)
    # Rows equal in id and text make one entry; two stands for any greater number of them.
    once = materialize(hits.join(hot, "seed", "left_semi"), "hot-hits").groupBy("id", "tfp", "seed", "fp", "lo", "n").agg(F.least(F.count("*"), F.lit(2)).alias("times"))
    wanted = wanted.unionByName(once.withColumn("hot", F.lit(True)).select(*columns))
    by_text = wanted.groupBy("id", "tfp").agg(F.collect_list(F.struct("seed", "fp", "lo", "n", "times", "hot")).alias("runs"))
    by_text = by_text.withColumnsRenamed({"id": "id_", "tfp": "tfp_"})
    same = docs["id"].eqNullSafe(by_text["id_"]) & (docs["tfp"] == by_text["tfp_"])
    cut = materialize(cut_contexts(docs.join(by_text, same)), "cut")
    merged = materialize(cut.filter("hot").groupBy("key", "fp").agg(F.max("bytes").alias("bytes"), F.sum("times").alias("times")), "pieces")
    full = materialize(merged.groupBy("key").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > HOT).select("key"), "full")
    blocks = cut.filter("NOT hot").select("key", "fp", "bytes", "times").unionByName(merged.join(full, "key", "left_anti").select("key", "fp", "bytes", "times"))
    found = materialize(search_blocks(blocks).unionByName(counted_windows(merged.join(full, "key", "left_semi"))), "windows")
    places = hits.select("id", "tfp", F.col("seed").alias("key"), "fp", "lo").unionByName(cut.filter("hot").select("id", "tfp", "key", "fp", "lo"))
    spans = places.join(found, ["key", "fp"]).select("id", "tfp", F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("z") - 1 + LENGTH).alias("z")).alias("span"))
    return spans.groupBy("id", "tfp").agg(F.collect_set("span").alias("spans"))


def merged_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, joined byte ranges."""
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))


def with_spans(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`df` and a column (its name is returned) of the repeated byte ranges of its texts (null where there are none)."""
    tfp, id_, tfp2, found = fresh(df, "tfp", "id", "tfp2", "spans")
    keyed = df.withColumn(tfp, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    docs = keyed.select(F.col(id_col).alias("id"), F.col(tfp).alias("tfp"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(docs.filter(F.octet_length("text") >= LENGTH)).select(F.col("id").alias(id_), F.col("tfp").alias(tfp2), F.col("spans").alias(found))
    return keyed.join(spans, keyed[id_col].eqNullSafe(spans[id_]) & (keyed[tfp] == spans[tfp2]), "left").drop(id_, tfp, tfp2), found


def span_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, cut = (text or "").encode(), merged_spans(spans or [])
                rows.append((len(raw), sum(z - a for a, z in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            n, removed, count, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    marked, spans = with_spans(df.select(id_col, text_col), id_col, text_col)
    return marked.select(id_col, text_col, spans).mapInArrow(tidy(run, "suffix"), f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`df` with repeated strings cut from its texts; a character that loses some of its bytes goes.

    `length_col`, if present, becomes the cut text's new length. Null texts stay null; columns of any name
    pass through.
    """
    marked, spans = with_spans(df, id_col, text_col)
    names, at = df.columns, df.columns.index(text_col)
    counted = names.index(length_col) if length_col in names else None

    def run(it: Batches) -> Batches:
        for whole in it:
            for s in slices(pc.binary_length(whole.column(at)).fill_null(0).to_pylist(), PASS):
                b = whole.slice(s.start, s.stop - s.start)
                texts, columns = b.column(at).to_pylist(), b.columns[:-1]
                cut = [(t, False) if t is None or not f else (kept_bytes(t.encode(), merged_spans(f)).decode("utf-8", "ignore"), True) for t, f in zip(texts, b.column(len(columns)).to_pylist())]
                columns[at] = pa.array([t for t, _ in cut], pa.string())
                if counted is not None:
                    old = columns[counted]
                    columns[counted] = pa.array([len(t) if new else n for (t, new), n in zip(cut, old.to_pylist())], old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.select(*df.columns, spans).mapInArrow(tidy(run, "suffix"), df.schema)
