"""BPE encoding and decoding (operator 2).

Every pre-token is encoded by a segment tree over the ranks of its adjacent pairs. A leaf holds
`rank * width + position`, so the root yields the leftmost pair of the lowest rank. Merging changes
three leaves, each updated in log(width) steps, until no pair can merge. Short pre-tokens go through
many trees at once (one row of a numpy matrix is one tree); long ones through a single tree.

Pre-tokens repeat, so each Python worker keeps the ids of up to `CACHE` text segments between tasks.
Results don't depend on the cache.

Defined cases: null text counts as empty; empty text has no ids; special-token strings in a text
become their special ids, as the public library does by default; texts of any length are encoded whole;
repeated rows get equal rows; an empty table gives no rows; the input's other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarrymap.llm.common import held, texts_of, tidy

CACHE = 700_000
# White space of the tokenizer's \s, and the byte-level pre-token pattern.
WS = r"\t-\r \x85\xa0  -     　"
PRETOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
SEGMENT = rf"[{WS}]*[^{WS}]+|[{WS}]+"
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in set(keep)):
        table[chr(256 + n)] = b
    return table


class PairRanks:
    """Rank and merged id of id pairs, by binary search over sorted pair keys."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs = {int(k): r for r, k in enumerate(keys)}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair can't merge (or an id is negative)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)


class ByteBpe:
    """A byte-level BPE vocabulary file (the public `tokenizers` JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = PairRanks(vocab, merges)
        self.byte_ids = np.full(256, -1, np.int64)
        for ch, b in alphabet.items():
            self.byte_ids[b] = vocab[ch]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in piece)
        for piece, i in special.items():
            self.bytes_of[i] = piece.encode()
        self.pretoken, self.segment = regex.compile(PRETOKEN), regex.compile(SEGMENT)
        self.run = regex.compile(rf"[{WS}][{WS}]")
        self.cache: dict[str, bytes] = {}

    # -- merging -------------------------------------------------------------------------------
    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of pre-tokens of at most 64 bytes; one tree per row."""
        n, longest = len(words), max(map(len, words))
        width = 1 << max(1, (longest - 1).bit_length())
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        sym = np.full((n, width + 1), -1, np.int64)  # the last column is the "no symbol" sentinel
        sym[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[:, :width][after > lengths[:, None] - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.ranks.lookup(sym[:, :width], sym[np.arange(n)[:, None], after])
        position = np.arange(width)
        tree[:, width:] = np.where(rank < NONE, rank * width + position, NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, made = root % width, self.ranks.made[root // width]
            gone = after[live, at]
            nxt = after[live, gone]
            sym[live, at] = made
            sym[live, gone] = -1
            after[live, at] = nxt
            before[live, nxt] = at
            prev = before[live, at]
            new = self.ranks.lookup(made, sym[live, nxt])
            old = self.ranks.lookup(sym[live, prev], made)
            tree[live, width + gone] = NONE
            tree[live, width + at] = np.where(new < NONE, new * width + at, NONE)
            has = prev < width
            tree[live[has], width + prev[has]] = np.where(old[has] < NONE, old[has] * width + prev[has], NONE)
            for leaf in (gone, at, np.where(has, prev, at)):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node >>= 1
            live = live[tree[live, 1] < NONE]
        kept = sym[:, :width] >= 0
        flat = sym[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_one(self, word: bytes) -> bytes:
        """Ids of one pre-token of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        base, pairs, made, inf = self.ranks.base, self.ranks.pairs, self.ranks.made, 1 << 62
        sym: list[int] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [inf] * (2 * width)

        def leaf(i: int) -> int:
            j = after[i]
            rank = pairs.get(sym[i] * base + sym[j]) if j < n else None
            return inf if rank is None else rank * width + i

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    return
                tree[i] = value
                i >>= 1

        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < inf:
            rank, i = divmod(tree[1], width)
            j = after[i]
            sym[i], sym[j], after[i] = int(made[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, inf)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    # -- texts ---------------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        """Cut a text where a pre-token always ends: before each white-space run."""
        if "\0" in text or self.run.search(text):
            return self.segment.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, segments: set[str]) -> None:
        """Put the ids of these segments in the cache."""
        cut = {s: [t.encode() for t in self.pretoken.findall(s)] for s in segments}
        short: dict[int, dict[bytes, bytes]] = {16: {}, 64: {}}
        for tokens in cut.values():
            for t in tokens:
                if len(t) <= 64:
                    short[16 if len(t) <= 16 else 64][t] = b""
        for found in short.values():
            words = list(found)
            for k in range(0, len(words), 20_000):
                found.update(zip(words[k : k + 20_000], self.merge_many(words[k : k + 20_000])))
        for s, tokens in cut.items():
            self.cache[s] = b"".join(short[16][t] if len(t) <= 16 else short[64][t] if len(t) <= 64 else self.merge_one(t) for t in tokens)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cut = [self.segments(t) if t else [] for t in texts]
        self.learn({s for segs in cut for s in segs if s not in self.cache})
        get = self.cache.__getitem__
        return [b"".join(map(get, segs)) for segs in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        out: list[bytes] = []
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            if self.special_at is None or not any(s in t for t in part for s in self.special):
                out += self.encode_plain(part)
                continue
            for t in part:
                plain = self.encode_plain(self.special_at.split(t))
                marks = [self.special[s] for s in self.special_at.findall(t)] + [b""]
                out.append(b"".join(x for pair in zip(plain, marks) for x in pair))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian uint32 ids; bytes that aren't UTF-8 become U+FFFD."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, memoryview(ids).cast("I") if ids else [])).decode("utf-8", "replace")


def load_byte_bpe(path: str) -> ByteBpe:
    """The Python worker's encoder of this vocabulary."""
    return held(("bpe", path), lambda: ByteBpe(path))


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; see the module's defined cases."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_byte_bpe(tokenizer)
        for b in it:
            ids = bpe.encode(texts_of(b.column(1)))
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run, ("bpe", tokenizer)), f"{id_col} {kind}, ids array<int>")


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text string) of every row; null ids decode to the empty text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_byte_bpe(tokenizer)
        for b in it:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(tidy(run, ("bpe", tokenizer)), f"{id_col} {kind}, text string")


def round_trip_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; return counts and digests instead of the ids (no shuffle)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_byte_bpe(tokenizer)
        for b in it:
            ids = bpe.encode(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run, ("bpe", tokenizer)), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
