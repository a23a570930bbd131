"""Token ids of whole texts by the public `tokenizers` library, with a per-worker cache of words.

The vocabularies that drop white space encode each white-space-free chunk on its own, so the ids of
a text are the ids of its chunks in a row. A pass cuts many texts into chunks and works on each
different chunk once; Arrow and numpy do what is done for every chunk of a text. A chunk of letters
and ASCII punctuation behind them is the ids of its letters, in lower case if the vocabulary folds
case, and those of its punctuation. Texts that hold a special-token string go through the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarrymap.llm.common import held, slices

CACHE, PASS = 900_000, 4 << 20
LONGEST = 64
LINE = 1000
# ASCII punctuation, and characters that end a sentence.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE_END = (".", "!", "?", "…", "。", "！", "？")


def strings(column: pa.Array) -> list[str]:
    """Strings without spaces, as Python strings."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), " ")[0].as_py().split(" ")


def taken(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs `at` of `pool` in a row; `sizes` are the lengths of all its runs."""
    size = sizes[at]
    after = np.cumsum(size)
    return pool[np.repeat((np.cumsum(sizes) - sizes)[at] - (after - size), size) + np.arange(after[-1] if len(at) else 0)]


class WordIds:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.many = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.folds = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        n = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or [])])
        self.last, self.ends = np.zeros(n, bool), np.zeros(n, bool)  # ids that end a pre-token, and those that end a sentence
        for piece, i in vocab.items():
            self.last[i] = bool(suffix) and piece.endswith(suffix)
            self.ends[i] = piece.removesuffix(suffix).endswith(SENTENCE_END) and piece.endswith(suffix)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.many(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Put the ids of these strings in the cache.

        Words of letters alone are one pre-token, so many are encoded as one line and cut where pre-tokens end.
        """
        letters, others = [], []
        for w in new:
            (letters if w.isalpha() else others).append(w)
        for k in range(0, len(letters), LINE):
            line = letters[k : k + LINE]
            ids = np.array(self.many([" ".join(line)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(stops) != len(line):  # lower-casing or composing made other pre-tokens
                others += line
                continue
            raw = ids.tobytes()
            stops = stops.tolist()
            self.cache.update(zip(line, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        for k in range(0, len(others), 5000):
            self.cache.update(zip(others[k : k + 5000], self.whole(others[k : k + 5000])))

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of different strings. Half the cache is what was met since the other half was full."""
        if len(self.cache) > CACHE // 2:
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        old = self.older.get
        new = []
        for i in missing:
            x = old(words[i])
            if x is None:
                new.append(words[i])
            else:
                self.cache[words[i]] = x
        self.learn(new)
        for i in missing:
            found[i] = self.cache[words[i]]
        for w in new:
            if len(w) > LONGEST:
                del self.cache[w]
        return found

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks in a row, and how many each has."""
        letters = pc.ascii_rtrim(chunks, PUNCTUATION)
        if self.folds:
            letters = pc.ascii_lower(letters)
        apart = pc.utf8_is_alpha(letters)
        keys = pc.if_else(apart, letters, chunks).dictionary_encode()
        tail = pc.subtract(pc.binary_length(chunks), pc.binary_length(letters)).to_numpy()
        marked = np.flatnonzero(apart.to_numpy(zero_copy_only=False) & (tail > 0))
        found = self.look_up(strings(keys.dictionary))
        # Letters that lower-casing or composing turns into a letter and a mark are two pre-tokens; punctuation joins the mark.
        stops = np.concatenate([[0], np.cumsum(self.last[np.frombuffer(b"".join(found), "<u4")])])
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)
        at = keys.indices.to_numpy()
        joined = np.diff(stops[ends], prepend=0)[at[marked]] != 1
        more = [w if j else w[-n:] for w, n, j in zip(strings(chunks.take(pa.array(marked))), tail[marked].tolist(), joined.tolist())]
        place = {t: k for k, t in enumerate(dict.fromkeys(more))}
        none, found = len(found), [*found, b"", *self.look_up(list(place))]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        parts = np.full((len(chunks), 2), none)  # of each chunk: where its letters (or all) and its punctuation are found
        parts[:, 0] = at
        parts[marked[joined], 0] = none
        parts[marked, 1] = none + 1 + np.fromiter(map(place.__getitem__, more), np.int64, len(more))
        return taken(np.frombuffer(b"".join(found), "<u4"), sizes, parts.reshape(-1)), sizes[parts].sum(1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        out = []
        for ids, counts in self.encode_column(pa.array(texts, pa.string())):
            raw, ends = ids.tobytes(), np.cumsum(4 * counts).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts in a row and how many each has (null: none); about PASS bytes of text at a time."""
        for s in slices(pc.add(pc.fill_null(pc.binary_length(texts), 0), 1).to_pylist(), PASS):
            yield self.encode_pass(texts.slice(s.start, s.stop - s.start))

    def encode_pass(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.if_else(pa.array(~odd), texts, ""))
        chunks = cut.flatten().dictionary_encode()
        pool, sizes = self.chunk_ids(chunks.dictionary)
        at = chunks.indices.to_numpy()
        ids, after = taken(pool, sizes, at), np.concatenate([[0], np.cumsum(sizes[at])])
        offsets = cut.offsets.to_numpy()
        counts = np.diff(after[offsets - offsets[0]])
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.frombuffer(self.whole([texts[i].as_py()])[0], "<u4")
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts


def load_words(path: str) -> WordIds:
    """The Python worker's encoder of this vocabulary."""
    return held(("words", path), lambda: WordIds(path))


def blocks(words: WordIds, it: Iterator[pa.RecordBatch], end_id: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids in a row and sizes of documents, `end_id` after each; a block ends with the document that brings it to `limit` ids."""
    keys, parts, sizes, held_ids = [], [], [], 0
    for b in it:
        done = 0
        for ids, counts in words.encode_column(b.column(1)):
            after = np.cumsum(counts)
            ids, counts, after = np.insert(ids, after, end_id), counts + 1, after + np.arange(1, len(counts) + 1)
            row = begin = 0
            while row < len(counts):
                stop = min(len(counts), 1 + int(np.searchsorted(after, begin + limit - held_ids)))
                end = int(after[stop - 1])
                keys.append(b.column(0).slice(done + row, stop - row))
                parts.append(ids[begin:end])
                sizes.append(counts[row:stop])
                held_ids += end - begin
                row, begin = stop, end
                if held_ids >= limit:
                    yield pa.concat_arrays(keys), np.concatenate(parts), np.concatenate(sizes)
                    keys, parts, sizes, held_ids = [], [], [], 0
            done += len(counts)
    if keys:
        yield pa.concat_arrays(keys), np.concatenate(parts), np.concatenate(sizes)
