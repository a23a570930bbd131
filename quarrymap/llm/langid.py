"""Language ID (operator 3): multilingual mixture inference.

A language is a smoothed distribution over the character 1- to 3-grams of lower-cased words, hashed to
`BINS` cells. A document is a mixture: each of its words was drawn from one of the languages, with the
likelihood of the word's n-grams. Expectation-maximisation estimates the document's proportions; the
language set is the one of least penalised likelihood, -2 log L + |set| log(words), among the nested
sets that drop the least language of the last fit. The prediction is the largest proportion. Of more than
2 * `MEET` languages, a document's are first found in slices: the `MEET` languages of largest proportion so far are
mixed with the next `MEET`, and so on to the last; the sets are then those of the `MEET` that are left.

Training reads whole texts of a bounded sample: the `SAMPLE` labelled rows of smallest id hash. So there are `SAMPLE`
languages at most, and the table holds the cells that the sample's texts of a language have, not all `BINS`.

Defined cases: a text that is null, empty or without letters is `und` with score 0; so is every text
when no labelled row exists; ties go to the alphabetically first language; repeated rows get equal
rows; texts of any length are used whole, about `PASS` characters of documents (or one longer text) at a
time; any number of languages is taken; an empty table gives no rows; the input's other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import held, slices, texts_of, tidy

BINS = 1 << 16
MEET = 8  # languages of a slice
SAMPLE = 6000
CACHE, PASS = 600_000, 1 << 20
ROUNDS = 8
GRAM = 3


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the 1- to 3-grams of `<word>` over letters, and the word number of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("".join(f"<{w}>" for w in words)).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    cells, owners = [], []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAM + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(1_000_003) + codes[n - 1 :]
        inside = owner[:m] == owner[n - 1 :]
        mixed = (key[inside] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        cells.append((mixed >> np.uint64(48)).astype(np.int64) % BINS)
        owners.append(owner[:m][inside])
    return np.concatenate(cells), np.concatenate(owners)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


class GramTable:
    """Log n-gram probabilities of languages: cells that a language has, and one value for all that it lacks."""

    def __init__(self, cells: list[np.ndarray], counts: list[np.ndarray]):
        totals = np.array([c.sum() for c in counts]) + 0.1 * BINS
        self.cells = cells
        self.seen = [np.log((n + 0.1) / t).astype(np.float32) for n, t in zip(counts, totals)]
        self.unseen = np.log(0.1 / totals).astype(np.float32)

    def dense(self, first: int, last: int) -> np.ndarray:
        """[BINS, last - first]: the table of some languages."""
        out = np.tile(self.unseen[first:last], (BINS, 1))
        for k in range(first, last):
            out[self.cells[k], k - first] = self.seen[k]
        return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], GramTable]:
    """Languages (sorted) and the table of their n-grams."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    edge = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return [], GramTable([], [])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in it:
            for lang, text in zip(b.column(1).to_pylist(), texts_of(b.column(0))):
                words = [w for w in map(letters_of, text.lower().split()) if w]
                if words:
                    if lang not in held and len(held) == 4 * MEET:
                        yield from flush(held)
                        held.clear()
                    held.setdefault(lang, np.zeros(BINS, np.int64))
                    held[lang] += np.bincount(word_grams(words)[0], minlength=BINS)
        yield from flush(held)

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())], names=["lang", "cell", "n"])

    counted = rows.filter(F.col("h") <= edge).select("text", "lang").mapInArrow(tidy(count), "lang string, cell int, n long")
    packed = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("grams"))  # BINS at most
    found = packed.select("lang", F.col("grams.cell").alias("cells"), F.col("grams.n").alias("counts")).toArrow().sort_by("lang")
    pick = lambda name: [x.values.to_numpy() for x in found.column(name)]
    return found.column("lang").to_pylist(), GramTable(pick("cells"), pick("counts"))


class Scorer:
    """Log likelihoods of words, kept for words seen before in this worker; table: [BINS, languages]."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE + 1, table.shape[1]), np.float32)
        self.used = 1  # row 0: words without letters

    def words(self, words: list[str]) -> np.ndarray:
        """Row number of each word; 0 for words without letters."""
        new = list({w for w in words if w not in self.at})
        if self.used + len(new) > len(self.rows):
            self.at.clear()
            self.used, new = 1, list(set(words))
            if len(new) >= len(self.rows):
                self.rows = np.resize(self.rows, (len(new) + 1, self.rows.shape[1]))
        spelled = [letters_of(w) for w in new]
        real = [i for i, s in enumerate(spelled) if s]
        for k in range(0, len(real), 20_000):
            part = real[k : k + 20_000]
            cells, owners = word_grams([spelled[i] for i in part])
            for lang in range(self.rows.shape[1]):
                self.rows[self.used + k : self.used + k + len(part), lang] = np.bincount(owners, self.table[cells, lang], len(part))
        self.at.update((new[i], self.used + k) for k, i in enumerate(real))
        self.at.update((w, 0) for w, s in zip(new, spelled) if not s)
        self.used += len(real)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def mixtures(loglik: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions [documents, languages] and log likelihoods.

    loglik: [words, languages]; starts: first word of each document (none empty); allowed: language sets.
    """
    counts = np.diff(np.append(starts, len(loglik)))
    owner = np.repeat(np.arange(len(starts)), counts)
    top = loglik.max(1, keepdims=True)
    like = np.exp(loglik - top)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * pi[owner]
        total = np.maximum(joint.sum(1, keepdims=True), 1e-30)
        pi = (np.add.reduceat(joint / total, starts, axis=0) / counts[:, None]).astype(np.float32)
    mass = np.maximum((like * pi[owner]).sum(1), 1e-30)
    return pi, np.add.reduceat(np.log(mass) + top[:, 0], starts)


def choose(loglik: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of the language set of least penalised likelihood, per document."""
    n, k = len(starts), loglik.shape[1]
    counts = np.diff(np.append(starts, len(loglik)))
    allowed = np.ones((n, k), np.float32)
    best, like = mixtures(loglik, starts, allowed)
    cost = -2 * like + k * np.log(counts + 1)
    single = np.add.reduceat(loglik, starts, axis=0)
    last = best
    for size in range(k - 1, 0, -1):
        # Drop the language of least proportion; the single language left is the likeliest one.
        if size == 1:
            allowed = (np.arange(k) == single.argmax(1)[:, None]).astype(np.float32)
            now, like = allowed, single.max(1)
        else:
            least = np.where(allowed > 0, last, np.inf).argmin(1)
            allowed = allowed.copy()
            allowed[np.arange(n), least] = 0
            now, like = mixtures(loglik, starts, allowed)
        better = -2 * like + size * np.log(counts + 1) < cost
        cost = np.where(better, -2 * like + size * np.log(counts + 1), cost)
        best = np.where(better[:, None], now, best)
        last = now
    return best


def sliced(table: GramTable, words: list[str], languages: int) -> Iterator[np.ndarray]:
    """Log likelihoods [words, MEET] of words (of letters only) in one slice of the languages after another."""
    at: dict[str, int] = {}
    place = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
    cells, owners = word_grams(list(at))
    for first in range(0, languages, MEET):
        part = table.dense(first, min(first + MEET, languages))
        yield np.stack([np.bincount(owners, part[cells, k], len(at)) for k in range(part.shape[1])], 1).astype(np.float32)[place]


def leading(parts: Iterator[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The languages [documents, MEET] that lead after all slices of them, and their log likelihoods [words, MEET].

    Every slice is mixed with the leaders so far; those of largest proportion lead on, ties go to the first.
    """
    best = chosen = owner = None
    first = 0
    for part in parts:
        own = np.broadcast_to(np.arange(first, first + part.shape[1]), (len(starts), part.shape[1]))
        first += part.shape[1]
        if best is None:
            best, chosen, owner = part, own, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(part))))
            continue
        best, chosen = np.concatenate([best, part], 1), np.concatenate([chosen, own], 1)
        share, _ = mixtures(best, starts, np.ones(chosen.shape, np.float32))
        keep = np.sort(np.argsort(-share, 1, kind="stable")[:, :MEET], 1)
        best, chosen = np.take_along_axis(best, keep[owner], 1), np.take_along_axis(chosen, keep, 1)
    return chosen, best


def identify(df: DataFrame, model: tuple[list[str], GramTable], keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept columns, lang_pred, score, proportions) of every row; nothing is shuffled."""
    languages, table = model
    keep = keep or []
    shared, token = df.sparkSession.sparkContext.broadcast((languages, table)), uuid.uuid4().hex  # the cells of the sample's texts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shared.value
        few = len(languages) <= 2 * MEET
        for whole in it:
            texts = texts_of(whole.column(1))
            for s in slices([len(t) + len(languages) + 1 for t in texts], PASS):
                b = whole.slice(s.start, s.stop - s.start)
                cut = [t.lower().split() for t in texts[s]]
                share = np.zeros((b.num_rows, len(languages)), np.float32)
                if not few:
                    cut = [[w for w in map(letters_of, c) if w] for c in cut]
                counts = np.array([len(c) for c in cut], np.int64)
                owner = np.repeat(np.arange(b.num_rows), counts)
                words = [w for c in cut for w in c]
                if languages and words and few:
                    scorer = held(("langid", token), lambda: Scorer(table.dense(0, len(languages))))
                    at = scorer.words(words)
                    owner = owner[at > 0]
                    if len(owner):
                        docs, starts = np.unique(owner, return_index=True)
                        share[docs] = choose(scorer.rows[at[at > 0]], starts)
                elif languages and words:
                    docs, starts = np.unique(owner, return_index=True)
                    chosen, loglik = leading(sliced(table, words, len(languages)), starts)
                    share[docs[:, None], chosen] = choose(loglik, starts)
                best = share.argmax(1) if languages else np.zeros(b.num_rows, np.int64)
                score = share.max(1) if languages else np.zeros(b.num_rows)
                named = [languages[i] if s > 0 else "und" for i, s in zip(best.tolist(), score.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *b.columns[2:], pa.array(named, pa.string()), pa.array(np.minimum(score, 1.0).astype(float), pa.float64()), pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * len(languages), share.astype(float).ravel())],
                    names=[id_col, *keep, "lang_pred", "score", "proportions"],
                )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [id_col, *keep])
    return df.select(id_col, text_col, *keep).mapInArrow(tidy(run, ("langid", token)), f"{kinds}, lang_pred string, score double, proportions array<double>")
