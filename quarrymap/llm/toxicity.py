"""Toxicity (operator 7): bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding (frequent training words; others share one) next to the mean of
the embeddings of its hashed character 2- and 3-grams. A forward and a backward gated recurrent layer
read a window of `WINDOW` words; attention pools their states, and a logistic unit scores the window.
Windows overlap by half and cover every word of every text; a document's score is its worst window's.

Training (driver, numpy, Adam) sees labels of documents only, so it is multiple-instance learning: in
the first pass a toxic document is represented by up to `FIRST` windows drawn from it, among four times as
many clean windows as there are documents; in every later pass by the worst of all its windows, a clean one by
the worst of `LOOKS` drawn anew, and as many other clean windows join as there are documents. From the third pass
on, the `DOUBTED` share of toxic documents whose worst window scores least, and under one half, sits out, as
some labels are wrong. The weights of the later passes are averaged. One component of a word's embedding starts
as the word's log odds between toxic and clean documents, which few labelled rows already tell, and a unit of
either direction starts as its detector, the weaker the more toxic rows there are (`FEW` / rows). Training reads a bounded sample of whole texts of any length: per class, the
labelled rows of smallest id hash among the ids of `docs`, up to `SAMPLE` rows and to the row with which they
come to `SAMPLE_CHARS` characters.

Defined cases: null and empty texts, and every text when a class has no labelled row, score the
share of toxic rows in the sample (0 with none), at most 0.49; texts of any length are scored whole,
`PASS` characters of documents or 2048 windows of a longer one at a time; repeated rows get equal rows; of
several labels of one id the most toxic counts; null ids learn nothing; an empty table gives no rows; the
input's other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import Batches, crc_fold, held, slices, texts_of, tidy

WINDOW, STRIDE = 32, 16
VOCABULARY, MIN_DOCS, RARE = 4000, 4, 5
BINS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 2048, 12, 8, 8, 6
SAMPLE, SAMPLE_CHARS = 1000, 8_000_000  # rows and characters of a class
CACHE, PASS = 200_000, 1 << 19
EPOCHS, STEPS, BATCH, RATE = 9, 300, 64, 0.01
FIRST, LOOKS = 16, 24
DOUBTED, AVERAGED = 0.3, 0.4  # shares of toxic documents and of passes
FEW = 60


def clean(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}*#$%&|<>").lower()


def char_bins(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the character 2- and 3-grams of `<word>`, and the word number of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    cells, owners, key = [], [], codes
    for n in (2, 3):
        m = len(codes) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(1_000_003) + codes[n - 1 :]
        inside = owner[:m] == owner[n - 1 :]
        cells.append((((key[inside] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BINS)
        owners.append(owner[:m][inside])
    return np.concatenate(cells), np.concatenate(owners)


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover all n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Features:
    """What the network reads of distinct words: vocabulary numbers and n-gram bins, flat, by word."""

    def __init__(self, words: list[str], vocabulary: dict[str, int]):
        words = [clean(w) or w for w in words]
        self.ids = np.array([vocabulary.get(w, 0) for w in words])
        cells, owners = char_bins(words)
        order = np.argsort(owners, kind="stable")
        self.cells, self.counts = cells[order], np.bincount(owners, minlength=len(words))
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, some: np.ndarray) -> "Features":
        """Those of some words."""
        part = Features.__new__(Features)
        part.ids, part.counts = self.ids[some], self.counts[some]
        part.starts = np.cumsum(part.counts) - part.counts
        part.cells = self.cells[np.arange(part.counts.sum()) + np.repeat(self.starts[some] - part.starts, part.counts)]
        return part


class Network:
    """Weights, forward pass and gradients. Inputs are word vectors X [T, N, D] with mask [T, N]."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.w = {"E": 0.3 * g(1, (len(vocabulary) + 1) * WORD_DIM).reshape(-1, WORD_DIM), "C": 0.3 * g(1, BINS * CHAR_DIM).reshape(-1, CHAR_DIM)}
        for s in "fb":
            self.w |= {f"W{s}": g(d, 3 * h), f"U{s}": g(h, 3 * h), f"b{s}": np.zeros(3 * h, np.float32)}
        self.w |= {"A": g(2 * h, a), "v": g(a, 1)[:, 0], "o": g(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}

    def detect_odds(self, strength: float) -> None:
        """Let the first unit of either direction follow the embeddings' first component, and attention and output follow it."""
        h = HIDDEN
        for s in "fb":
            self.w[f"W{s}"][:, 2 * h] *= 1 - 0.7 * strength
            self.w[f"W{s}"][0, 2 * h] += strength * (1 - self.w[f"W{s}"][0, 2 * h])
            self.w[f"b{s}"][2 * h] = -0.5 * strength
        for name, at, value in (("A", ([0, h], 0), 2.0), ("v", 0, 3.0), ("o", [0, h], 2.0)):
            self.w[name][at] += strength * (value - self.w[name][at])

    # -- inputs ----------------------------------------------------------------------------------
    def inputs(self, words: list[str] | Features) -> tuple[np.ndarray, Features]:
        """Vectors of distinct words, and their features."""
        f = words if isinstance(words, Features) else Features(words, self.vocabulary)
        chars = np.add.reduceat(self.w["C"][f.cells], f.starts, axis=0) / f.counts[:, None].astype(np.float32)
        return np.concatenate([self.w["E"][f.ids], chars], 1), f

    # -- one direction ---------------------------------------------------------------------------
    def run(self, P: np.ndarray, mask: np.ndarray, s: str, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        """States [T, N, H] from projected inputs P [T, N, 3H]; padded steps carry the state."""
        steps, n, h = P.shape[0], P.shape[1], HIDDEN
        U, state = self.w[f"U{s}"], np.zeros((n, h), np.float32)
        out, tape = np.empty((steps, n, h), np.float32), []
        for t in range(steps - 1, -1, -1) if back else range(steps):
            gate = state @ U
            zr = sigmoid(P[t, :, : 2 * h] + gate[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(P[t, :, 2 * h :] + r * gate[:, 2 * h :])
            m = mask[t][:, None]
            nxt = np.where(m, z * state + (1 - z) * new, state)
            if keep:
                tape.append((t, state, z, r, new, gate[:, 2 * h :]))
            out[t] = state = nxt
        return out, tape

    def pool(self, H: np.ndarray, mask: np.ndarray) -> tuple:
        hidden = np.tanh(H @ self.w["A"])
        score = np.where(mask, hidden @ self.w["v"], -1e9)
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, H)
        return sigmoid(pooled @ self.w["o"] + self.w["c"]), pooled, share, hidden

    def score(self, Pf: np.ndarray, Pb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        H = np.concatenate([self.run(Pf, mask, "f", False, False)[0], self.run(Pb, mask, "b", True, False)[0]], 2)
        return self.pool(H, mask)[0]

    # -- training --------------------------------------------------------------------------------
    def gradients(self, words: list[str] | Features, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of windows; at [T, N] numbers the distinct words."""
        w, h = self.w, HIDDEN
        vectors, f = self.inputs(words)
        X = vectors[at]
        runs = {s: self.run(X @ w[f"W{s}"] + w[f"b{s}"], mask, s, s == "b", True) for s in "fb"}
        H = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p, pooled, share, hidden = self.pool(H, mask)
        loss = -float((weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weight.sum())
        d = weight * (p - y) / weight.sum()
        g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * w["o"]
        dshare = np.einsum("nh,tnh->tn", dpool, H)
        dscore = share * (dshare - (share * dshare).sum(0))
        dhid = dscore[:, :, None] * w["v"] * (1 - hidden**2)
        g["v"] = np.einsum("tn,tna->a", dscore, hidden)
        g["A"] = np.einsum("tnh,tna->ha", H, dhid)
        dH = share[:, :, None] * dpool + dhid @ w["A"].T
        dX = np.zeros_like(X)
        for k, s in enumerate("fb"):
            U, dU = w[f"U{s}"], np.zeros((h, 3 * h))
            dP, carry = np.zeros((*X.shape[:2], 3 * h), np.float32), np.zeros((X.shape[1], h))
            for t, state, z, r, new, gn in reversed(runs[s][1]):
                m = mask[t][:, None]
                total = dH[t, :, k * h : (k + 1) * h] + carry
                on = np.where(m, total, 0)
                dnew = on * (1 - z) * (1 - new**2)
                dz = on * (state - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                dP[t] = np.concatenate([dz, dr, dnew], 1)
                dgate = np.concatenate([dz, dr, dnew * r], 1)
                dU += state.T @ dgate
                carry = np.where(m, on * z, total) + dgate @ U.T
            g[f"U{s}"], g[f"b{s}"] = dU, dP.sum((0, 1))
            g[f"W{s}"] = np.einsum("tnd,tng->dg", X, dP)
            dX += dP @ w[f"W{s}"].T
        dv = np.zeros_like(vectors)
        np.add.at(dv, at[mask], dX[mask])
        g["E"], g["C"] = np.zeros_like(w["E"]), np.zeros_like(w["C"])
        np.add.at(g["E"], f.ids, dv[:, :WORD_DIM])
        np.add.at(g["C"], f.cells, np.repeat(dv[:, WORD_DIM:] / f.counts[:, None].astype(dv.dtype), f.counts, axis=0))
        return loss, g


def layout(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, window word numbers [T, windows], mask, and the document of each window."""
    at: dict[str, int] = {}
    flat = np.fromiter((at.setdefault(w, len(at)) for d in docs for w in d), np.int32)
    place, doc = spans(np.array([len(d) for d in docs]))
    mask = place >= 0
    number = flat[np.maximum(place, 0, out=place)]
    number[~mask] = 0
    return list(at), number, mask, doc


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First flat word position of every window, the end of its document, and its document."""
    end = np.cumsum(counts)
    per = np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(nth * STRIDE, np.maximum(counts[doc] - WINDOW, 0))
    return start + (end - counts)[doc], end[doc], doc


def places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flat word positions [T, windows], -1 past the document's end."""
    at = start.astype(np.int32) + np.arange(WINDOW, dtype=np.int32)[:, None]
    at[at >= end.astype(np.int32)] = -1
    return at


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat word positions of every window [T, windows] and its document."""
    start, end, doc = windows(counts)
    return places(start, end), doc


def fit(docs: list[list[str]], labels: np.ndarray) -> Network:
    """Train on documents (word lists, none empty) and their labels."""
    found = [{clean(x) or x for x in d} for d in docs]
    toxic, seen = (Counter(w for d, y in zip(found, labels) if y or k for w in d) for k in (0, 1))
    frequent = sorted((w for w, n in seen.items() if n >= max(MIN_DOCS, len(docs) // 200)), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network({w: i + 1 for i, w in enumerate(frequent)})
    # A word's first component starts as its log odds between toxic and clean documents, shrunk if it is rare.
    n_toxic = int(labels.sum())
    odds = np.array([0.0, *(np.log((toxic[w] + 1) * (len(docs) - n_toxic + 2) / ((seen[w] - toxic[w] + 1) * (n_toxic + 2))) * seen[w] / (seen[w] + RARE) for w in frequent)])
    net.w["E"][:, 0] = odds / 2
    net.detect_odds(min(1.0, FEW / n_toxic))
    words, at, mask, doc = layout(docs)
    features = Features(words, net.vocabulary)
    rng, y = np.random.default_rng(11), labels[doc].astype(np.float32)
    m1, m2, step, epoch = {}, {}, 0, 0
    total, kept = {}, 0
    while epoch < EPOCHS or step < STEPS:  # small samples get more passes
        if epoch:
            some = np.sort(drawn(rng, doc, np.where(y == 1, len(doc), LOOKS)))
            p = score_windows(net, features, at, mask, some)
            order = np.lexsort((-p, doc[some]))
            nth = order[np.unique(doc[some][order], return_index=True)[1]]
            first, p = some[nth], p[nth]
            if epoch > 1:
                first = first[(y[first] == 0) | (p >= min(0.5, np.quantile(p[y[first] == 1], DOUBTED)))]
            other = rng.choice(np.flatnonzero(y == 0), min(len(docs), int((y == 0).sum())), replace=False)
            chosen = np.union1d(first, other)
        else:
            other = rng.choice(np.flatnonzero(y == 0), min(4 * len(docs), int((y == 0).sum())), replace=False)
            chosen = np.union1d(drawn(rng, doc, np.where(y == 1, FIRST, 0)), other)
        epoch += 1
        balance = np.where(y[chosen] == 1, 1.0, max(1e-3, y[chosen].sum() / max(1, (1 - y[chosen]).sum()))).astype(np.float32)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            part = chosen[order[k : k + BATCH]]
            ids, inverse = np.unique(at[:, part], return_inverse=True)
            _, g = net.gradients(features.of(ids), inverse.reshape(WINDOW, -1), mask[:, part], y[part], balance[order[k : k + BATCH]])
            step += 1
            for name, d in g.items():
                a = m1[name] = 0.9 * m1.get(name, 0) + 0.1 * d
                b = m2[name] = 0.999 * m2.get(name, 0) + 0.001 * d * d
                net.w[name] = (net.w[name] - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if epoch > (1 - AVERAGED) * EPOCHS and step > (1 - AVERAGED) * STEPS:
            total, kept = {name: total.get(name, 0) + w for name, w in net.w.items()}, kept + 1
    net.w = {name: (w / kept).astype(np.float32) for name, w in total.items()}
    return net


def drawn(rng: np.random.Generator, doc: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Windows drawn from every document, up to `most` (given per window)."""
    turn = rng.permutation(len(doc))
    turn = turn[np.argsort(doc[turn], kind="stable")]
    size = np.bincount(doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return turn[nth < most[turn]]


def score_windows(net: Network, features: Features, at: np.ndarray, mask: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Scores of some windows, by number."""
    n = len(features.ids)
    vectors = np.concatenate([net.inputs(features.of(np.arange(k, min(n, k + 20_000))))[0] for k in range(0, n, 20_000)])
    P = {s: vectors @ net.w[f"W{s}"] + net.w[f"b{s}"] for s in "fb"}
    parts = [some[k : k + 2048] for k in range(0, len(some), 2048)]
    return np.concatenate([net.score(P["f"][at[:, x]], P["b"][at[:, x]], mask[:, x]) for x in parts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[Network | None, float]:
    """The network (None if a class has no row) and the score of texts without words."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    marks = marks.join(texts.select("id").distinct(), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    chosen = [marks.filter(F.col("y") == k).orderBy("h", "id").limit(sample) for k in (0, 1)]  # 2 * sample ids
    rows = texts.join(F.broadcast(reduce(DataFrame.unionByName, chosen)), "id").distinct()
    order = Window.partitionBy("y").orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"nth": F.count("*").over(order), "chars": F.sum(F.length("text")).over(order) - F.length("text")})
    rows = rows.filter((F.col("nth") <= sample) & (F.col("chars") < SAMPLE_CHARS)).select("id", "y", "text").collect()
    rows = sorted(tuple(r) for r in rows if r["text"].split())
    y = np.array([int(r[1] == 1) for r in rows])
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return None, min(share, 0.49)
    return fit([r[2].split() for r in rows], y), min(share, 0.49)


class Scorer:
    """Projected inputs of words seen before in this worker."""

    def __init__(self, net: Network):
        self.net, self.at, self.used = net, {}, 0
        self.rows = {s: np.zeros((CACHE, 3 * HIDDEN), np.float32) for s in "fb"}

    def find(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.at})
        if self.used + len(new) > len(self.rows["f"]):
            self.at.clear()
            self.used, new = 0, list(set(words))
            if len(new) > len(self.rows["f"]):
                self.rows = {s: np.zeros((len(new), 3 * HIDDEN), np.float32) for s in "fb"}
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            vectors = self.net.inputs(part)[0]
            for s, rows in self.rows.items():
                rows[self.used : self.used + len(part)] = vectors @ self.net.w[f"W{s}"] + self.net.w[f"b{s}"]
            self.at.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def documents(self, docs: list[list[str]], empty: float) -> np.ndarray:
        """Worst window of each document."""
        out = np.full(len(docs), float(empty))
        full = [i for i, d in enumerate(docs) if d]
        if not full:
            return out
        flat = self.find([w for i in full for w in docs[i]])
        start, end, doc = windows(np.array([len(docs[i]) for i in full]))
        p = np.empty(len(doc), np.float32)
        for k in range(0, len(doc), 2048):
            part = places(start[k : k + 2048], end[k : k + 2048])
            mask = part >= 0
            at = flat[np.maximum(part, 0)]
            p[k : k + 2048] = self.net.score(self.rows["f"][at], self.rows["b"][at], mask)
        out[full] = np.maximum.reduceat(p, np.unique(doc, return_index=True)[1])
        return out


def text_scores(column: pa.Array, model: tuple[Network | None, float], token: str) -> np.ndarray:
    """Score of each text."""
    net, empty = model
    texts = texts_of(column)
    if net is None:
        return np.full(len(texts), empty)
    scorer = held(("toxicity", token), lambda: Scorer(net))
    parts = [scorer.documents([t.split() for t in texts[s]], empty) for s in slices([len(t) + 1 for t in texts], PASS)]
    return np.concatenate([*parts, np.zeros(0)])


def score_documents(df: DataFrame, model: tuple[Network | None, float], keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept columns, score, predicted) of every row; nothing is shuffled."""
    keep = keep or []
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # weights of fixed size

    def run(it: Batches) -> Batches:
        for b in it:
            score = text_scores(b.column(1), shared.value, token)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[id_col, *keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [id_col, *keep])
    return df.select(id_col, text_col, *keep).mapInArrow(tidy(run, ("toxicity", token)), f"{kinds}, score double, predicted int")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """Rows of `df`, all columns, that are not predicted toxic; labels of fold 0 are not learnt.

    Cases are those of the module; rows are scored and filtered in one pass, so no column is added on the way.
    """
    model = train(df.filter(crc_fold(id_col, fold) != 0), labels, id_col, text_col)
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = df.columns.index(text_col)

    def run(it: Batches) -> Batches:
        for b in it:
            yield b.filter(pa.array(text_scores(b.column(at), shared.value, token) < 0.5))

    return df.mapInArrow(tidy(run, ("toxicity", token)), df.schema)
