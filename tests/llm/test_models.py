"""The models' arithmetic against plain Python, one document, word and step at a time; and columns of clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymap.llm import langid, ngram_join, quality, suffix_dedup, topk, toxicity
from tests.llm.cases import BASE
from tests.llm.test_pages_vectors import brute_top
from tests.llm.test_text_ops import brute_repeats


def plain_mixture(loglik, allowed, rounds=langid.ROUNDS):
    """(proportions, log likelihood) of one document: EM over the allowed languages."""
    share = [a / sum(allowed) for a in allowed]
    for _ in range(rounds):
        total = [0.0] * len(share)
        for word in loglik:
            joint = [p * math.exp(x) for p, x in zip(share, word)]
            for k, j in enumerate(joint):
                total[k] += j / sum(joint)
        share = [t / len(loglik) for t in total]
    return share, sum(math.log(sum(p * math.exp(x) for p, x in zip(share, word))) for word in loglik)


def plain_choice(loglik):
    """Proportions of the best penalised set among those that drop the least language of the last fit."""
    k, n = len(loglik[0]), len(loglik)
    allowed = [1.0] * k
    share, like = plain_mixture(loglik, allowed)
    fits = [(-2 * like + k * math.log(n + 1), -k, share)]
    for size in range(k - 1, 0, -1):
        if size == 1:
            sums = [sum(w[i] for w in loglik) for i in range(k)]
            best = sums.index(max(sums))
            share, like = [float(i == best) for i in range(k)], sums[best]
        else:
            least = min((i for i in range(k) if allowed[i]), key=lambda i: share[i])
            allowed[least] = 0.0
            share, like = plain_mixture(loglik, allowed)
        fits.append((-2 * like + size * math.log(n + 1), -size, share))
    return min(fits)[2]


def plain_cells(word):
    """Cells of the 1- to 3-grams of `<word>`, one at a time."""
    codes, out = [ord(c) for c in f"<{word}>"], []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            key = 0
            for c in codes[i : i + n]:
                key = (key * 1_000_003 + c) % 2**64
            if n == 1:
                key = codes[i]
            out.append((((key ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> 48) % langid.BINS)
    return out


def test_training_counts_equal_plain_python(spark):
    data = [(1, "Der Hund, der läuft", "de"), (2, "el perro 12 corre x2y", "es"), (3, "Hund?", "de"), (4, None, "de"), (5, "the dog", None), (6, "", "fr")]
    languages, table = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert languages == ["de", "es"]
    for k, lang in enumerate(languages):
        words = [w for _, t, own in data if own == lang and t for w in ("".join(c for c in x if c.isalpha()) for x in t.lower().split()) if w]
        counts = np.bincount([c for w in words for c in plain_cells(w)], minlength=langid.BINS) + 0.1
        assert np.allclose(table.dense(0, 2)[:, k], np.log(counts / counts.sum()), atol=1e-5)


def test_six_hundred_languages(spark):
    rng = random.Random(11)
    vocabulary = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(30)] for k in range(600)}
    said = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    learned = spark.createDataFrame([(k, said(lang, 120), lang) for k, lang in enumerate(vocabulary)], "doc_id long, text string, lang string")
    model = langid.train(learned)
    assert model[0] == sorted(vocabulary)
    asked = [(k, said(f"l{k:03d}", 40), None) for k in range(0, 600, 7)] + [(1000, said("l005", 60) + " " + said("l597", 40), None), (1001, "", None), (1002, "12 34", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[k].lang_pred == f"l{k:03d}" and len(got[k].proportions) == 600 for k, *_ in asked[:-3])
    assert got[1000].lang_pred == "l005" and abs(got[1000].proportions[597] - 0.4) < 0.1
    assert got[1001].lang_pred == got[1002].lang_pred == "und"


def test_leading_languages_are_those_of_a_plain_tournament():
    rng = np.random.default_rng(4)
    counts, total = [3, 1, 25], 21
    loglik = rng.normal(-9, 2, (sum(counts), total)).astype(np.float32)
    starts = np.cumsum([0, *counts[:-1]])
    chosen, best = langid.leading((loglik[:, k : k + langid.MEET] for k in range(0, total, langid.MEET)), starts)
    for i, (s, n) in enumerate(zip(starts, counts)):
        lead = list(range(langid.MEET))
        for first in range(langid.MEET, total, langid.MEET):
            met = lead + list(range(first, min(first + langid.MEET, total)))
            share, _ = plain_mixture(loglik[s : s + n, met].tolist(), [1.0] * len(met))
            lead = sorted(met[k] for k in sorted(range(len(met)), key=lambda k: -share[k])[: langid.MEET])
        assert chosen[i].tolist() == lead and (best[s : s + n] == loglik[s : s + n, lead]).all()


def test_mixture_inference_equals_plain_python():
    rng = np.random.default_rng(3)
    counts = [1, 2, 7, 40, 90]
    docs = []
    for n in counts:
        own = rng.integers(0, 4, 2)
        docs.append(np.array([[-9 + 2.5 * (k == own[i % 2]) + rng.normal() for k in range(4)] for i in range(n)], np.float32))
    loglik, starts = np.concatenate(docs), np.cumsum([0, *counts[:-1]])
    share, like = langid.mixtures(loglik, starts, np.ones((len(counts), 4), np.float32))
    chosen = langid.choose(loglik, starts)
    for i, d in enumerate(docs):
        want, total = plain_mixture(d.tolist(), [1.0] * 4)
        assert np.allclose(share[i], want, atol=1e-4) and math.isclose(like[i], total, rel_tol=1e-4)
        assert np.allclose(chosen[i], plain_choice(d.tolist()), atol=1e-4)


def plain_window_score(net, words):
    """Score of one window by loops over steps, gates and units."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    vectors, h = net.inputs(words)[0].astype(float), toxicity.HIDDEN
    logistic = lambda x: 1 / (1 + math.exp(-x))

    def states(order, s):
        state, out = [0.0] * h, {}
        for t in order:
            given = [sum(vectors[t][i] * w[f"W{s}"][i][j] for i in range(len(vectors[t]))) + w[f"b{s}"][j] for j in range(3 * h)]
            back = [sum(state[i] * w[f"U{s}"][i][j] for i in range(h)) for j in range(3 * h)]
            z = [logistic(given[j] + back[j]) for j in range(h)]
            r = [logistic(given[h + j] + back[h + j]) for j in range(h)]
            new = [math.tanh(given[2 * h + j] + r[j] * back[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * new[j] for j in range(h)]
            out[t] = state
        return out

    ahead, behind = states(range(len(words)), "f"), states(range(len(words) - 1, -1, -1), "b")
    both = [ahead[t] + behind[t] for t in range(len(words))]
    weight = [math.exp(sum(math.tanh(sum(x[i] * w["A"][i][a] for i in range(2 * h))) * w["v"][a] for a in range(len(w["v"])))) for x in both]
    pooled = [sum(g * x[i] for g, x in zip(weight, both)) / sum(weight) for i in range(2 * h)]
    return logistic(sum(p * o for p, o in zip(pooled, w["o"])) + w["c"][0])


def test_document_scores_equal_plain_forward_passes():
    net = toxicity.Network({"idiot": 1, "kind": 2, "you": 3})
    rng = random.Random(5)
    docs = [[rng.choice(["idiot", "kind", "you", "über", "漢字", "x", "word7!"]) for _ in range(n)] for n in (1, 5, 32, 33, 70)]
    got = toxicity.Scorer(net).documents([*docs, []], 0.25)
    want = [max(plain_window_score(net, d[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(d))) for d in docs]
    assert np.allclose(got, [*want, 0.25], atol=1e-4)


def test_training_reads_long_texts_and_its_own_fold_only(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(60)}"
    rows = [(k, " ".join([*(word() for _ in range(1800)), *(["vile"] * (k % 2)), *(word() for _ in range(200))])) for k in range(24)]
    docs = spark.createDataFrame([*rows, (None, "vile"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    net, share = toxicity.train(docs, labels, sample=10)
    assert net is not None and "vile" in net.vocabulary and share == 0.49  # 10 rows a class, all of ids in docs
    assert toxicity.train(docs.filter("doc_id % 2 = 0"), labels) == (None, 0.0)


def test_rule_estimates_equal_em_over_documents():
    rng = random.Random(7)
    votes = [tuple(rng.choice([1, 1, 1, 0, -1]) if good else rng.choice([1, 0, -1, -1]) for _ in range(3)) for good in [True] * 70 + [False] * 30]
    table = sorted({v: votes.count(v) for v in votes}.items())
    by_table, by_document = quality.RuleModel(table, ["a", "b", "c"]), quality.RuleModel([(v, 1) for v in votes], ["a", "b", "c"])
    assert math.isclose(by_table.prior, by_document.prior, rel_tol=1e-9)
    for v, _ in table:
        odds = by_table.prior / (1 - by_table.prior)
        for j, x in enumerate(v):
            odds *= by_table.p[j][1][x] / by_table.p[j][0][x]
        assert math.isclose(by_table.posterior(v), odds / (1 + odds), rel_tol=1e-9) and math.isclose(by_table.posterior(v), by_document.posterior(v), rel_tol=1e-9)
        for j in range(3):
            assert math.isclose(sum(by_table.p[j][1].values()), 1) and math.isclose(sum(by_table.p[j][0].values()), 1)


def test_columns_of_clashing_names_pass_through(spark):
    schema = "__id string, __tfp long, __first boolean, __nth string, __spans string, __row int, text string, doc_id long, n_chars int, id string, component string"
    rows = [("a", 1, True, "n", "s", 2, BASE, 6, 7, "i", "c"), ("b", 2, None, "m", "t", 3, BASE, 7, 7, "j", "d"), ("c", 3, False, None, None, 4, "one two", None, 7, "k", "e"), ("d", 4, True, "o", "u", 5, None, 8, 7, "l", "f")]
    frame = spark.createDataFrame(rows, schema)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns and sorted(tuple(r) for r in kept.collect() if r.doc_id != 8) == [rows[0], rows[2]] and rows[3] in [tuple(r) for r in kept.collect()]
    cut = suffix_dedup.remove_repeats(frame)
    assert cut.columns == frame.columns
    got = {r["__id"]: r for r in cut.collect()}
    assert got["a"].text == "" and got["a"].n_chars == 0 and got["c"].text == "one two" and got["c"].n_chars == 7 and got["d"].text is None and got["b"]["__spans"] == "t"
    assert sorted(tuple(r)[:6] for r in toxicity.drop_toxic(frame, spark.createDataFrame([], "doc_id long, toxic int")).collect()) == sorted(r[:6] for r in rows)


@pytest.mark.parametrize("before", ["", "shared words go first "])
def test_a_passage_in_more_texts_than_a_block_takes(spark, before):
    rng = random.Random(9)
    passage = before + "".join(rng.choice("abcdefgh ") for _ in range(195 - len(before)))  # under 200 bytes: repeats only where its surroundings do
    data = [(k, f"{rng.randrange(10)}{passage}{rng.randrange(10)}{rng.randrange(10)}{rng.randrange(10)} {k}") for k in range(suffix_dedup.HOT + 300)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.span_digests(frame).collect())) == sorted(brute_repeats(data))


def test_top_k_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((9, 6))
    vectors = [(centres[i % 9] * (1 + i % 3) + 0.05 * rng.standard_normal(6)).tolist() for i in range(700)] + [centres[2].tolist()] * 150
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = [np.floor(256 * np.array(v)) for v in vectors]
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())) == brute_top(list(range(850)), whole, range(0, 850, 20), 5)
