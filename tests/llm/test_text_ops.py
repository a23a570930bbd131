"""Operators 1, 3, 6, 7 and 8 against brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrymap.llm import ngram_join, quality, suffix_dedup, toxicity
from quarrymap.llm import queries as registered
from quarrymap.llm.langid import identify, train
from tests.conftest import SF
from tests.llm.cases import documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (k, _) in enumerate(texts):
        least[find(i)].append(k)
    return [(k, len(sets[i]), min(least[find(i)])) for i, (k, _) in enumerate(texts)]


def edited(rng, words, rate):
    return [w if rng.random() > rate else f"new{rng.randrange(9999)}" for w in words]


def test_ngram_join_equals_brute_force(spark):
    rng, texts = random.Random(1), []
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(25)]  # shared by unrelated texts
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 9, 30, 60, 70, 130, 300]))]
        if rng.random() < 0.3:
            base = line + base
        texts += [" ".join(edited(rng, base, rate)) for rate in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
        texts.append(" ".join(base[: int(len(base) * 0.9)]))
    rng.shuffle(texts)
    data = list(enumerate(texts)) + [(r[0] + 1000, r[1]) for r in rows() if r[0] is not None and r[0] != 6 and r[0] != 3]
    got = ngram_join.near_duplicate_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(data))


def test_tiles_are_cut_by_bytes_without_losing_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    members = []
    for k in range(60):
        h = base.copy()
        h[: 5 * k] = rng.integers(0, 2**63, 5 * k).astype(np.uint64)
        h.sort()
        members.append((7, k, len(h), bytearray(ngram_join.parity_sketch(h, len(h)))))
    members = spark.createDataFrame(members, "signature long, id long, n long, sketch binary")
    found = spark.createDataFrame([], "id long, component long")
    want = sorted(map(tuple, ngram_join.cross_pairs(ngram_join.mixed_blocks(members, found)).collect()))
    monkeypatch.setattr(ngram_join, "TILE_BYTES", 4096)
    cut = ngram_join.mixed_blocks(members, found)
    size = members.selectExpr("sum(octet_length(sketch))").first()[0]
    assert cut.first()["buckets"] == -(-size // 4096) > 1
    assert sorted(map(tuple, ngram_join.cross_pairs(cut).collect())) == want and len(want) > 100


def test_ngram_join_odd_rows(spark):
    got = ngram_join.near_duplicate_classes(documents(spark)).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[6].component_id == by_id[7].component_id == by_id[12].component_id == 6
    assert by_id[0].n_shingles == by_id[2].n_shingles == 0 and by_id[0].component_id == 0
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.near_duplicate_classes(empty(spark)).count() == 0
    kept = ngram_join.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == ids[3] == 1 and 7 not in ids and 12 not in ids and ids[None] == 2 and ids[0] == ids[1] == 1


def test_ngram_join_of_one_id_with_two_texts(spark):
    rng = random.Random(8)
    a, b, c = ([f"w{rng.randrange(400)}" for _ in range(90)] for _ in range(3))
    near = lambda words, n: " ".join([*words[:-n], *(f"x{n}{i}" for i in range(n))])
    data = [(10, " ".join(a)), (10, " ".join(b)), (1, near(a, 2)), (11, near(b, 2)), (12, near(b, 3)), (20, " ".join(c)), (20, near(c, 2)), (30, "one two three four five six"), (10, " ".join(b))]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicate_classes(frame).collect())) == sorted(brute_components(data))
    kept = sorted(map(tuple, ngram_join.keep_one(frame).collect()))
    assert [k for k, _ in kept] == [1, 10, 20, 30] and (10, " ".join(b)) in kept


def test_blocks_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (70, 200, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[5:], rng.integers(0, 1 << 63, 7, dtype=np.uint64)]))
        x, y = ({(s, v) for s, _, v in zip(*(c.tolist() for c in ngram_join.block_sketch(h, np.array([len(h)]))[:3]))} for h in (a, b))
        difference = len(set(a.tolist()) ^ set(b.tolist()))
        assert len({s for s, v in x if v == 0} - {s for s, v in y if v == 0}) <= difference
        assert ngram_join.sketch_distance(ngram_join.parity_sketch(a, len(a)), ngram_join.parity_sketch(b, len(b))) <= difference


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(texts, raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((k, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup_of_thousands_of_equal_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = words(260)
    data = [(7, words(50) + passage)] * 5000 + [(k, words(40) + passage[:210] + words(30)) for k in range(20, 26)] + [(99, words(400))]
    blocks = []

    def counted(contexts, search=suffix_dedup.search_blocks):
        blocks.append(contexts.groupBy("key").count().agg({"count": "max"}).first()[0])
        return search(contexts)

    monkeypatch.setattr(suffix_dedup, "search_blocks", counted)
    found = suffix_dedup.span_digests(spark.createDataFrame(data, "doc_id long, text string").repartition(6))
    want = set(brute_repeats(data[:2] + data[5000:]))
    assert set(map(tuple, found.collect())) == want and found.filter("doc_id = 7").count() == 5000
    assert blocks[0] < 100


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng, data = random.Random(3), [(r[0], r[1]) for r in rows()]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    short = "".join(rng.choice("abcdefgh ") for _ in range(150))
    for k in range(40):
        filler = lambda: "".join(rng.choice("ijklmnop é") for _ in range(rng.randint(0, 120)))
        data.append((100 + k, filler() + rng.choice([passage, short, passage[7:], short + passage[:60], ""]) + filler()))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(str, map(tuple, suffix_dedup.span_digests(frame).collect()))) == sorted(map(str, brute_repeats(data)))


def test_suffix_blocks_equal_brute_force():
    rng = random.Random(4)
    for trial in range(150):
        letters, length = [b"a", b"ab", b"abc", bytes(range(256))][trial % 4], rng.choice([7, 8, 12, 30])
        bases = [bytes(rng.choice(letters) for _ in range(rng.randint(5, 80))) for _ in range(5)]
        contexts = [c for c in (b"".join(rng.choice(bases)[rng.randint(0, 4) :] for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))) if c] or [b"x"]
        counts = np.array([rng.choice([1, 1, 2]) for _ in contexts])
        seen = Counter()
        for c, n in zip(contexts, counts.tolist()):
            for i in range(len(c) - length + 1):
                seen[c[i : i + length]] += n
        want = {(k, i) for k, c in enumerate(contexts) for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1}
        owner, a, z = suffix_dedup.repeated_windows(contexts, counts, length)
        assert {(k, i) for k, s, e in zip(owner.tolist(), a.tolist(), z.tolist()) for i in range(s, e)} == want


def test_remove_repeats_keeps_rows_and_columns(spark):
    out = suffix_dedup.remove_repeats(documents(spark))
    assert out.columns == documents(spark).columns and out.count() == len(rows())
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[0].text is None and texts[6].text == "" and texts[9].text == "" and texts[6].n_chars == 0 and texts[3].text == "one"
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_language_id(spark):
    got = registered.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_id_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    got = identify(documents(spark), model, keep=["lang"]).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    assert {by_id[k].lang_pred for k in (0, 1, 2, 14)} == {"und"} and by_id[0].score == 0
    assert by_id[6].lang_pred in model[0] and by_id[6].lang_pred == by_id[7].lang_pred
    assert {r.lang_pred for r in identify(documents(spark), train(docs.limit(0))).collect()} == {"und"}
    assert identify(empty(spark), model).count() == 0
    mixture = docs.filter("lang = 'de'").first().text + " " + docs.filter("lang = 'es'").first().text
    share = identify(spark.createDataFrame([(1, mixture)], "doc_id long, text string"), model).first().proportions
    assert sum(p > 0.05 for p in share) == 2


def brute_stats(text):
    w = WORD.findall(text or "")
    seen, covered, lines, again = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set(), set(), 0
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame, texts in ((documents(spark), [(r[0], r[1]) for r in rows()]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = quality.quality_rules(frame).collect()
        want = sorted((str(k), *brute_stats(t)) for k, t in texts)
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert quality.quality_rules(empty(spark)).count() == 0
    kept = quality.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns


def test_quality_verdict_finds_junk(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels]
    bad, good = [r for r in got if labels[r.doc_id] == 0], [r for r in got if labels[r.doc_id] == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(r.kept for r in good) >= 0.98 * len(good)


def test_rule_model_estimates_posterior():
    model = quality.RuleModel([((1, 1), 90), ((-1, -1), 10)], ["a", "b"])
    assert model.posterior((1, 1)) > 0.9 > 0.1 > model.posterior((-1, -1))
    assert quality.RuleModel([], ["a"]).posterior((1,)) > 0.5


def test_toxicity_gradients():
    net = toxicity.Network({"a": 1, "b": 2})
    words, at, mask, _ = toxicity.layout([["a", "b", "cc"], ["zz"]])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    y, weight = np.array([1.0, 0.0]), np.array([1.0, 0.5])
    _, g = net.gradients(words, at, mask, y, weight)
    for k in net.w:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.w[k][i]
        loss = []
        for e in (1e-4, -1e-4):
            net.w[k][i] = old + e
            loss.append(net.gradients(words, at, mask, y, weight)[0])
        net.w[k][i] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][i]) < 1e-3 * max(0.01, abs(g[k][i])) + 1e-5, k


def test_windows_cover_everything():
    for n in (1, 5, 32, 33, 48, 49, 100, 333):
        place, doc = toxicity.spans(np.array([n]))
        starts = [int(c[0]) for c in place.T]
        assert starts == toxicity.window_starts(n) and set(place[place >= 0].tolist()) == set(range(n)) and len(doc) == len(starts)


def test_toxicity_held_out_and_odd_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.filter("doc_id % 5 <> 0"), labels)
    got = toxicity.score_documents(docs.filter("doc_id % 5 = 0"), model).join(labels, "doc_id").collect()
    right, toxic = sum(r.predicted == r.toxic for r in got), [r for r in got if r.toxic]
    assert right >= 0.9 * len(got) and right > len(got) - len(toxic)  # always answering 0 has that many right
    found = [r for r in got if r.predicted]
    assert sum(r.toxic for r in found) >= 0.8 * len(found) and sum(r.predicted for r in toxic) >= 0.5 * len(toxic)  # some labels are wrong
    above = [(t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in got if not c.toxic]
    assert sum(above) >= 0.75 * len(above)  # area under the curve
    odd = toxicity.score_documents(documents(spark), model, keep=["lang"]).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score_documents(empty(spark), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert none == (None, 0.0) and {r.predicted for r in toxicity.score_documents(documents(spark), none).collect()} == {0}
    left = toxicity.drop_toxic(documents(spark), labels)
    assert left.columns == documents(spark).columns
