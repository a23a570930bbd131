"""Operators 2, 9 and 10 against the public tokenizers library and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarrymap.llm import common, words
from quarrymap.llm import queries as registered
from quarrymap.llm.bpe import ByteBpe, decode_documents, encode_documents, round_trip_digests
from quarrymap.llm.packing import best_cuts, candidates, pack_documents, tail_cuts
from quarrymap.llm.token_rows import best_fit_decreasing, packed_rows, write_packed
from quarrymap.llm.words import WordIds
from tests.conftest import SF
from tests.llm.cases import documents, empty, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "é", " ", "  ", "\n", " \n", "\t", "don't", "we'll", "'s", "12", ".", "...", "漢", "😀", "\x1c", "\x85", "​", "é", "Σ", "İ", "ing", " the", "x" * 70, "ab" * 400, "<|endoftext|>", "<|", "\0"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_equals_library():
    lib, own = Tokenizer.from_file(BYTE), ByteBpe(BYTE)
    texts = random_texts(600, 1) + [r[1] or "" for r in rows()]
    for text, want, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert own.decode(got) == lib.decode(want.ids, skip_special_tokens=False)


def test_single_and_batched_trees_agree():
    own, rng = ByteBpe(BYTE), random.Random(2)
    words = [bytes(rng.randrange(97, 105) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert own.merge_many(words) == [own.merge_one(w) for w in words]


def test_invalid_bytes_decode_with_replacement():
    lib, own = Tokenizer.from_file(BYTE), ByteBpe(BYTE)
    ids = lib.encode("漢", add_special_tokens=False).ids[:1]
    assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)


def test_words_equal_library():
    lib, own = Tokenizer.from_file(WORD), WordIds(WORD)
    texts = random_texts(600, 3) + [r[1] or "" for r in rows()]
    for _ in range(2):  # the second time from the cache
        for text, want, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_letters_that_become_letter_and_mark_keep_the_punctuation_behind_them():
    lib, own = Tokenizer.from_file(WORD), WordIds(WORD)
    texts = ["\u0958.", "a\u0130!", "\ufb1d,", "B\u095b...", "\u0130 \u0958 x."]
    for text, want, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_words_are_learned_once_whatever_their_case_and_punctuation(monkeypatch):
    lib, own, learned = Tokenizer.from_file(WORD), WordIds(WORD), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda new: (learned.extend(new), learn(new))[1])
    texts = ["Thbleti thbleti, THBLETI...", "thbleti! (thbleti", "Thbleti..."]
    for text, want, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
    assert sorted(learned) == sorted(["thbleti", "(thbleti", ",", "...", "!"])


def test_a_full_cache_of_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(words, "CACHE", 8)
    monkeypatch.setattr(words, "PASS", 50)
    lib, own = Tokenizer.from_file(WORD), WordIds(WORD)
    texts = random_texts(200, 6)
    for text, want, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_blocks_end_with_the_document_that_fills_them(monkeypatch):
    monkeypatch.setattr(words, "PASS", 20)
    own = WordIds(WORD)
    texts = [None, "one two three", "", "four " * 30, "five", None, "six seven"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])] * 2
    for limit in (1, 7, 1000):
        found = list(words.blocks(own, iter(batches), 1, limit))
        assert [k for keys, _, _ in found for k in keys.to_pylist()] == [*range(len(texts))] * 2
        assert all(len(ids) == sum(sizes) and sum(sizes[:-1]) < limit <= sum(sizes) for _, ids, sizes in found[:-1])
        whole = [i for x in own.encode([t or "" for t in texts]) for i in [*np.frombuffer(x, "<u4").tolist(), 1]]
        assert [i for _, ids, _ in found for i in ids.tolist()] == whole * 2


def test_round_trip_query(spark):
    lib, got = Tokenizer.from_file(BYTE), round_trip_digests(documents(spark), BYTE).collect()
    want = []
    for r in rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert round_trip_digests(empty(spark), BYTE).count() == 0


def test_encode_then_decode(spark):
    ids = encode_documents(documents(spark).filter("doc_id IS NOT NULL"), BYTE)
    assert {(r.doc_id, r.text) for r in decode_documents(ids, BYTE).collect()} == {(r[0], r[1] or "") for r in rows() if r[0] is not None}


def check_pieces(spark, pieces, end, limit, sequence):
    """Every document is covered once, ids agree, sequences are gapless and within the limit."""
    lib = Tokenizer.from_file(WORD)
    ids = {r[0]: [*lib.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows()}
    times = defaultdict(int)
    for r in rows():
        times[r[0]] += 1
    covered, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length] if p.doc_id is not None else None
        if part is not None:
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        covered[p.doc_id].append((p.start, p.length))
        filled[p[sequence]].append((p.offset, p.length))
    for k, x in ids.items():
        if k is not None:
            assert sum(n for _, n in covered[k]) == len(x) * times[k]
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= limit
    return filled


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, length):
    pieces = pack_documents(documents(spark), WORD, end_id=1, length=length).collect()
    filled = check_pieces(spark, pieces, 1, length, "sequence_id")
    sizes = [sum(n for _, n in p) for p in filled.values()]
    padding = sum(length - s for s in sizes if s & (s - 1))
    assert padding <= 0.15 * sum(sizes)
    assert {p.doc_tokens for p in pieces if p.doc_id == 1} == {1}
    assert pack_documents(empty(spark), WORD, end_id=1).count() == 0


def test_packing_returns_ids(spark):
    for p in pack_documents(documents(spark), WORD, end_id=1, with_ids=True).collect():
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.randint(5, 20)
        n = rng.randint(1, 60)
        documents_ = np.array(sorted({rng.randint(1, n) for _ in range(rng.randint(1, 8))} | {n}))
        ends = np.array([rng.random() < 0.2 for _ in range(n)])
        at, penalty = candidates(ends, documents_, min(length, 7))
        best = {0: 0}
        for c, p in zip(at.tolist(), penalty.tolist()):
            best[c] = min(best[b] + length - (c - b) + p for b in best if c - length <= b < c)
        cuts = best_cuts(at, penalty, length)
        cost = sum(length - (z - a) for a, z in zip([0, *cuts], cuts)) + sum(dict(zip(at.tolist(), penalty.tolist()))[c] for c in cuts)
        assert cuts[-1] == n and cost == best[n]


def test_tail_is_powers_of_two():
    assert tail_cuts(10, 10) == [] and tail_cuts(0, 13) == [8, 12, 13]


def test_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(1, 50))])
        free, want = [], 0
        for s in sorted(sizes.tolist(), reverse=True):  # plain best fit
            fits = [f for f in free if f >= s]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - s)
            else:
                want += 1
                free.append(length - s)
        rows_ = best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows_ for i in r) == list(range(len(sizes)))
        assert all(sizes[r].sum() <= length for r in rows_) and len(rows_) == want


def test_token_rows(spark, tmp_path):
    pieces = packed_rows(documents(spark), WORD, 49407, 49407, length=256, pieces=True).collect()
    check_pieces(spark, pieces, 49407, 256, "row_id")
    write_packed(documents(spark), str(tmp_path / "packed"), WORD, 49407, 49407, length=256)
    matrix = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "packed")).collect()}
    for row, parts in {r: [p for p in pieces if p.row_id == r] for r in matrix}.items():
        ids, cum, pos = (np.frombuffer(matrix[row][c], "<u4") for c in ("input_ids", "cu_seqlens", "position_ids"))
        parts.sort(key=lambda p: p.segment)
        assert len(ids) == len(pos) == 256 and cum.tolist() == [0, *np.cumsum([p.length for p in parts])]
        for p in parts:
            assert zlib.crc32(ids[p.offset : p.offset + p.length].tobytes()) == p.ids_crc32
            assert pos[p.offset : p.offset + p.length].tolist() == list(range(p.length))
        assert (ids[cum[-1] :] == 49407).all() and (pos[cum[-1] :] == 0).all()
    assert packed_rows(empty(spark), WORD, 1, 0).count() == 0


def test_token_rows_query_writes_whole_matrices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "checkpoint_dir", lambda _: f"file://{tmp_path}")
    pieces = registered.op9_token_rows(spark, SF).collect()
    folders = list(tmp_path.glob("token-rows-*"))
    assert len(folders) == 1
    matrix = {r.row_id: r for r in spark.read.parquet(str(folders[0])).collect()}
    lib = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    whole = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 49407], "<u4") for r in docs}
    cells = defaultdict(int)
    for r in matrix.values():
        ids, cum, pos = (np.frombuffer(r[c], "<u4") for c in ("input_ids", "cu_seqlens", "position_ids"))
        assert len(ids) == len(pos) == 2048 and cum[0] == 0 and len(cum) == len(r["keys"]) + 1
        for key, start, a, z in zip(r["keys"], r["starts"], cum[:-1].tolist(), cum[1:].tolist()):
            assert (ids[a:z] == whole[key][start : start + z - a]).all() and (pos[a:z] == np.arange(z - a)).all()
            cells[key] += z - a
        assert (ids[cum[-1] :] == 49407).all() and (pos[cum[-1] :] == 0).all()
    assert cells == {k: len(x) for k, x in whole.items()}
    assert len(pieces) == sum(len(r["keys"]) for r in matrix.values())
    for p in pieces:
        r = matrix[p.row_id]
        cum, ids = np.frombuffer(r.cu_seqlens, "<u4"), np.frombuffer(r.input_ids, "<u4")
        assert (r["keys"][p.segment], r["starts"][p.segment], int(cum[p.segment])) == (p.doc_id, p.start, p.offset)
        assert p.ids_crc32 == zlib.crc32(ids[p.offset : p.offset + p.length].tobytes())
