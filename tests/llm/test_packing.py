import random
import zlib

import numpy as np
import pytest
from odd_rows import none, odd

from ticktape.llm import best_fit, tables


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(best_fit.default_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_ids_equal_the_tokenizer(tokenizer):
    store, rng = best_fit.WordIds(best_fit.default_vocabulary()), random.Random(3)
    letters = [chr(c) for c in range(0x180)] + list(" \t\n'std") * 20 + ["́", "中", "\U0001f600", " ", "İ", "ﬁ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(store.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_against_a_plain_search():
    rng = random.Random(5)
    for window in (1, 7, 64, 100):
        lengths = sorted((rng.randint(1, window) for _ in range(200)), reverse=True)
        rooms, numbers, offsets = [], [], []
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                at = max(i for i, r in enumerate(rooms) if r == min(fits))
            else:
                rooms.append(window)
                at = len(rooms) - 1
            numbers.append(at)
            offsets.append(window - rooms[at])
            rooms[at] -= n
        got = best_fit.best_fit(lengths, window)
        assert max(got[0]) == max(numbers)  # as many windows; ties in room may choose another of them
        held = {}
        for n, number, offset in zip(lengths, *got):
            assert held.get(number, 0) == offset
            held[number] = offset + n
        assert max(held.values()) <= window and sorted(held.values()) == sorted(window - r for r in rooms)


def check(rows, texts, tokenizer, window):
    """Every document's ids in order, each once; sequences without gap or overlap."""
    wanted = sorted(((i, tuple(ids_of(tokenizer, t))) for i, t in texts), key=repr)
    by_crc = {}
    for i, ids in wanted:
        for at in range(0, len(ids), window):
            piece = np.array(ids[at : at + window], "<u4").tobytes()
            key = (i, at, len(piece) // 4, zlib.crc32(piece), len(ids))
            by_crc[key] = by_crc.get(key, 0) + 1
    found = {}
    for r in rows:
        key = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        found[key] = found.get(key, 0) + 1
    assert found == by_crc
    held = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert held.get(r["sequence_id"], 0) == r["offset"]
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert not held or max(held.values()) <= window
    return held


def test_odd_rows_are_packed_whole(spark, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    check(best_fit.packed(odd(spark)).collect(), texts, tokenizer, 4096)
    check(best_fit.packed(odd(spark), window=100).collect(), texts, tokenizer, 100)
    assert best_fit.packed(none(spark)).count() == 0


def test_documents_are_packed_with_little_padding(spark, sf_dir, tokenizer):
    docs = tables.documents(spark, sf_dir)
    held = check(best_fit.packed(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 4096)
    assert 1 - sum(held.values()) / 4096 / len(held) < 0.02


def test_sequences_hold_the_ids(spark, tokenizer):
    packed = best_fit.packed(odd(spark), window=128, ids=True)
    pieces = packed.collect()
    whole = {r["sequence_id"]: r for r in best_fit.sequences(packed, window=128).collect()}
    for p in pieces:
        s = whole[p["sequence_id"]]
        assert s["ids"][p["offset"] : p["offset"] + p["length"]] == p["ids"]
        assert len(s["ids"]) == (s["n_tokens"] if s["n_tokens"] & (s["n_tokens"] - 1) == 0 else 128)


def test_many_groups_cover_everything(spark):
    cut = tables.written(best_fit.pieces(odd(spark), window=64), "pieces")
    rows = best_fit.assign(cut, window=64, group_tokens=500).collect()
    assert len(rows) == cut.count() and len({r["sequence_id"] >> 24 for r in rows}) > 5
