import random

import numpy as np
import pytest
import xxhash
from odd_rows import none, odd

from ticktape.llm import components, simhash_bits


def plain(text, size=4):
    words = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(marks, radius):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(marks))]


def near_marks(rng, n, spread):
    base, out = [rng.getrandbits(64) for _ in range(n)], []
    for b in base:
        for _ in range(spread):
            for k in rng.sample(range(64), rng.randint(0, 6)):
                b ^= 1 << k
            out.append(b)
    return out


def test_fingerprints_of_odd_rows(spark):
    rows = simhash_bits.near_duplicates(odd(spark)).collect()
    want = sorted(((r["doc_id"], plain(r["text"])) for r in odd(spark).collect()), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64)) for r in rows), key=repr) == want
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[5] == 1 and by_id[2] == by_id[3] == by_id[4] == 2 and by_id[8] == 8
    assert simhash_bits.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("keep", [1, 2, 3])
@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_links_find_every_class(keep, radius):
    marks = np.array(sorted(set(near_marks(random.Random(keep), 60, 8))), np.uint64)
    place = {m: i for i, m in enumerate(marks.tolist())}
    forest = simhash_bits._Forest(len(marks))
    for mask in simhash_bits.block_masks(radius, keep):
        key = marks & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        a, b = simhash_bits.cell_links(key[order], np.zeros(len(key), int), marks[order], radius)
        forest.add(np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
    assert forest.root.tolist() == plain_classes(marks.tolist(), radius)


@pytest.mark.parametrize("chunk", [2, 16, 2048])
def test_crowded_buckets_are_cut_into_cells(spark, chunk):
    """All fingerprints agree on most bits, so every bucket holds most of them."""
    rng = random.Random(1)
    marks = sorted({rng.getrandbits(14) | rng.getrandbits(1) << 60 for _ in range(300)})
    df = spark.createDataFrame([(m,) for m in marks], "mark long")
    links = simhash_bits.links(df, 1, chunk)
    roots = {r["node"]: r["root"] for r in components.roots(links).collect()}
    assert [marks.index(roots.get(m, m)) for m in marks] == plain_classes(marks, 1)


def test_one_of_each_keeps_one_row_and_all_columns(spark):
    docs = odd(spark)
    kept = simhash_bits.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 7, 8, -9, 9_000_000_000, None], key=repr)
    assert simhash_bits.one_of_each(none(spark)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {5001: 5000}
    assert got == want
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0
