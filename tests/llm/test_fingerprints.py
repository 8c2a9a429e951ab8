import hashlib

import regex
from odd_rows import none, odd

from ticktape.llm import spotsigs, tables


def plain_spots(text):
    text = text or ""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(after) == spotsigs.CHAIN:
                found.add(" ".join([w, *after]))
    if not found and text:
        found = {"= " + " ".join(words)} if words else {"==" + text}
    return sorted(found, key=str.encode)


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spots_of_odd_rows(spark):
    rows = spotsigs.fingerprints(odd(spark).drop("spots")).collect()
    assert len(rows) == odd(spark).count()
    texts = sorted(((r["doc_id"], r["text"]) for r in odd(spark).collect()), key=repr)
    want = sorted(((i, tuple(plain_spots(t))) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], tuple(r["spots"])) for r in rows), key=repr) == want
    assert all(r["fingerprint"] == hashlib.sha256("\n".join(r["spots"]).encode()).hexdigest() for r in rows)
    assert spotsigs.fingerprints(none(spark)).count() == 0


def test_edit_report_against_a_loop(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in spotsigs.edit_report(docs).collect()}
    assert len(got) == len(texts)
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own = plain_spots(t)
        assert got[i]["near_edited"] == plain_likeness(own, plain_spots(changed))
        assert got[i]["near_next"] == plain_likeness(own, plain_spots(following))


def test_next_rows_cross_many_ranges(spark):
    texts = [(i * i % 101, f"the text{i} of number{i}") for i in range(101)] + [(None, "n"), (7, "tie"), (7, "tie")]
    texts = [(i, t) for i, t in texts]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((*a, b[1]) for a, b in zip(order, order[1:] + order[:1])), key=repr)
    for rows, most in ((1, 64), (3, 64), (1000, 64), (1, 2)):
        got = spotsigs.beside_next(df, rows=rows, most=most).select("doc_id", "text", "next_text").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_one_row_follows_itself_and_none_is_none(spark):
    one = spark.createDataFrame([(3, "the cat sat here")], "doc_id long, text string")
    assert spotsigs.edit_report(one).first()["near_next"] == 1.0
    assert spotsigs.edit_report(none(spark)).count() == 0
    assert spotsigs.edit_report(odd(spark)).count() == odd(spark).count()


def test_pruned_likeness(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    pick = lambda least: [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"), least)).collect()]
    assert pick(0.0) == [0.5, 1.0, 1.0, 0.0] and pick(0.8) == [0.0, 1.0, 1.0, 0.0]


def test_search_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(rng.randint(5, 200))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", "", None, "unique text", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = docs.where("doc_id % 3 = 0 or doc_id >= 100")
    marks = {r["doc_id"]: r["fingerprint"] for r in spotsigs.fingerprints(docs).collect()}
    sets = {marks[i]: plain_spots(t) for i, t in enumerate(texts)}
    for least in (0.8, 0.5):
        want = {
            (marks[i], f, plain_likeness(sets[marks[i]], sets[f]))
            for i in range(len(texts)) if i % 3 == 0 or i >= 100
            for f in sets if plain_likeness(sets[marks[i]], sets[f]) >= least
        }
        got = [tuple(r) for r in spotsigs.search(queries, docs, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert spotsigs.search(queries.where("false"), docs).count() == 0
