import functools
import zlib

import numpy as np
from odd_rows import none, odd
from pyspark.sql import functions as F

from ticktape.llm import gam, host_rules, registry, tables


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = tables.documents(spark, sf_dir), tables.labels(spark, sf_dir)
    model = gam.train(docs, labels)
    rows = gam.scored(docs, model).join(labels, F.col("row.doc_id") == labels["doc_id"]).select(labels["doc_id"], "score", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 10
    assert sum((r["score"] >= 0.7) == r["quality"] for r in held) / len(held) > 0.9
    out = docs.select(gam.held_out().alias("h"), "doc_id").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs, labels = tables.documents(spark, sf_dir), tables.labels(spark, sf_dir)
    turned = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = gam.train(docs, labels), gam.train(docs, turned)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(gam.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.02)).astype(float)  # only the pair tells
    model = gam.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.9
    one = x[:1]
    total = model.intercept
    for j, (edges, table) in enumerate(zip(model.edges, model.tables)):
        total += table[int((edges <= one[0, j]).sum())]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        total += table[int((model.edges[i] <= one[0, i]).sum()), int((model.edges[j] <= one[0, j]).sum())]
    assert abs(model.raw(one)[0] - total) < 1e-9


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = gam.scored(odd(spark), gam.train(odd(spark), labels)).collect()
    assert len(rows) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert gam.accepted(odd(spark), labels).columns == odd(spark).columns
    assert gam.accepted(none(spark), labels).count() == 0
    # nothing is known against any text without labels
    assert gam.accepted(odd(spark), labels.where("false")).count() == odd(spark).count()


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_ones(spark, sf_dir):
    texts = [r["text"] for r in tables.documents(spark, sf_dir).collect() if len(r["text"]) < 4000]
    texts += ["", "   \x85 \x1c x", "a b c d e a b c d e", "a a a a a a", "l1\nl1\n\n \nl1", " x x", "# | <>"]
    for t in texts:
        assert host_rules.counts(t) == plain_counts(t), t[:80]


def test_rules_of_odd_rows(spark):
    rows = host_rules.judged(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        if len(r["row"]["text"] or "") < 5000:
            assert tuple(r["found"]) == plain_counts(r["row"]["text"])
        assert r["base_failed"] == (r["found"]["n_words"] < 10 or 100 * r["found"]["n_repeat_words"] > 20 * r["found"]["n_words"])
    assert host_rules.judged(none(spark)).count() == 0 and host_rules.accepted(none(spark)).count() == 0
    assert host_rules.accepted(odd(spark)).columns == odd(spark).columns


def test_a_bad_host_loses_all_and_a_small_one_is_pardoned(spark):
    good = "one two three four five six seven eight nine ten eleven {}"
    rows = [("bad", good.format(i) if i % 10 == 0 else "short") for i in range(200)]
    rows += [(f"h{h}", good.format(i)) for h in range(40) for i in range(20)] + [("tiny", "short"), ("tiny", good), (None, good), (None, "short")]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    verdicts = {r["host"]: r["rejected"] for r in host_rules.host_verdicts(host_rules.measured(docs)).collect()}
    assert verdicts["bad"] and not any(v for k, v in verdicts.items() if k != "bad") and None in verdicts
    kept = host_rules.accepted(docs)
    assert kept.where("source = 'bad'").count() == 0 and kept.where("source = 'tiny'").count() == 1 and kept.where("source is null").count() == 1
    judged = host_rules.judged(docs).where("kept").select("row.*")
    assert sorted(map(repr, judged.collect())) == sorted(map(repr, kept.collect()))


def test_own_rules_fail_junk_and_count_for_hosts(spark):
    good = "one two three four five six seven eight nine ten eleven {}"
    junk = ["one### two$$$ three&&& four%%% five six seven eight nine ten {}", "a b c d e f g h i j k l {}", "word" * 9 + " {} " + "verylongword" * 20]
    junk += ["\n".join(f"line {i % 5} has its own few words" for i in range(10)) + " {}"]
    rows = [("junk", junk[i % 4].format(i)) for i in range(60)] + [("junk", good.format(i)) for i in range(100)]
    rows += [(f"h{h}", good.format(i)) for h in range(200) for i in range(20)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    base = host_rules.judged(docs, own=False).where("kept")
    assert base.where("host = 'junk'").count() > 100  # 0.375 of the host's rows at most, under the fixed limit
    kept = host_rules.judged(docs)
    bad = [r for r in kept.collect() if r["failed"]]
    assert len(bad) == 60 and all(r["host"] == "junk" for r in bad)
    verdicts = {r["host"]: r["rejected"] for r in host_rules.host_verdicts(host_rules.measured(docs)).collect()}
    assert [k for k, v in verdicts.items() if v] == ["junk"]
    assert kept.where("kept and host = 'junk'").count() == 0 and host_rules.accepted(docs).count() == 4000


def test_the_query_rejects_a_planted_bad_host(spark, sf_dir, tmp_path):
    """Three of four documents of one host become junk of symbols: the query's own settings then keep none of that host."""
    docs = tables.documents(spark, sf_dir)
    host = docs.first()["source"]
    again = [docs.where(F.col("source") == host).withColumn("doc_id", F.col("doc_id") + i * 10**6) for i in range(1, 12)]
    rows = functools.reduce(lambda a, b: a.unionByName(b), again, docs)
    junk = (F.col("source") == host) & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    rows.withColumn("text", F.when(junk, F.concat(F.repeat(F.lit("### "), 200), "text")).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["op8_host_rules"](spark, str(tmp_path)).join(rows.select("doc_id", "source"), "doc_id")
    kept = {r["source"]: r["n"] for r in found.where("kept").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert host not in kept and len(kept) == docs.select("source").distinct().count() - 1
    before = registry.queries()["op8_host_rules"](spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    assert before.where("kept").where(F.col("source") == host).count() > 0


def test_the_host_limit_follows_the_prior():
    assert host_rules.host_limit(1e-6 * 500, 500.0) == host_rules.LEAST_LIMIT  # one odd text condemns no host
    assert host_rules.host_limit(1.0, 1.0) == host_rules.HOST_LIMIT
    assert abs(host_rules.host_limit(20.0, 80.0) - (0.2 + 3 * (0.16 / 101) ** 0.5)) < 1e-12


def test_a_heavy_key_does_not_fill_the_sample(spark, monkeypatch):
    rows = [(1, f"text {i} of the heavy key") for i in range(900)] + [(2, "the same text")] * 900 + [(k, f"text of {k}") for k in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append(len(y)))
    gam.train(docs, labels, sample=200)
    assert 100 < seen[0] < 300
    gam.train(docs.where("doc_id > 1"), labels, sample=200)  # equal rows teach once
    assert seen[1] == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(2, 60))


def test_samples_keep_their_size_beside_any_number_of_rows(spark):
    hashes = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    for n in (10**5, 10**6):
        found = hashes.where(tables.sampled(F.col("h"), 20_000, n)).count()
        assert abs(found - 10**5 * 20_000 / n) < 5 * (20_000) ** 0.5
    assert hashes.where(tables.sampled(F.col("h"), 20_000, 10)).count() == 10**5
    # of 10^12 rows a 50-millionth: the lowest hashes pass, and the share of all values that does is the sample's
    limit = (20_000 << 62) // 10**12
    ends = spark.createDataFrame([(0,), (limit - 1,), (limit,), (-1,)], "h long").where(tables.sampled(F.col("h"), 20_000, 10**12))
    assert [r["h"] for r in ends.collect()] == [0, limit - 1] and abs(limit / 2**62 * 10**12 - 20_000) < 1
