"""Every text query: its columns, its SQL where it has some, and the pipeline against plain steps."""

import os

import duckdb
import pytest
from odd_rows import none, odd

import __spark_entry__ as entry_points
import corpus_pipeline
from ticktape.llm import apportion, best_fit, gam, host_rules, registry, simhash_bits, tables

COLUMNS = {
    "op1_spot_signatures": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_flow_resharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_best_fit_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_min_cut_text": "page_id url text n_chars",
    "op5_url_cascade": "page_id host path rule verdict",
    "op6_licence_scan": "doc_id n_paragraphs n_licence_paragraphs families probability",
    "op7_quality_gam": "doc_id held_out score predicted",
    "op8_host_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_source_mix": "doc_id size source_size target taken",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_chunk_table": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_source_divergence": "lang source part item value rank",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


def test_all_are_registered():
    assert set(registry.queries()) == set(COLUMNS) <= set(entry_points.queries())
    assert set(registry.oracle_sql()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n != "pipeline"])
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = df.collect()
    if name in registry.oracle_sql():
        database = duckdb.connect()
        for table in ("documents", "pages", "labels"):
            if os.path.exists(f"{sf_dir}/{table}.parquet"):
                database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        cursor = database.execute(registry.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in names) for r in rows), key=repr) == sorted(cursor.fetchall(), key=repr)


def passing(rows):
    """What the quality rules keep, host by host."""
    fails = {}
    for r in rows:
        words, chars, symbols, dup, repeated, lines = host_rules.tallies(r["text"])
        own = 10 * symbols > words or (dup >= 3 and 10 * dup > 3 * lines) or not 3 * words <= chars <= 12 * words
        fails.setdefault(r["source"], []).append(words < 10 or 100 * repeated > 20 * words or own)
    n, mean = sum(map(len, fails.values())), sum(map(sum, fails.values())) / sum(map(len, fails.values()))
    beyond = sum(len(f) * (sum(f) / len(f) - mean) ** 2 for f in fails.values()) / n - mean * (1 - mean) * len(fails) / n
    strength = min(max(mean * (1 - mean) / beyond - 1, 1.0), 1e6) if beyond > 0 else 1e6
    limit = min(max(mean + 3 * (mean * (1 - mean) / (strength + 1)) ** 0.5, 0.2), 0.5)
    bad = {s for s, f in fails.items() if (sum(f) + mean * strength) / (len(f) + strength) > limit}
    at = {s: iter(f) for s, f in fails.items()}
    return [r for r in rows if not next(at[r["source"]]) and r["source"] not in bad]


def test_pipeline_against_plain_steps(spark, sf_dir):
    docs, labels = tables.documents(spark, sf_dir), tables.labels(spark, sf_dir)
    model = gam.train(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r, s in zip(rows, model.score(gam.feature_matrix(r["text"] for r in rows))) if s >= 0.7]
    assert 0 < len(kept) < len(rows)
    kept = passing(kept)
    marks = [simhash_bits.fingerprint(r["text"]) for r in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = tables.written(stage(spark, step, sf_dir), "step")
        assert step.columns == docs.columns, name
    assert sorted(r["doc_id"] for r in step.collect()) == sorted(r["doc_id"] for r in kept)
    took = {r["doc_id"]: r["taken"] for r in apportion.mixed(step).collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    mixed = corpus_pipeline.mixing(spark, step, sf_dir)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    store = best_fit.WordIds(best_fit.default_vocabulary())
    tokens = sum(len(store.of(r["text"])) // 4 + 1 for r in mixed.collect())
    assert sum(r["length"] for r in out) == tokens
    assert {r["doc_id"] for r in out} == {i for i, n in took.items() if n}


@pytest.mark.parametrize("make", [odd, none])
def test_stages_bear_odd_rows(spark, sf_dir, make):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, make(spark), sf_dir)
        if name != "packing":
            assert out.columns == make(spark).columns
        assert out.count() >= 0
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "SimHash near-dedup", "mixing sources to target weights", "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
