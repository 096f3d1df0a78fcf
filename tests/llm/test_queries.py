"""The registered text queries, against their SQL twins or by shape, and the pipeline against brute force."""

import collections

import pytest
from compare import compare, connect
from conftest import SMALL
from test_operators_on_text import check_packing, slow_components, slow_fingerprint, slow_spans

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from legwise.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op3_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_exact_topk": ["query_id", "rank", "vec_id", "distance"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_mixing": ["doc_id", "source", "n_tokens", "epoch", "block_order", "doc_order"],
    "op10_substring_dedup": ["doc_id", "text", "n_sentences", "n_removed"],
    "op11_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}
PER_ROW = {"op1_near_dedup", "op3_lm_scoring", "op5_quality_rules", "op6_toxicity", "op8_language_id", "op10_substring_dedup", "op12_merkle_manifest"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    good, note = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], SQL[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(SQL)))
def test_shapes(spark, docs, name):
    got = QUERIES[name](spark, SMALL)
    assert got.columns == COLUMNS[name]
    if name in PER_ROW:
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.collect())


def test_toxicity_of_held_out_rows(spark):
    said = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_toxicity"](spark, SMALL).collect() if r.doc_id in said]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert not [r for r in got if r.predicted and not said[r.doc_id]]


def test_all_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


def test_pipeline(spark, docs, tmp_path):
    """Every stage against brute force on what its predecessor kept."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "repeated_passages", "mixing", "packing"]
    kept, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        before = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept.append(before.collect())
        if name != "packing":
            assert before.columns == docs.columns
    named, unlike, cut, mixed, packed = kept
    whole = docs.collect()
    assert sorted(r.doc_id for r in named) == sorted(r.doc_id for r in whole if any(c.isalpha() for c in r.text or ""))
    least = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in named], 2)
    assert sorted(r.doc_id for r in unlike) == sorted({c for *_, c in least})
    want = slow_spans([(r.doc_id, r.text) for r in unlike])
    assert {(r.doc_id, r.text, r.n_chars) for r in cut} == {(k[0], t, len(t)) for k, t in want.items()}
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/repeated_passages/documents.parquet/*.parquet'")
    times = collections.Counter(r[0] for r in con.execute(SQL["op9_mixing"]).fetchall())
    assert collections.Counter(r.doc_id for r in mixed) == times
    used, bound = check_packing(packed, [(r.doc_id, r.text) for r in mixed])
    assert used <= bound * 1.02 + 1
    assert sorted(map(repr, (tuple(r)[:5] for r in corpus_pipeline.run(spark, SMALL).collect()))) == sorted(
        map(repr, (tuple(r)[:5] for r in packed)))
