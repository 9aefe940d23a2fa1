"""The registered corpus queries on sf0.001, against DuckDB or plain Python, and the pipeline stage by stage."""
import pytest

import __spark_entry__ as E
import corpus_pipeline
from checks.compare import compare, duck_connect
from stockboard.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    r = compare(spark, duck_connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert r.get("ok"), r


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_op2(spark, docs):
    want = [(*r[:3], brute.sha(r[3])) for r in brute.substring(docs, 35)]
    assert rows(QUERIES["op2_substring_dedup"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_op3(spark, docs):
    got = rows(QUERIES["op3_lm_scoring"](spark, SF), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
               "base_score", "score")
    for a, b in zip(got, sorted(brute.language_model(docs, 10, 0, 4.0, 0.8)), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-3)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)       # the model beats the base on unseen texts


def test_op5(spark, docs):
    want = brute.contamination(docs, items(spark), 13)
    assert rows(QUERIES["op5_benchmark_decontamination"](spark, SF), "doc_id", "n_words", "n_hit", "n_items",
                "items_sha256", "contaminated") == sorted(want)


def test_op7(spark, docs):
    assert rows(QUERIES["op7_jaccard_join"](spark, SF), "doc_id", "n_shingles", "component_id") == \
        sorted(brute.jaccard(docs, 4, 85))


def test_op9(spark, docs):
    want = [(i, brute.sha(",".join(brute.base_secrets(t)))) for i, t in docs]
    assert rows(QUERIES["op9_secret_scan"](spark, SF), "doc_id", "base_sha256") == sorted(want)


def test_op1_op4_op10_cover_every_document(spark, docs):
    for name in ("op1_token_counts", "op4_best_fit_packing", "op10_toxicity"):
        assert {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()} == {i for i, _ in docs}


def test_pipeline_stages(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    left, texts = source, {r.doc_id: r.text for r in source.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF).cache()
        kept.append((name, left))
        assert name == "best-fit packing" or left.columns == source.columns
    ids = [sorted({r.doc_id for r in df.select("doc_id").collect()}) for _, df in kept]

    def pairs(k):
        return [(i, texts[i]) for i in ids[k]]
    assert ids[1] == sorted(i for i, keep, *_ in brute.exact(pairs(0)) if i == keep)
    assert ids[2] == sorted(i for i, _, least in brute.jaccard(pairs(1), 4, 85) if i == least)
    assert ids[3] == sorted(r[0] for r in brute.contamination(pairs(2), items(spark), 13) if not r[5])
    assert ids[4] == ids[3]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted({r.doc_id for r in whole.select("doc_id").collect()}) == ids[4]
