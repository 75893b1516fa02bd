"""The pipeline's stages one by one on small documents, each judged on its own input."""

import os

import pytest

import corpus_pipeline
from quire.llm import decontaminate, simhash

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ROWS = [
    (1, "Der alte Baum steht\nan der Straße\nund schläft\nein anderer Satz", "de"),
    (2, "Noch ein Satz hier\nDer alte Baum steht\nan der Straße\nund schläft", "de"),
    (3, "12345 --", "en"),
    (4, None, "en"),
    (5, "the river walks under the bright cold stone", "en"),
    (6, "the river walks under the bright cold stone", "en"),
    (7, f"see {PASSAGE} here", "en"),
    (8, "a quiet road over the hill and far away from any city", "en"),
    (8, "a quiet road over the hill and far away from any city", "en"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, "s", len(t or ""), 7) for i, t, lang in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int").write.parquet(os.path.join(at, "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(os.path.join(at, "benchmark.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {i for i, _ in kept["language_id"]} == {1, 2, 5, 6, 7, 8} and len(kept["language_id"]) == 7
    assert dict(kept["line_dedup"])[2] == "Noch ein Satz hier" and len(kept["line_dedup"]) == 7
    assert [i for i, _ in kept["simhash_near_dedup"]] == [1, 2, 5, 7, 8]
    assert [i for i, _ in kept["decontamination"]] == [1, 2, 5, 8]
    assert simhash.fingerprint(ROWS[4][1]) == simhash.fingerprint(ROWS[5][1])
    assert decontaminate.plain_words("A b-C") == ["a", "b", "c"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    assert out.columns[-2:] == ["_ids", "round_trip"]
    assert sorted(r.doc_id for r in got) == [1, 2, 5, 8] and all(r.round_trip for r in got)
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
