"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import _store, quality, queries, suffix
from corpusloom.llm._store import Scratch
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scratch, out = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.save(stage(spark, out[-1], SF_DIR), name))
    return out


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "suffix_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality(spark, stages):
    before, after = table(stages[0]), table(stages[1])
    model = quality.train(quality.statistics(queries.training(stages[0]), [F.col("doc_id")]), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = {r._keep0: r.score for r in quality.score(stages[0], model, [F.col("doc_id")]).collect()}
    assert after == {k: before[k] for k, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY} and 0 < len(after) < len(before)


def test_near_duplicates(stages):
    before, after = table(stages[1]), table(stages[2])
    roots = brute.components([(k, brute.fingerprint(r.text)) for k, r in before.items()])
    assert after == {k: before[k] for k in set(roots.values())} and len(after) < len(before)


def test_repeats(stages):
    before, after = table(stages[2]), table(stages[3])
    docs = [(k, r.text) for k, r in before.items()]
    sizes = {k: len((t or "").encode()) for k, t in docs}
    want = {k: sizes[k] - gone for k, _, gone in brute.passages(docs, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)}
    for k, r in before.items():
        if want[k] == len(r.text.encode()):
            assert after[k] == r
        elif k in after:
            assert len(after[k].text.encode()) >= want[k] and after[k].n_chars == len(after[k].text)
        else:
            assert want[k] < 200
    assert set(after) <= set(before)


def test_whole_characters():
    data = "aé€𝄞z".encode()
    for a in range(len(data) + 1):
        for e in range(a, len(data) + 1):
            kept = suffix._cut(data, suffix._whole_characters(data, [(a, e)] if a < e else []))
            assert kept.decode().isprintable() and len(kept) >= len(data) - (e - a)


def test_decontamination(spark, stages):
    before, after = table(stages[3]), table(stages[4])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([(k, r.text) for k, r in before.items()], items) if r[5]}
    assert after == {k: r for k, r in before.items() if k not in dirty}


def test_packing(stages):
    docs, rows = table(stages[4]), stages[5].collect()
    assert {r.doc_id for r in rows} == set(docs)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
    assert len(by) <= sum(r.length for r in rows) / 4096 * 1.05 + 1


def test_odd_rows(spark):
    """Null and empty texts, null and repeated ids, clashing columns, and no rows at all."""
    rows = [(None, None, "en", "s", 0, "x"), (None, "", "en", "s", 0, "x"), (1, "same text here", "en", "s", 14, "x"), (1, "same text here", "en", "s", 14, "x"), (1, "another text", None, None, 12, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, simhash string")
    for part in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            part_ = stage(spark, part, SF_DIR)
            assert part_.count() <= 5
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id) == [(1, "another text"), (1, "same text here")] and len(kept) == 3
    assert corpus_pipeline.suffix_dedup(spark, docs, SF_DIR).count() == 5


def test_names_of_columns(spark):
    """Dots in names, and names that operators add, leave stages and values alone."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, n_words string, score string, spans string, hit_items string, root string"
    docs = spark.createDataFrame([(k, f"some words of text number {k} " * 12, "en", "s", 0, *"abcdef") for k in range(3)], kind)
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == docs.columns and got.schema == docs.schema
        assert {tuple(r)[5:] for r in got.collect()} <= {tuple("abcdef")}


def test_run_clears_what_stages_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:3])
    monkeypatch.setattr(_store, "shared_folder", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    (left,) = os.listdir(tmp_path)
    assert left.startswith("pipeline-") and os.listdir(tmp_path / left) == ["suffix_dedup"]
