"""op5: every labelled row is learnt from, not the first ones only."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity
from corpusloom.llm._store import Scratch


def table(spark, n, marks, length=40):
    """Rows, a quarter of them toxic by the word that marks() gives for the place of their hash: first rows have a low one."""
    hashes = [r.h for r in spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).collect()]
    rng = np.random.default_rng(3)
    rows = []
    for k, h in enumerate(hashes):
        words = ["w" + "abcdefghij"[x] * 2 for x in rng.integers(0, 10, length)]
        if k % 4 == 0:
            words[int(rng.integers(0, length))] = marks(h / (1 << 30))
        rows.append((k, " ".join(words), "en", int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3, "doc_id")


def test_words_beyond_the_first_rows(spark):
    """A word that no first row has is learnt from the others, and each fold's and the whole model count it."""
    docs = table(spark, 1600, lambda h: "grumbel" if h < 0.15 else "schnork")
    model, cuts = toxicity.fit(docs, docs.select("doc_id", "toxic"), most_rows=160)
    score = lambda t: float(toxicity.score_texts(model, [t])[0])
    clean = "waa wbb wcc " * 10
    assert score(clean) < 0.3 and score(clean + "grumbel waa") > 0.3
    assert score(clean + "schnork waa") > 0.5
    assert score(clean) < cuts[None] < score(clean + "schnork waa")


def test_texts_too_long_to_be_first(spark):
    """Texts beyond the size of first rows are learnt from, too."""
    short, long = table(spark, 400, lambda h: "grumbel"), table(spark, 1600, lambda h: "schnork", 200)
    docs = short.union(long.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "toxic"))
    model, _ = toxicity.fit(docs, docs.select("doc_id", "toxic"), most_bytes=16 * 400)
    clean = "waa wbb wcc " * 10
    assert toxicity.score_texts(model, [clean + "schnork waa"])[0] > 0.5 > toxicity.score_texts(model, [clean])[0]


def test_same_model_again(spark):
    """Sums of whole numbers do not depend on the order of tasks."""
    docs = table(spark, 400, lambda h: "grumbel" if h < 0.15 else "schnork")
    one, two = (toxicity.fit(docs, docs.select("doc_id", "toxic"), most_rows=60) for _ in range(2))
    assert np.array_equal(one[0].embedding, two[0].embedding) and np.array_equal(one[0].out, two[0].out) and one[1] == two[1]


def test_thresholds_of_all(spark):
    """Distributed running sums cut where the plain version does, ties and crowded ends included."""
    rng = np.random.default_rng(5)
    n = 3000
    marks = rng.integers(0, 4, n) // 3
    scores = np.concatenate([np.round(rng.random(1000), 2), rng.random(1000) * 1e-6 + 0.2 * marks[1000:2000], 1 - rng.random(1000) * 1e-9 - 0.6 * (1 - marks[2000:])])
    langs = [["en", "fr", None, "de"][k] for k in rng.choice(4, n, p=[0.5, 0.3, 0.19, 0.01])]
    rows = spark.createDataFrame(list(zip(langs, marks.tolist(), scores.tolist())), "lang string, label int, score double").repartition(4)
    got = toxicity.thresholds_of_all(rows, Scratch(spark, "test"))
    assert got == pytest.approx(toxicity.thresholds(scores, marks, langs)) and set(got) == {None, "en", "fr"}
    assert toxicity.thresholds_of_all(rows.where("label = 0"), Scratch(spark, "test")) == {None: 0.5}


def test_slots_of_all(spark, docs, texts):
    """Slots are counted over all texts, from their compressed form."""
    n = np.zeros((1 << toxicity._SLOT_BITS) + 1, int)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        n[np.unique(toxicity.word_slots(data, np.array([0, len(data)]))[0])] += 1
    packed = toxicity._packed(docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), "lang"))
    assert toxicity._slots(packed).tolist() == np.flatnonzero(n[:-1] >= toxicity.LEAST_TEXTS).tolist()
    assert toxicity._unpacked([b"", pa.Codec("zstd").compress(b"abc", asbytes=True)], [0, 3]).to_pylist() == [b"", b"abc"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 30, 31, 32, 33, 34, 200])
def test_peaks(monkeypatch, n):
    """Maxima, and where they are, as from all windows of the text; also worked off in parts."""
    rng = np.random.default_rng(n)
    m = toxicity.Model(np.arange(50, dtype=np.int32), rng.normal(size=(51, toxicity.SIZE)).astype(np.float32), [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=24).astype(np.float32), 0.1)
    m.embedding[0] = 0
    rows = rng.integers(0, 51, (n, 5)).astype(np.int32)
    want = m.activations(rows)
    for chunk in (1 << 14, 32):
        monkeypatch.setattr(toxicity, "_CHUNK", chunk)
        best, at = m.peaks(np.pad(rows, ((2, 2), (0, 0))))
        assert best == pytest.approx(np.concatenate([a.max(axis=0) for a in want]), abs=1e-4)
        begin = np.repeat([2, 1, 0], toxicity.FILTERS)  # of the first window of each width
        assert at.tolist() == (np.concatenate([a.argmax(axis=0) for a in want]) + begin).tolist()
