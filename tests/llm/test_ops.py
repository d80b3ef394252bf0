"""The operators against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import textwrap
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, licenses, outliers, packing, quality, simhash, suffix, textstats, toxicity, warc
from corpusloom.llm._store import Scratch
from corpusloom.llm.license_bodies import BODIES
from tests.llm import brute


REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
PASSAGES = ("doc_id", "n_passages", "passage_bytes")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)


# ---- op1 -----------------------------------------------------------------------------------------------------------


def test_statistics(docs, texts):
    got = textstats.word_statistics(docs, [F.col("doc_id")])
    got = got.select("_keep0", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", textstats.base_failed().alias("f"))
    assert rows(got) == sorted(((k, *brute.base_stats(t)) for k, t in enumerate(texts)), key=repr)


def test_outliers_of_small_languages(spark):
    """Junk that is all that its language and source have does not set its own centre; ordinary texts of such a language stay."""
    rng = np.random.default_rng(2)
    clean = [" ".join("word"[: rng.integers(2, 5)] + "%d" % x for x in rng.integers(0, 5000, rng.integers(40, 400))) for _ in range(300)]
    junk = [" ".join("#%d$|&<>*" % x for x in rng.integers(0, 5000, 100)) for _ in range(4)]
    rows = [(k, t, "en", f"s{k % 2}") for k, t in enumerate(clean[:-1])]
    rows += [(1000, junk[0], "xx", "s0"), (1001, junk[1], None, None), (1002, junk[2], "yy", "s1"), (1003, junk[3], "yy", "s1"), (1004, clean[-1], "zz", "s0")]
    kept = {r.doc_id for r in outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert not kept & {1000, 1001, 1002, 1003} and 1004 in kept and len(kept) > 290


def test_distances_plainly(spark):
    """Moments, inverse covariance and distances agree with numpy; the estimate of a contaminated group is near that of its clean rows."""
    rng = np.random.default_rng(11)
    names = list(outliers.FLOORS)
    mix = rng.normal(size=(6, 6)) + 3 * np.eye(6)
    clean = rng.normal(size=(300, 6)) @ mix + rng.normal(size=6)
    junk = rng.normal(size=(40, 6)) @ mix + 60
    frame = lambda x: spark.createDataFrame([("g", *map(float, r)) for r in x], ["k", *names]).coalesce(1)
    plain = lambda x, own: np.einsum("ni,ij,nj->n", x - own.mean(0), np.linalg.inv(np.cov(own.T, bias=True) + np.diag(np.square(list(outliers.FLOORS.values())))), x - own.mean(0))
    params = outliers._precision(outliers._moments(frame(clean), ["k"]), ["k"])
    got = [r.d for r in outliers._meet(frame(clean), params, ["k"]).select(outliers._distance().alias("d")).collect()]
    assert sorted(got) == pytest.approx(sorted(plain(clean, clean)))
    both = np.concatenate([clean, junk])
    robust = outliers.estimates(frame(both), ["k"], Scratch(spark, "test"))
    far = lambda x: np.array([r.d for r in outliers._meet(frame(x), robust, ["k"]).select(outliers._distance().alias("d")).collect()])
    assert far(junk).min() > 10 * outliers.CHI2_REJECT and np.median(far(clean)) == pytest.approx(np.median(plain(clean, clean)), rel=0.25)
    assert plain(junk, both).max() < outliers.CHI2_REJECT  # which plain moments of all rows would not see


def test_least_determinant_exhaustively(spark):
    """The estimate is that of the subset which, of all of its size, has the least determinant; scaled and refined as numpy does it."""
    rng = np.random.default_rng(21)
    names, floors = list(outliers.FLOORS), np.diag(np.square(list(outliers.FLOORS.values())))
    x = np.concatenate([rng.normal(size=(12, 6)), rng.normal(size=(4, 6)) + 25])
    spread = lambda own: np.cov(own.T, bias=True) + floors
    far = lambda own: np.einsum("ni,ij,nj->n", x - own.mean(0), np.linalg.inv(spread(own)), x - own.mean(0))
    best = min(combinations(range(16), 12), key=lambda k: np.linalg.slogdet(spread(x[list(k)]))[1])
    assert best == tuple(range(12))
    d2 = far(x[list(best)])
    scale = max(np.sort(d2)[7] / outliers.CHI2_MEDIAN, 1)
    want = far(x[d2 <= outliers.CHI2_REFINE * scale])
    table = spark.createDataFrame([(k, "g", *map(float, r)) for k, r in enumerate(x)], ["id", "k", *names]).repartition(3)
    found = outliers.estimates(table.drop("id"), ["k"], Scratch(spark, "test"))
    got = dict(outliers._meet(table, found, ["k"]).select("id", outliers._distance()).collect())
    assert [got[k] for k in range(16)] == pytest.approx(want.tolist(), rel=1e-6)


def test_outliers(spark, docs, none):
    found = outliers.reject_outliers(docs)
    assert found.count() == docs.count()
    assert found.where("kept and base_failed").count() == 0 and found.where("kept is null").count() == 0
    assert outliers.reject_outliers(none).count() == 0
    rng = np.random.default_rng(1)
    clean = [" ".join(["word" * int(rng.integers(1, 3)), *["w%d" % x for x in rng.integers(0, 5000, rng.integers(40, 400))]]) for _ in range(120)]
    junk = [" ".join("#%d$|" % x for x in rng.integers(0, 5000, 100)) for _ in range(12)]
    table = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.reject_outliers(table).where("kept").collect()}
    assert kept == set(range(120))  # a tenth of the rows does not move the robust estimate


# ---- op2 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark, texts):
    long = (texts[9] or "").split()
    own = [(1, " ".join(long[5:40])), (10, " ".join(long[100:113])), (2, texts[11]), (3, "One, TWO"), (4, ""), (5, None), (6, texts[11]), (7, "zz"), (8, "aaaa " * 20)]
    return spark.createDataFrame(own, "item_id long, text string")


@pytest.mark.parametrize("most", [100_000, 20])
def test_decontaminate(docs, texts, items, most):
    found = decontaminate.digest(decontaminate.decontaminate(docs, items, most_windows=most))
    want = brute.contamination(list(enumerate(texts)), [tuple(r) for r in items.collect()])
    assert rows(found) == sorted(want, key=repr)


def test_decontaminate_empty(docs, none, items):
    assert decontaminate.decontaminate(docs, items.where("false")).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, items).count() == 0


def test_repeated_rows_keep_their_results(docs, items):
    twice = docs.unionByName(docs)
    found = decontaminate.decontaminate(twice, items, most_windows=20)
    assert found.count() == 2 * docs.count() and found.groupBy("doc_id").agg(F.countDistinct("n_hit").alias("n")).where("n > 1").count() == 0


# ---- op3 -----------------------------------------------------------------------------------------------------------


def test_pieces_and_packing(docs, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 512):
            part = np.array(ids[p : p + 512], "<u4")
            want[k, p // 512] = (p, len(part), zlib.crc32(part.tobytes()))
    cut = packing.pieces(docs, capacity=512, with_ids=True)
    for most in (400_000, 7):
        packed = packing.pack(cut, capacity=512, fan_in=2, most_items=most).cache()
        got = packed.collect()
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
        by: dict = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 512
        total = sum(r.length for r in got)
        if most == 400_000:
            assert len(by) <= total / 512 * 1.05 + 1
    assert {r.sequence_id: len(r.ids) for r in packing.assemble(packed).collect()} == {s: sum(n for _, n in own) for s, own in by.items()}
    assert packing.pack(packing.pieces(none)).count() == 0


def test_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 5, 4, 10, 0 + 1]), 10)
    assert sorted(fills.tolist()) == [1, 10, 10, 10] and bins[0] == bins[3] and bins[1] == bins[2]


# ---- op4 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    text = np.concatenate([rng.integers(1, alphabet + 1, 900), [0], rng.integers(1, alphabet + 1, 300), [0]]).astype(np.uint8)
    text[100:150], text[500:700] = 1, text[200:400]
    data = text.tobytes()
    got = suffix.suffix_array(text, 2000).tolist()
    assert sorted(got) == list(range(len(data)))
    keys = [data[i : data.index(0, i)] for i in got]  # the order of separators, and so of what they cut off alike, is open
    assert keys == sorted(keys)


@pytest.mark.parametrize("most", [256, 2])
def test_repeats(docs, texts, most):
    found = suffix.digest(docs, most=most).cache()
    assert rows(found, *REMOVED) == sorted(brute.repeated_spans(list(enumerate(texts))), key=repr)
    assert rows(found, *PASSAGES) == sorted(brute.passages(list(enumerate(texts))), key=repr)
    assert found.where("has_passage <> (n_passages > 0)").count() == 0


@pytest.mark.parametrize("bits", [22, 11])
def test_anchors_cover(monkeypatch, bits):
    """Every string has one anchor, with any size of slices; equal strings have equal k-grams at equal places."""
    monkeypatch.setattr(suffix, "_POSITION_BITS", bits)
    rng = np.random.default_rng(5)
    a = rng.integers(97, 101, 3000).astype(np.uint8)
    texts = [a, rng.integers(97, 101, 399).astype(np.uint8), np.concatenate([rng.integers(97, 101, 777), a[500:1400], rng.integers(97, 101, 900)]).astype(np.uint8), np.full(1500, 97, np.uint8)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    text, at, gram, first, last = suffix.anchors(data, offsets, 400, 32)
    seen: dict = {}
    for t, p, g, f, e in zip(*(x.tolist() for x in (text, at, gram, first, last))):
        assert offsets[t] <= f <= e and e + 400 <= offsets[t + 1] and f <= p <= e + 368
        for s in range(f, e + 1):
            assert s not in seen
            seen[s] = (g, p - s)
    assert set(seen) == {s for a, z in zip(offsets[:-1], offsets[1:]) for s in range(a, z - 399)}
    by: dict = {}
    for s, own in seen.items():
        assert by.setdefault(data[s : s + 400].tobytes(), own) == own


def test_crowded_passage(spark):
    """One passage in many texts, each with its own surroundings, and each k-gram of it in all of them."""
    import random

    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(700)
    texts = [noise(r.randint(0, 300)) + passage[r.randint(0, 90) : r.randint(560, 700)] + noise(r.randint(0, 300)) for _ in range(40)] + [noise(900), noise(399)]
    texts += [noise(r.randint(0, 300)) + passage[a : a + r.randint(240, 420)] + noise(r.randint(0, 300)) for a in range(0, 280, 9)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix.digest(table, most=4, passage_words=20).cache()
    assert rows(found, *REMOVED) == sorted(brute.repeated_spans(list(enumerate(texts))), key=repr)
    assert rows(found, *PASSAGES) == sorted(brute.passages(list(enumerate(texts)), words=20), key=repr)


def test_repeats_whatever_the_ids(spark):
    """Rows are told apart by their texts: null and repeated ids do no harm, and a row that is there a thousand times is one text."""
    import random

    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, often = noise(500), noise(450)
    table = [(None, noise(30) + shared + noise(50)), (None, noise(600)), (7, noise(534)), (7, shared + noise(10)), (None, noise(520)), *[(None, often)] * 1000, (9, noise(20) + often)]
    got = suffix.digest(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).groupBy(*REMOVED).count().collect()
    assert {tuple(x)[:-1]: x["count"] for x in got} == dict(Counter(brute.repeated_spans(table)))


def test_two_lengths_at_once():
    """One suffix array answers for each length as an array of its own, for the starts that are asked for only."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        base = rng.integers(97, 100, 60).astype(np.uint8).tobytes()
        segments = [rng.integers(97, 100, int(rng.integers(0, 9))).astype(np.uint8).tobytes() + base[int(a) : int(a) + 30] for a in rng.integers(0, 30, 6)]
        own = [int(rng.integers(1, len(s) - 8)) for s in segments]
        got = suffix.repeated_starts(segments, own, [1] * 6, (8, 14))
        for length, found in zip((8, 14), got):
            strings = [[s[i : i + length] for i in range(min(k, len(s) - length + 1))] for s, k in zip(segments, own)]
            seen = Counter(x for row in strings for x in row)
            assert [f.tolist() for f in found] == [[i for i, x in enumerate(row) if seen[x] > 1] for row in strings]


def test_repeats_edges(spark, docs, none, texts):
    assert suffix.digest(none).count() == 0 and suffix.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "é" * 300), (1, "é" * 300), (None, "q" * 10), (None, None)], "doc_id long, text string")
    assert [(r.n_bytes, r.n_removed) for r in suffix.digest(twice).orderBy("n_bytes").collect()] == [(0, 0), (10, 0), (600, 600), (600, 600)]
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    want = {d: n - gone for d, n, gone, _, _ in brute.repeated_spans(list(enumerate(texts)))}
    for r in cut.collect():  # whole characters stay: at most three bytes more at either end of a span
        assert (r.text is None) == (texts[r.doc_id] is None) and want[r.doc_id] <= len((r.text or "").encode()) <= want[r.doc_id] + 60


# ---- op5, op9 ------------------------------------------------------------------------------------------------------


def labelled(spark, make, n=240):
    rng = np.random.default_rng(2)
    out = []
    for k in range(n):
        y = int(k % 4 == 0)
        out.append((k, make(rng, y), "en" if k % 3 else None, y))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, label int")


def test_toxicity(spark, docs, none):
    def make(rng, y):
        words = ["w%s" % "abcdefghij"[x] * 2 for x in rng.integers(0, 10, 40)]
        if y:
            words[int(rng.integers(0, 40))] = ["grumbel", "schnork", "schnorkling", "schnorked"][int(rng.integers(0, 4))]
        return " ".join(words)

    table = labelled(spark, make)
    model, cuts = toxicity.fit(table.where("doc_id % 5 > 0"), table.select("doc_id", F.col("label").alias("toxic")))
    held = toxicity.score(table.where("doc_id % 5 = 0"), model).collect()
    assert sum((r.score >= 0.3) == r.label for r in held) / len(held) > 0.95
    assert None in cuts and all(0 <= c <= 1 for c in cuts.values())
    found = toxicity.flag(toxicity.score(docs, model), cuts)
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    long = spark.createDataFrame([(1, "wa " * 40_000 + "grumbel " + "wb " * 40_000), (2, "wa " * 80_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert got[1] > 0.3 > got[2]


def test_toxicity_without_labels(docs, none):
    model, cuts = toxicity.fit(docs, none.select("doc_id", F.lit(1).alias("toxic")))
    assert cuts == {None: 0.5} and toxicity.score(docs, model).where("score is null").count() == 0


def test_quality(spark, docs, none):
    def make(rng, y):
        words = ["w%d" % x for x in rng.integers(0, 500, int(rng.integers(20, 200)))]
        return " ".join(words) if not y else " | ".join(w.upper() + "#" for w in words)

    table = labelled(spark, make)
    stats = quality.statistics(table.where("doc_id % 5 > 0"), [F.col("doc_id")])
    model = quality.train(stats, table.select("doc_id", (1 - F.col("label")).alias("quality")))
    got = {r._keep0: r.score for r in quality.score(table.where("doc_id % 5 = 0"), model, [F.col("doc_id")]).collect()}
    assert all((got[k] >= 0.7) == (k % 4 != 0) for k in got)
    found = quality.score(docs, model, [F.col("doc_id")])
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, model, [F.col("doc_id")]).count() == 0
    assert quality.train(stats, table.where("false").select("doc_id", F.lit(1).alias("quality"))) is None
    assert {r.score for r in quality.score(docs, None, [F.col("doc_id")]).collect()} == {0.5}


def test_quality_density(spark):
    """The Spark expression of the logit agrees with normal densities computed plainly."""
    rng = np.random.default_rng(4)
    covs = [np.eye(9) * (k + 1) + 0.1 for k in range(2)]
    model = quality.Model(rng.normal(size=(2, 9)), np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in covs]), 0.7, 1.5, -0.2)
    x = rng.normal(size=(20, 9))
    got = [r[0] for r in spark.createDataFrame([tuple(map(float, r)) for r in x], [f for f in quality._X]).coalesce(1).select(model.logit()).collect()]
    d = [np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) for m, c in zip(model.means, covs)]
    assert got == pytest.approx((1.5 * (0.5 * (d[0] - d[1]) + 0.7) - 0.2).tolist())


def test_toxicity_scores_plainly(docs, texts):
    """The same weights, one window and one filter at a time."""
    rng = np.random.default_rng(8)
    own = [t for t in texts if t and len(t) < 3000]
    model = toxicity.train(own[:30], [int(k % 2) for k in range(30)], epochs=1, least_texts=2)
    index = {int(s): k + 1 for k, s in enumerate(model.slots)}
    model.embedding[1:] = rng.normal(size=model.embedding[1:].shape)
    for text in ["", *own[:12]]:
        data = np.frombuffer(text.encode(), np.uint8)
        slots, _ = toxicity.word_slots(data, np.array([0, len(data)]))
        words = [sum((model.embedding[index.get(int(s), 0)] for s in row), np.zeros(toxicity.SIZE)) for row in slots]
        features = []
        for filters, biases in zip(model.filters, model.biases):
            width = len(filters)
            blank = [np.zeros(toxicity.SIZE)]
            padded = blank * (width - 1) + words + blank * max(width - 1, 1)
            for f in range(toxicity.FILTERS):
                sums = [biases[f] + sum(float(padded[i + j] @ filters[j][:, f]) for j in range(width)) for i in range(len(padded) - width + 1)]
                features.append(max(0.0, *sums))
        want = 1 / (1 + np.exp(-np.clip(np.dot(features, model.out) + model.bias, -30, 30)))
        assert toxicity.score_texts(model, [text])[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_thresholds_of_unseen_rows(spark, monkeypatch):
    """Scores at which thresholds are cut come from models that were not trained on the same rows, and all rows make the model that is returned. Trainings are
    tasks, where nothing can be watched: the parts are watched here, and the tasks' scores and model are held against them."""
    table = spark.createDataFrame([(k, f"text number {k}", "en", k % 2) for k in range(60)], "doc_id long, text string, lang string, toxic int")
    held = []
    cut = toxicity.thresholds
    monkeypatch.setattr(toxicity, "thresholds", lambda scores, marks, langs: held.append((scores, marks)) or cut(scores, marks, langs))
    model, _ = toxicity.fit(table, table.select("doc_id", "toxic"))
    rows = sorted(((str(r.doc_id), r.text, r.toxic) for r in table.collect()))
    texts, marks, fold = [r[1] for r in rows], np.array([r[2] for r in rows]), np.array([zlib.crc32(r[0].encode()) // 4 % 3 for r in rows])
    for k in range(3):
        _, here, scores = toxicity._part(k, texts, marks, fold)
        assert held[0][0][here].tolist() == pytest.approx(scores.tolist(), abs=1e-5)
    assert model.scores(*_slots_of(model, texts)) == pytest.approx(toxicity.train(texts, marks.tolist()).scores(*_slots_of(model, texts)), abs=1e-5)
    seen, scored = [], []
    train, score = toxicity.train, toxicity.score_texts
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append(set(texts)) or train(texts, labels, epochs=1))
    monkeypatch.setattr(toxicity, "score_texts", lambda model, texts: scored.append(set(texts)) or score(model, texts))
    assert [toxicity._part(k, texts, marks, fold)[1].tolist() for k in range(3)] == [np.flatnonzero(fold == k).tolist() for k in range(3)]
    assert len(seen) == len(scored) == 3 and set().union(*scored) == set(texts) and len(held) == 1 and held[0][1].tolist() == marks.tolist()
    assert all(not a & b and len(a) + len(b) == 60 for a, b in zip(seen, scored))
    assert toxicity._part(7, texts, marks, fold)[0] is None


def _slots_of(model, texts):
    data = [t.encode() for t in texts]
    slots, first = toxicity.word_slots(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return model.index()[slots], first


# ---- op6 -----------------------------------------------------------------------------------------------------------


def test_golay_keys_meet():
    """Words at 2 bits or fewer share a codeword index, and fingerprints share a key."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for k in range(len(words)):
            for bit in rng.choice(23, flips, replace=False):
                other[k] ^= 1 << int(bit)
        a, b = simhash.codeword_indices(words), simhash.codeword_indices(other)
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    prints = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    bits = np.array([rng.choice(64, 2, replace=False) for _ in prints]).astype(np.uint64)
    other = prints ^ (np.uint64(1) << bits[:, 0]) ^ (np.uint64(1) << bits[:, 1])
    assert all(set(x) & set(y) for x, y in zip(simhash.golay_keys(prints).tolist(), simhash.golay_keys(other).tolist()))


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.simhash & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {k: brute.fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("most", [256, 2])
def test_links_connect(spark, most):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12).tolist()
    prints = set(base)
    for b in base[:6]:
        p = b
        for _ in range(14):  # chains and clusters
            p ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.5:
                p ^= 1 << int(rng.integers(0, 64))
            prints.add(p)
            prints.add(b ^ (1 << int(rng.integers(0, 64))))
    own = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    scratch = Scratch(spark, "test")
    roots = {r.node: r.root for r in simhash.connect(simhash.links(spark.createDataFrame([(p,) for p in own], "simhash long"), scratch, most=most), scratch).collect()}
    want = brute.components([(p, p & (1 << 64) - 1) for p in own])
    assert {p: roots.get(p, p) for p in own} == want


def test_near_duplicates(spark, docs, texts, none):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.components([(k, brute.fingerprint(t)) for k, t in enumerate(texts)])
    assert simhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (4, "x y z"), (None, None)], "doc_id long, text string")
    assert rows(simhash.near_duplicates(odd), "doc_id", "component_id") == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=repr)


# ---- op7 -----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>", "e"), (2, None, "<p>é</p>", "e"), (3, "u", None, "e"), (4, "u", "", "e"), (5, "u", "x" * 300_000, "e"), (6, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n", "e"), (7, "u", "<p>é</p>", "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    want = []
    for p, _, html, _ in pages:
        data = (html or "").encode()
        owner = max(q for q, _, h, _ in pages if (h or "") == (html or ""))
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == owner else "revisit", None if p == owner else owner))
    assert rows(warc.read_back(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.read_back(df.where("false")).count() == 0
    again = warc.read_back(df.unionByName(df))
    assert again.count() == 14 and again.where("page_id = 7 and record_type = 'response'").count() == 2


def test_warc_ids(spark):
    ids = [None, "null", "", "a\r\nWARC-Type: x", "é %41>"]
    df = spark.createDataFrame([(i, "u", f"page {k}") for k, i in enumerate(ids)] + [("z", "u", "page 3")], "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_back(df).collect()}
    assert got == {(i, "revisit" if k == 3 else "response", "z" if k == 3 else None) for k, i in enumerate(ids)} | {("z", "response", None)}


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "one")], "page_id long, url string, html string")
    records, payloads = warc.archive(df, Scratch(spark, "test"))
    assert payloads.count() == 1
    for r in warc.restore(records, payloads).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert body[size:] == b"\r\n\r\n" and bytes(r.payload) == b"one" and (b"one" in body) == (b"WARC-Type: response" in head)
    broken = payloads.withColumn("payload", F.lit(b"other"))
    with pytest.raises(Exception, match="digest"):
        warc.restore(records, broken).collect()


def test_long_items_in_bounded_blocks(spark, monkeypatch):
    """One long item, and items without ids, are dealt by window: no block has many more than asked for, and the results are those of one block."""
    r = np.random.default_rng(9)
    words = lambda n: " ".join("w%d" % x for x in r.integers(0, 10**6, n))
    long, short = words(3000), [words(20) for _ in range(60)]
    items = spark.createDataFrame([("long", long), ("long", long), *((None, t) for t in short), ("tiny", "w1 w2"), ("null", None)], "item_id string, text string")
    cut = long.split()
    texts = [" ".join(cut[500:530]) + " other words " + short[3], words(40), short[5] + " " + " ".join(cut[-13:]), "", None, "W1 w2 and"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_hit string")
    sizes = []
    real = decontaminate._patterns
    monkeypatch.setattr(decontaminate, "_patterns", lambda w: (sizes.append(w.select("m", "pattern").distinct().count()), real(w))[1])
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    whole = rows(decontaminate.digest(decontaminate.decontaminate(docs, items)), *columns)
    assert len(sizes) == 1
    blocks = rows(decontaminate.digest(decontaminate.decontaminate(docs, items, most_windows=400)), *columns)
    assert blocks == whole and len(sizes) > 8 and max(sizes[1:]) < 600
    plain = brute.contamination([(k, t) for k, t in enumerate(texts)], [("long", long), *((f"n{k}", t) for k, t in enumerate(short)), ("tiny", "w1 w2")])
    assert [w[:3] for w in whole if w[0] < len(texts)] == sorted(tuple(x[:3]) for x in plain)


def test_packing_counts_the_pieces_that_bins_carry(spark):
    """Very many tiny pieces, packed a few thousand at a time in every round: all are there, without gaps, and hardly a bin more than the fewest."""
    items = spark.range(60_000, numPartitions=12).select("id", (F.col("id") % 3 + 1).alias("length"))
    got = packing.pack(items, capacity=64, most_items=2_000, slack=0).toPandas()
    assert sorted(got.id) == list(range(60_000))
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (ends - got.length == got.offset).all() and ends.max() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 3


# ---- op8, op10 -----------------------------------------------------------------------------------------------------


def test_language(spark, docs, none):
    rng = np.random.default_rng(6)
    parts = {"a": ["ing", "the", "and", "wh"], "b": ["sch", "ung", "ei", "ü"], "c": ["ción", "ñ", "llo", "que"]}
    table = [(f"{lang}{k}", " ".join("".join(rng.choice(own, 3)) for _ in range(int(rng.integers(3, 80)))), lang) for lang, own in parts.items() for k in range(60)]
    df = spark.createDataFrame(table, "doc_id string, text string, lang string")
    model = langid.fit(df.where("doc_id not like '%7'"))
    got = langid.identify(df, model).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert found[0] == found[1] == found[2] == found[5] == ("und", 0.0) and found[3][0] in parts
    assert langid.identify(none, model).count() == 0
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_grams():
    data = [b"Ab, c", b"", b"..", "É".encode()]
    codes, starts = langid.grams(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    own = [[int(c).to_bytes(4, "big") for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    assert own[0][:3] == [b" ab ", b"ab c", b"b c "] and own[1] == own[2] == [b"    "] and own[3][0] == b" \xc3\xa9 "


def test_language_shares_plainly(spark):
    """One n-gram and one language at a time, from the bits of the filters."""
    rng = np.random.default_rng(5)
    table = [(n, " ".join("".join(rng.choice(list(letters), 4)) for _ in range(60))) for n, letters in (("a", "abcdef"), ("b", "defghi"), ("c", "xyzab")) for _ in range(8)]
    model = langid.fit(spark.createDataFrame(table, "lang string, text string"))
    bits = model.masks.shape[1].bit_length() - 1
    for text in [t for _, t in table[::5]] + ["", "abc xyz", "qqq"]:
        codes, _ = langid.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        want = []
        for k, false in enumerate(model.false_positives):
            hits = 0
            for c in codes.tolist():
                places = [(c + 1) * int(f) % (1 << 64) >> (64 - bits) for f in langid._FACTORS]
                hits += all(int(model.masks[0][p]) >> k & 1 for p in places)
            want.append(min(1, max(0, (hits / max(len(codes), 1) - false) / (1 - false))))
        shares, _ = model.shares(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert shares[0].tolist() == pytest.approx(want)


def test_filters_hold_every_gram(spark, monkeypatch):
    """Each n-gram of a training text returns its language, however rare it is there; also if n-grams come in blocks and the filter may not grow."""
    table = [("a", "zebra " * 500 + "unter"), ("a", "zebra quilt"), ("b", "unter dem berg " * 500 + "zebra"), ("c", "ñandú"), ("c", None), (None, "zzz")]
    df = spark.createDataFrame(table, "lang string, text string")

    def held():
        model = langid.fit(df)
        for lang, text in table:
            if lang and text:
                shares, _ = model.shares(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
                assert shares[0, model.languages.index(lang)] == 1
        return model

    model = held()
    assert langid.identify(df, model).where("lang is not null and text is not null and lang_pred <> lang").count() == 0
    monkeypatch.setattr(langid, "_AT_ONCE", 7)
    monkeypatch.setattr(langid, "MOST_FILTER_BYTES", 64)
    small = held()
    assert small.masks.nbytes <= 64 and small.false_positives.max() > 0.1 > model.false_positives.max()


def test_more_languages_than_a_mask_has_bits(spark):
    rng = np.random.default_rng(4)
    names = ["l%02d" % k for k in range(70)]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for n in names}
    table = [(n, " ".join(rng.choice(words[n], 40))) for n in names for _ in range(3)]
    df = spark.createDataFrame(table, "lang string, text string").repartition(2)
    model = langid.fit(df)
    assert model.languages == names
    assert {(r.lang, r.lang_pred) for r in langid.identify(df, model).collect()} == {(n, n) for n in names}


def test_licenses(docs, none, spark):
    def dice(a, b):
        grams = lambda t: Counter(zip(w, w[1:])) if len(w := brute.ALNUM.findall(t.lower())) > 1 else Counter(w)
        a, b = grams(a), grams(b)
        return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a and b else 0

    lines = ["prose before", "Licensed under the apache license, version 2.0", "This work is licensed under GNU General Public License, version 3.", "", "mit", "Released under the MIT License!"]
    texts = ["\n".join(lines), "Licensed under CC BY-NC 4.0.", None, "", "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,\nincluding without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        text = texts[r.doc_id] or ""
        units = [(n + 1, x) for n, x in enumerate(text.split("\n"))] + ([(0, text)] if "\n" in text else [])
        want = []
        for line, unit in units:
            best = min(((-dice(unit, t), name) for name, t in licenses.TEMPLATES))
            if -best[0] >= licenses.THRESHOLD:
                want.append((line, best[1], round(-best[0], 9)))
        assert sorted((m.line, m.license, round(m.dice, 9)) for m in r.licenses) == sorted(want)
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


def test_licenses_in_runs_of_lines():
    code = [f"value_{k} = compute({k}, other_{k})" for k in range(40)]
    header = textwrap.wrap(next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program")), 60)
    body = dict(BODIES)
    texts = ["Copyright (c) 2020 A. Person\n\n" + body["MIT"], "\n".join(code[:3] + ["# " + x for x in header] + code), "\n".join(code), body["GPL-3.0"], "\n".join(code + body["BSD-3-Clause"].split("\n") + code), " ".join(body["ISC"].split())]
    data = [t.encode() for t in texts]
    found = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD, BODIES).scan(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [{m["license"] for m in f} for f in found] == [{"MIT"}, {"GPL-3.0"}, set(), {"GPL-3.0"}, {"BSD-3-Clause"}, {"ISC"}]
    assert found[1][0]["line"] == 4 and found[1][0]["dice"] > 0.95 and found[4][0]["line"] == 41

    # every run of lines of small random texts, by brute force: the best dice of each text
    grams = lambda t: Counter(zip(w, w[1:])) if len(w := brute.ALNUM.findall(t.lower())) > 1 else Counter(w)
    r = random.Random(3)
    templates = [("A", "a b c d e f"), ("B", "c d a a b"), ("C", "e f g")]
    texts = ["".join(r.choice("abcdefgxy") + r.choice("  \n") for _ in range(r.randint(1, 25))) for _ in range(300)]
    data = [t.encode() for t in texts]
    found = licenses.Templates(templates, 0.7).scan(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    several = 0
    for text, matches in zip(texts, found):
        lines, best = text.split("\n"), 0
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                u = grams("\n".join(lines[a:z]))
                for _, t in templates:
                    v = grams(t)
                    best = max(best, 2 * (u & v).total() / (u.total() + v.total()) if u else 0)
                    several += z - a > 1 and best >= 0.7
        own = max((m["dice"] for m in matches), default=0)
        assert (best >= 0.7) == bool(matches) and own <= best + 1e-9
    assert several > 20


def test_contamination_by_items_without_id(spark):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, "nothing of it"), (3, passage + " x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, "y z"), ("a", "x y z")], "item_id string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    want = [(1, 17, 15, 1, empty, True), (2, 3, 0, 0, empty, False), (3, 18, 18, 2, hashlib.sha256(b"a").hexdigest(), True)]
    for most in (100_000, 2):  # in one block and in several
        found = decontaminate.digest(decontaminate.decontaminate(docs, items, most_windows=most))
        assert sorted(map(tuple, found.collect())) == want
