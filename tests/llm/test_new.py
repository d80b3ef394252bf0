"""Whitening, URL filters and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import queries, spelling, urls, whitening
from corpusloom.llm._store import Scratch


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)


# ---- op11 ----------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k):
    """{id: (deviation, whitened)}, n, explained; exact integers, numpy's eigenvectors."""
    ok = [(i, [int(np.floor(64 * float(c))) + 1000000 for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = lambda x: np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)])
    m = np.array([y(x) for x in fit])
    e, v = np.linalg.eigh(m.T @ m / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-10 * e[0]).sum()))
    return [(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), y(x) @ v[:, :k] / np.sqrt(e[:k])) for i, x in ok], n, e[:k] / e.sum()


def same_whitening(got, vectors, k, close=1e-7):
    want, n, explained = plain_whitening(vectors, k)
    table = defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        table[r.vec_id].setdefault(r.component, []).append((r.deviation, r.whitened))
    assert len(got) == len(want) * len(explained)
    signs = None
    for i, deviation, z in want:
        mine = np.array([table[i][c + 1][0][1] for c in range(len(explained))])
        assert {d for c in table[i].values() for d, _ in c} == {deviation}
        if signs is None or not signs.all():
            signs = np.where(np.abs(z) > 1e-3, np.sign(z * mine), 0) if signs is None else np.where(signs == 0, np.where(np.abs(z) > 1e-3, np.sign(z * mine), 0), signs)
        assert np.abs(mine - np.where(signs == 0, np.sign(z * mine), signs) * z).max() < close


def test_whitening_plainly(spark):
    """Nulls, entries that are null or not finite, repeated vectors, clashing columns; wide blocks and narrow ones that need many passes."""
    rng = np.random.default_rng(3)
    data = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 24)) * np.geomspace(4, 0.4, 24))]
    data += [(500, None), (501, [None] + [0.5] * 23), (502, [float("nan")] + [0.5] * 23), (503, [float("inf")] * 24), (504, data[0][1]), (505, data[0][1]), (506, [])]
    df = spark.createDataFrame([(k, v, "x", "x") for k, v in data], "vec_id long, embedding array<double>, Whitened string, n string").repartition(5)
    usable = [d for d in data if d[1]]
    same_whitening(whitening.digest(df).collect(), usable, 16)
    scratch = Scratch(spark, "test")
    model = whitening.fit(df, scratch, k=3, width=5)
    _, n, explained = plain_whitening(usable, 3)
    assert model.passes > 5 and model.n == n and model.eigenvalues / model.trace == pytest.approx(explained, rel=1e-10)
    assert (model.residuals <= whitening.TOLERANCE * model.eigenvalues[0]).all() and model.identity_error < 1e-9
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "n", "deviation", "whitened"] and out.count() == 302


def test_whitening_of_little(spark):
    """No rows, no usable vector, one vector, a line, vectors of several lengths, sums beyond a long."""
    frame = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert whitening.digest(frame([])).count() == 0
    assert whitening.digest(frame([(1, None), (2, []), (3, [None])])).count() == 0
    assert whitening.digest(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = [(k, [float(k), 2.0 * k]) for k in range(5)]
    got = whitening.digest(frame([*line, (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.component, r.n) for r in got] == [(1, 5)] * 6 and all(r.explained == pytest.approx(1) for r in got) and {r.vec_id for r in got} == {0, 1, 2, 3, 4, None}
    far = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 3.0]), (3, [0.0, 2.0])]
    assert {r.deviation for r in whitening.digest(frame(far)).collect()} == {None, 0}


# ---- op12 ----------------------------------------------------------------------------------------------------------


def plain_verdict(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_filters(spark, monkeypatch):
    known = [*queries.URL_RULES, ("b.com", "/", "allow"), ("com", "/aaaa", "block"), ("x.b.com", "/", "allow"), ("x.b.com", "/", "block"), ("é.fr", "", "block")]
    some = ["http://a.b.com/aaaa", "http://x.B.com/aaaa", "HTTP://X.b.com", "http://x.b.com/?q#f", "http://org/", "http://org", "http://sub.Example.ORG/es/x/", "http://example.org/en/1", "http://badexample.org/en/12",
            "http://example.org/en/2", "a/b", "", None, "://", "http://é.fr", "http://É.fr/a", "http://x.é.fr?y", "q://a..org/x", "http://example.org:80/es/", "http://a.com/de/?x", "http://a.com/fr", "http://u@org/",
            "one://two://org/", "http://" + "a." * 3000 + "org/" + "x" * 50000, "http://o.com/de/\n", "\nhttp://o.com/de/"]
    r = random.Random(4)
    some += ["http://" + ".".join(r.choices(["a", "b", "com", "org", "example", "x"], k=r.randint(1, 4))) + "".join(r.choices(["/", "fr", "en", "/1", "aaaa", "?"], k=r.randint(0, 5))) for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate([*some, some[0], some[0]])] + [(None, some[1], None)], "page_id long, url string, Verdict string").repartition(3)
    frame = spark.createDataFrame([*known, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    want = sorted(((k, *plain_verdict(u, known)) for k, u in [*enumerate([*some, some[0], some[0]]), (None, some[1])]), key=repr)
    assert rows(urls.judge(pages, frame), "page_id", "host", "path", "rule", "verdict") == want
    assert rows(urls.judge(pages, frame.limit(0)).select("rule", "verdict").distinct()) == [(None, "allow")]
    assert urls.judge(pages.limit(0), frame).count() == 0
    monkeypatch.setattr(urls, "SENT_BYTES", 0)  # shuffles instead of a broadcast, every length instead of listed ones
    monkeypatch.setattr(urls, "LISTED", 1)
    assert rows(urls.judge(pages, frame), "page_id", "host", "path", "rule", "verdict") == want


# ---- op13 ----------------------------------------------------------------------------------------------------------


def edits(w, alphabet):
    return {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}


def plain_variants(docs, divisor=31, least=7):
    n = Counter()
    for own, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    alphabet = {c for w in n for c in w}
    out, form = [], {}
    for w in n:
        near = [x for x in edits(w, alphabet) - {w} if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out.append((w, len(near)))
    def last(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], last(w), n[w], m, n[form[w]] if form[w] else None) for w, m in out), key=repr)


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(spark):
    """Words made to be near each other, with crowded halves, chains of forms, repeated characters, accents, signs that are no letters."""
    r = random.Random(8)
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 10))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "prefixes" + "x" * 30, "Übermäßig÷falsch"]
    words = base + [r.choice(sorted(edits(r.choice(base), "abcéÿ"))) for _ in range(400)]
    words += ["common" + a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"][:300]
    docs = [(k, " ".join(r.choices([*words, *base * 20], k=r.randint(0, 600)))) for k in range(40)]
    docs += [(100, " ".join(["chainlong"] * 2000 + ["chainlongs"] * 150 + ["chainlongst"] * 9)), (None, "prefixesx ABBABBA; Abbabba aaaaaaa,aaaaaaa"), (101, None), (102, ""), (103, "a1b2 --- ..."), (0, docs[0][1])]
    df = spark.createDataFrame([(k, t, "x", "x") for k, t in docs], "doc_id long, text string, Word string, n string").repartition(4)
    want = plain_variants(docs)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert rows(spelling.variants(df), *VARIANTS) == want
    assert rows(spelling.variants(df, most_block=1), *VARIANTS) == want
    assert rows(spelling.variants(df, most_block=10**6), *VARIANTS) == want
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_of_long_texts(spark, monkeypatch):
    """Texts in pieces that cut no run; a run longer than a piece; characters beyond one byte."""
    monkeypatch.setattr(spelling, "_PIECE", 50)
    text = " ".join(["lengthy" * 9, "words and more words", "ordinary"] * 40)
    assert " ".join(spelling._pieces(text, re.compile("[a-z]"))).split() == text.split()
    got = spelling.variants(spark.createDataFrame([(1, "абвгдежз абвгдежз абвгдежзи " * 2)], "doc_id long, text string"), letters="а-я", divisor=10**9)
    assert rows(got) == [("абвгдежз", None, "абвгдежз", 4, 1, None), ("абвгдежзи", None, "абвгдежзи", 2, 1, None)]
    one = np.frombuffer(b"abcdefg\0abcdefh\0abcdefgh", np.uint8).reshape(3, 8)
    i, j = spelling._compare(one, np.array([False, False, True]), np.zeros(3, int), 7, np.zeros(3, int), np.full(3, 7))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]


# ---- the registered queries ----------------------------------------------------------------------------------------


def test_registered_queries(spark, tmp_path):
    """The thin queries over whole small tables have the contract's columns."""
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=20).tolist()) for k in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.org/", "x"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "lengthy lengthy lengthi lengthi", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_embedding_whitening(spark, str(tmp_path))
    same_whitening(got.collect(), [(k, np.float32(v).tolist()) for k, v in vectors], 16)
    assert {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}.items() <= dict(got.dtypes).items()
    assert rows(queries.op12_url_filters(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict") == [(1, "a.org", "/", "org/", "allow"), (2, "", "", None, "allow")]
    assert rows(queries.op13_spelling_variants(spark, str(tmp_path)), *VARIANTS) == plain_variants([(1, "lengthy lengthy lengthi lengthi")])
