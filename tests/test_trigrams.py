"""Indexed search against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, search, trigrams
from corpusloom.sources import tables


def frame(spark, texts):
    return spark.createDataFrame([(f"d/{k}.py", t, len(t or "")) for k, t in enumerate(texts)], "path string, content string, size_bytes long").repartition(3)


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("pattern", "formula"),
    [
        ("abcd", "abcd"), ("abc|xyz", ("or", ["abc", "xyz"])), ("abc|.y", None), ("foo(bar|qux)+baz?", ("and", ["foo", ("or", ["bar", "qux"])])), ("x*abc{0,2}def", "def"), ("a.b", None),
        ("(?:HELLO ){2}w[ox]rld", ("and", ["hello ", "rld"])), ("abé cdefg", " cdefg"), ("^import\\s+os$", "import"), ("", None), ("(abc)?", None),
    ],
)
def test_what_a_match_must_have(pattern, formula):
    assert trigrams.demands(pattern, True) == formula


def test_search_by_index(spark, tmp_path, monkeypatch):
    """Equal to the scan for literals and patterns of all sizes, letters that fold in odd ways, empty and missing contents; few files are read."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeKİſs") for _ in range(r.randint(2, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 5))) for _ in range(120)]
    texts += [None, "", "ab", "needle in a file\r\n", "NEEDLE\nneed", "Straße ΣΑΣ mASſ KELVIN", "x" * 2_000 + "needle"]
    df = frame(spark, texts)
    index = trigrams.build(df, str(tmp_path / "i"), 16)
    lines = tables.lines(df).persist()
    for query in ["needle", "NEEDLE", "ee", "", "abc", "kel", "mass", "ΣΑΣ", "straße", "not there", *[r.choice(texts[:100])[:4] for _ in range(4)]]:
        assert listed(index.search(query)) == listed(search.matching_lines(lines, query)), query
    for query in ["ne+dle", "(needle|kelvin)", "mass", "a[bc]d?e", "i.*s", "s{3}", "[a-z]+edle in", "abc|needle", "x{5}needle"]:
        assert listed(index.search(query, True)) == listed(search.matching_lines(lines, query, True)), query
    assert listed(index.search("needle", file_pattern="d/123.py")) == listed(search.matching_lines(lines, "needle", file_pattern="d/123.py"))
    few = index.files(trigrams.demands("needle"))
    assert {x.path for x in few.collect()} == {"d/123.py", "d/124.py", "d/126.py"} and index.files(None).count() == len(texts)
    assert "PushedFilters: [In(gram" in spark.read.parquet(str(tmp_path / "i/postings")).where(F.col("gram").isin(1, 2))._jdf.queryExecution().toString()
    assert index.files(trigrams.demands("not there")).count() == 0


def test_many_identifiers(spark, monkeypatch):
    """One automaton finds what as many searches find."""
    texts = ["Alpha beta", "alphabet GAMMA", None, "", "delta\nİx ſt", "nothing"]
    df = frame(spark, texts)
    asked = ["alpha", "ALPHA", "Bet", "gamma", "i̇x", "absent", " ", "ſt", "pha", "lta"]
    names = spark.createDataFrame([("d/0.py", "alpha")], "file string, name string")
    imports = graph.extract_imports(df)
    rows = {}
    for few in (100, 0):
        monkeypatch.setattr(graph, "FEW", few)
        rows[few] = listed(graph.content_references(df, names, asked)), listed(graph.check_references(imports, df, names, asked))
    assert rows[0] == rows[100] and len(rows[0][0]) >= 8


def test_postings_are_lists_of_files(spark, tmp_path):
    """A row holds many files of a trigram; together they are each file's distinct trigrams, none of them across two files."""
    texts = [f"same words in file {k}\nand more {k % 7}" for k in range(300)] + ["", "ab", None, "aaaaaa", "\U0001f600é\U0001f601 x"]
    df = frame(spark, texts)
    trigrams.build(df, str(tmp_path / "i"), 4)
    postings = spark.read.parquet(str(tmp_path / "i/postings"))
    doc = {r.path: r.doc for r in df.select("path", F.xxhash64("path").alias("doc")).collect()}
    want = sorted((g, doc[f"d/{k}.py"]) for k, text in enumerate(texts) if text is not None for g in trigrams.grams_of(trigrams.normal(text.lower())))
    assert sorted((r.gram, d) for r in postings.collect() for d in r.docs) == want
    assert postings.count() < len(want) / 4
