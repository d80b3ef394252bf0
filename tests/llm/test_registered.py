"""The registered queries of the first ten operators, called as the driver calls them, on small tables of their own: the contract's columns
and types, and rows equal to plain versions."""

import base64
import hashlib
import random
import textwrap
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import licenses, queries
from corpusloom.llm.license_bodies import BODIES
from tests.llm import brute
from tests.llm.conftest import make_texts

LONG, TEXT, WHOLE, TRUTH, REAL = "bigint", "string", "int", "boolean", "double"
CONTRACT = {
    "op1_mcd_outliers": {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": TRUTH, "kept": TRUTH},
    "op2_decontaminate": {"doc_id": LONG, "n_words": LONG, "n_hit": LONG, "n_items": LONG, "items_sha256": TEXT, "contaminated": TRUTH},
    "op3_best_fit_packing": {"doc_id": LONG, "piece": WHOLE, "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op4_suffix_dedup": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op5_toxicity_cnn": {"doc_id": LONG, "held_out": TRUTH, "score": REAL, "predicted": WHOLE},
    "op6_simhash_golay": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op7_warc": {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG},
    "op8_language_id": {"doc_id": LONG, "held_out": TRUTH, "lang_pred": TEXT, "score": REAL},
    "op9_quality_qda": {"doc_id": LONG, "held_out": TRUTH, "score": REAL, "predicted": WHOLE},
}


def notices(seed: int = 4) -> list[str | None]:
    """Texts with notices in one line, wrapped, cut, joined to each other and to code, and full texts."""
    r = random.Random(seed)
    code = [f"value_{k} = compute({k}, other_{k})" for k in range(6)]
    out = [None, "", "mit", "\n\n", "Released under the MIT License!", "\n".join(textwrap.wrap(dict(BODIES)["MIT"], 200)), " ".join(dict(BODIES)["ISC"].split())]
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(licenses.TEMPLATES)[1].split()
            cut = words[r.choice([0, 0, 1, 3]) : len(words) - r.choice([0, 0, 1, 2])]
            lines += r.sample(code, r.randint(0, 2)) + textwrap.wrap(" ".join(cut), r.choice([40, 70, 10**6])) + [""] * r.randint(0, 1)
        out.append("\n".join(lines[:14]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents, items, pages): the tables that the queries read, and their rows."""
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(9)
    texts = make_texts() + notices()
    kinds = {"en": "the a of and to in that is was for", "de": "der die und das ist von zu mit den im"}
    texts += [" ".join(r.choice(kinds["en" if k % 2 else "de"].split()) + r.choice(["", "s", "en"]) for _ in range(r.randint(25, 90))) for k in range(160)]
    docs = [(k, t, "en" if k % 2 else "de", f"s{k % 2}", len(t or ""), "x") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, Score string").repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(k, k % 3 // 2, k % 5 // 4) for k in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    long = texts[9].split()
    items = [(1, " ".join(long[5:40])), (10, " ".join(long[100:113])), (2, texts[11]), (3, "One, TWO"), (4, ""), (5, None), (6, texts[11])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "http://a/", "x" * 50), (2, "http://b/", "x" * 50), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é\r\n"), (9, "http://e/\r\n", "x" * 50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, [(d, t) for d, t, *_ in docs], items, pages


def run(spark, tables, name):
    got = queries.QUERIES[name](spark, tables[0])
    assert CONTRACT[name].items() <= dict(got.dtypes).items()
    return [tuple(r) for r in got.select(*CONTRACT[name]).collect()]


def test_rules(spark, tables):
    got = {r[0]: r[1:] for r in run(spark, tables, "op1_mcd_outliers")}
    assert {d: r[:-1] for d, r in got.items()} == {d: brute.base_stats(t) for d, t in tables[1]}
    assert not any(failed and kept for *_, failed, kept in got.values()) and sum(kept for *_, kept in got.values()) > 150


def test_contamination(spark, tables):
    assert sorted(run(spark, tables, "op2_decontaminate")) == sorted(brute.contamination(tables[1], tables[2]))


def test_packed(spark, tables):
    got = run(spark, tables, "op3_best_fit_packing")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in tables[1]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        want += [(d, k, 4096 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(parts)]
    assert sorted(r[:5] for r in got) == want
    sequences = {}
    for *_, length, _, sequence, offset in got:
        sequences.setdefault(sequence, []).append((offset, length))
    for own in sequences.values():
        ends = [0, *accumulate(length for _, length in sorted(own))]
        assert [offset for offset, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(r[3] for r in got) // 4096) + 1


def test_repeated_bytes(spark, tables):
    assert sorted(run(spark, tables, "op4_suffix_dedup")) == sorted(brute.repeated_spans(tables[1]))


@pytest.mark.parametrize("name, least", [("op5_toxicity_cnn", 0.3), ("op9_quality_qda", 0.7)])
def test_scores(spark, tables, name, least):
    """held_out and predicted by the contract's rules."""
    got = run(spark, tables, name)
    assert sorted(d for d, *_ in got) == [d for d, _ in tables[1]]
    for d, held_out, score, predicted in got:
        assert held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == int(score >= least)


def test_near_copies(spark, tables):
    prints = [(d, brute.fingerprint(t)) for d, t in tables[1]]
    least = brute.components(prints)
    assert sorted(run(spark, tables, "op6_simhash_golay")) == sorted((d, f"{p:016x}", least[d]) for d, p in prints)


def test_archived(spark, tables):
    want = []
    for page, _, html in tables[3]:
        payload = (html or "").encode()
        owner = max(p for p, _, h in tables[3] if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), digest, "response" if page == owner else "revisit", None if page == owner else owner))
    assert sorted(run(spark, tables, "op7_warc")) == sorted(want)


def test_languages(spark, tables):
    texts = dict(tables[1])
    right = held = 0
    for d, held_out, lang, score in run(spark, tables, "op8_language_id"):
        assert held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in texts[d] or "")) and lang in ("en", "de", "und")
        if held_out and d >= len(texts) - 160:
            held, right = held + 1, right + (lang == ("en" if d % 2 else "de"))
    assert held > 15 and right >= 0.9 * held


def test_license_rows(spark, tables):
    """Lines, whole texts and all runs of lines, by brute force."""
    got = queries.QUERIES["op10_license_scan"](spark, tables[0])
    assert dict(got.dtypes) == {"doc_id": LONG, "n_matches": LONG, "licenses": TEXT, "best_license": TEXT, "best_dice": REAL}
    wanted = [(d, t) for d, t in tables[1] if (t or "").count("\n") < 40]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(tables[1])
    several = 0
    for d, t in wanted:
        matches = brute.license_matches(t, licenses.TEMPLATES, BODIES)
        best = min(((-s, name) for _, name, s in matches), default=None)
        r = found[d]
        assert (r.n_matches, r.licenses, r.best_license) == (len(matches), ",".join(sorted({m[1] for m in matches})), best and best[1]), t
        assert (r.best_dice is None) == (best is None) and (best is None or r.best_dice == pytest.approx(-best[0], abs=1e-6))
        one = {k + 1 for k, x in enumerate((t or "").split("\n")) if brute.license_matches(x, licenses.TEMPLATES, [])}
        several += any(line and line not in one for line, *_ in matches)
    assert several > 15


def test_registered():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(queries.ORACLE_SQL) < set(queries.QUERIES)
