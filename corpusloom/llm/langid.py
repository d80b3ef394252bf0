"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every slot of the filter holds a bit mask of languages; the masks at an n-gram's slots, and-ed, are all languages that
contain it, in one look. A second filter of the same kind holds the languages in which an n-gram is not rare. A language's shares of a text's
n-grams in both, corrected for its filters' rates of false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import append, named, released, text_blocks
from ._words import LOWER

GRAM = 4
#: Address bits of a filter at least, and n-grams of a language for each slot at most, while the filter has at most so many bytes (all planes):
#: beyond that, slots are shared by more n-grams, false positives rise and are corrected for, and the filter counts for less.
_BITS, _HASHES, _LOAD, MOST_FILTER_BYTES = 19, 3, 0.12, 64 << 20
#: Languages of one plane of masks, and n-grams that are brought to the driver at once.
_PLANE, _AT_ONCE = 64, 2_000_000
#: N-grams that a task counts before it hands them on.
_HELD = 2_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all n-grams of letters and single blanks of a block of texts, and where each text begins in them."""
    low = LOWER[data]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    lead = lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]
    low[lead] += 0x20
    letter = _LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    keep[cuts] = letter[cuts]
    size = np.add.reduceat(np.concatenate([keep, [False]]), np.minimum(offsets[:-1], len(data)), dtype=np.int64) if len(offsets) > 1 else np.empty(0, np.int64)
    size[np.diff(offsets) == 0] = 0
    # each text: a blank, what is kept, three blanks
    starts = np.concatenate([[0], np.cumsum(size + GRAM)])
    out = np.full(starts[-1] + GRAM, 0x20, np.uint32)
    chosen = np.where(letter, low, 0x20)[keep]
    out[np.repeat(starts[:-1] + 1 - (np.cumsum(size) - size), size) + np.arange(len(chosen))] = chosen
    codes = out[: starts[-1]] << np.uint32(24) | out[1 : starts[-1] + 1] << np.uint32(16) | out[2 : starts[-1] + 2] << np.uint32(8) | out[3 : starts[-1] + 3]
    inner = np.ones(len(codes), bool)
    for k in range(1, GRAM):
        inner[starts[1:] - k] = False
    return codes[inner], np.concatenate([[0], np.cumsum(size + 1)])


def _slots(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((codes.astype(np.uint64) + np.uint64(1)) * _FACTORS[k] >> np.uint64(64 - bits)).astype(np.int64)


def _corrected(masks: np.ndarray, false_positives: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text and language, the share of n-grams in the language's filter, without what false positives add."""
    slots = [_slots(codes, k, masks.shape[1].bit_length() - 1) for k in range(_HASHES)]
    total = np.diff(starts)
    out = np.empty((len(total), len(false_positives)))
    for lang in range(len(false_positives)):
        if lang % _PLANE == 0:
            plane = masks[lang // _PLANE]
            found = plane[slots[0]] & plane[slots[1]] & plane[slots[2]]
        hits = np.concatenate([[0], np.cumsum(found >> found.dtype.type(lang % _PLANE) & found.dtype.type(1), dtype=np.int64)])
        out[:, lang] = (hits[starts[1:]] - hits[starts[:-1]]) / np.maximum(total, 1)
    return np.clip((out - false_positives) / np.maximum(1 - false_positives, 1e-9), 0, 1)


@dataclass
class Model:
    """masks: a row for each 64 languages, a column for each slot; every n-gram that was seen in a language is there. common: the same for n-grams that are
    not rare in it."""

    languages: list[str]
    masks: np.ndarray
    false_positives: np.ndarray
    common: np.ndarray
    common_false_positives: np.ndarray

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language, the corrected share of n-grams that the language contains; and whether each text has an n-gram of letters."""
        codes, starts = grams(data, offsets)
        return _corrected(self.masks, self.false_positives, codes, starts), np.diff(starts) > 1

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean of both filters' shares, the first weighted by how seldom it errs; and whether each text has an n-gram of letters."""
        codes, starts = grams(data, offsets)
        weight = 1 - self.false_positives
        held, common = _corrected(self.masks, self.false_positives, codes, starts), _corrected(self.common, self.common_false_positives, codes, starts)
        return (weight * held + common) / (1 + weight), np.diff(starts) > 1


def _filled(chosen: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The masks of a table of (gram, lang) and each language's rate of false positives. N-grams reach the driver in blocks by their value; only the masks
    stay there."""
    counts = {r.lang: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), _PLANE) <= np.iinfo(k).bits)
    planes = -(-len(languages) // _PLANE)
    most = int(np.log2(MOST_FILTER_BYTES / (max(planes, 1) * np.dtype(kind).itemsize)))
    bits = min(most, max(_BITS, int(np.ceil(np.log2(max(counts.values(), default=1) / _LOAD)))))
    masks = np.zeros((planes, 1 << bits), kind)
    number = {name: k for k, name in enumerate(languages)}
    parts = max(1, -(-sum(counts.values()) // _AT_ONCE))
    for p in range(parts):
        own = (chosen if parts == 1 else chosen.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == p)).toArrow()
        codes = own.column("gram").to_numpy().astype(np.uint64)
        coded = own.column("lang").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        of = coded.indices.to_numpy()
        for j, name in enumerate(coded.dictionary.to_pylist()):
            k = number[name]
            for h in range(_HASHES):
                masks[k // _PLANE][_slots(codes[of == j], h, bits)] |= kind(1 << k % _PLANE)
    fills = [np.count_nonzero(masks[k // _PLANE] >> kind(k % _PLANE) & kind(1)) / (1 << bits) for k in range(len(languages))]
    return masks, np.array(fills) ** _HASHES


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", least_share: float = 2e-6, against_best: float = 0.1) -> Model:
    """Count the n-grams of every row with a language, and fill the filters.

    A language's filter takes every n-gram of its rows; the filter of common ones takes those that have at least `least_share` of its n-grams and at least
    `against_best` of the share that they have in any language. The filters are as large as the language with the most of them needs, up to
    MOST_FILTER_BYTES. Every language has both. Rows without a text or a language are left out; repeated rows count each, and n-grams at a
    threshold are taken; texts are read whole, however long."""
    rows = docs.where(named(lang).isNotNull() & named(text).isNotNull()).select(named(lang).alias("lang"), named(text).alias("text"))

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def counted(sums):
            for name, (codes, n) in sums.items():
                for k in range(0, len(codes), 50_000):
                    part = codes[k : k + 50_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[k : k + 50_000])], ["lang", "gram", "n"])

        def fold(name, codes, counts):
            codes, index = np.unique(codes, return_inverse=True)
            sums[name] = codes, np.bincount(index, counts, len(codes)).astype(np.int64)

        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi, data, offsets in text_blocks(b.column(1)):
                codes, starts = grams(data, offsets)
                own = np.array(names[lo:hi])
                of = np.repeat(np.arange(hi - lo), np.diff(starts))
                for name in set(names[lo:hi]):
                    new, n = np.unique(codes[(own == name)[of]], return_counts=True)
                    old = sums.get(name, (np.empty(0, np.uint32), np.empty(0, np.int64)))
                    fold(name, np.concatenate([old[0], new]), np.concatenate([old[1], n]))
                if sum(len(codes) for codes, _ in sums.values()) > _HELD:
                    yield from counted(sums)
                    sums.clear()
        yield from counted(sums)

    by_gram = rows.mapInArrow(released(count), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = by_gram.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("langs"))  # as many as there are languages
    from ._store import Scratch

    by_gram = Scratch(docs.sparkSession, "langid").save(by_gram, "grams").select("gram", F.explode("langs").alias("x")).select("gram", "x.*")
    totals = by_gram.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = by_gram.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("langs"))
    chosen = best.select("gram", "best", F.explode("langs").alias("x")).where((F.col("x.share") >= least_share) & (F.col("x.share") >= against_best * F.col("best"))).select("gram", "x.lang")
    chosen = Scratch(docs.sparkSession, "langid").save(chosen, "chosen")
    languages = sorted(r.lang for r in totals.select("lang").collect())
    return Model(languages, *_filled(by_gram.select("gram", "lang"), languages), *_filled(chosen, languages))


def identify(docs: DataFrame, model: Model, text: str = "text", none: str = "und") -> DataFrame:
    """docs with lang_pred and score (the best language's part of all corrected shares); repeated rows get the same, and an empty table gives none. `none` with score 0 for a null text, one
    without a letter, or a model of no language; the first language with score 0 where no n-gram is known. Of equals the first
    language by name wins. Columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")].index(text)

    def make():
        m = sent.value

        def work(batch: pa.RecordBatch) -> list:
            names, scores = [], []
            column = batch.column(at)
            for lo, hi, data, offsets in text_blocks(column):
                if not m.languages:
                    names += [none] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                shares, some = m.evidence(data, offsets)
                ascii_ = np.concatenate([[0], np.cumsum(_LETTER[LOWER[data]] & (data < 0x80))])
                sure = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
                best, total = shares.argmax(axis=1), shares.sum(axis=1)
                for d in range(hi - lo):
                    if some[d] and (sure[d] or any(map(str.isalpha, column[lo + d].as_py()))):
                        names.append(m.languages[best[d]])
                        scores.append(float(shares[d, best[d]] / total[d]) if total[d] else 0.0)
                    else:
                        names.append(none)
                        scores.append(0.0)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
