"""Benchmark decontamination by Wu-Manber search over words.

Every 13-word window of a benchmark item is a pattern (an item of fewer words is one pattern). Patterns of one length
share a shift table over blocks of two words: a block that stands in no pattern lets the search jump by almost the whole
length, so most positions are never looked at. Where the shift is zero, the bucket of patterns that end in this block is
taken, and each one whose first word agrees is compared directly, word for word.

The documents are read once and never shuffled. Patterns are sent to the tasks only while the benchmark has at most
`most_windows`; a larger one is searched in blocks of about so many windows each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import append, named, released, small_batches, text_blocks, without
from ._store import Scratch
from ._words import ALNUM_SPLIT, LOWER, mix, prefix_sums, range_hashes, word_ranges

WINDOW = 13
_TABLE_BITS = 18
#: Windows that one lane of the search covers; lanes move side by side in numpy.
_LANE = 256


def _block_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block that ends with each word; the first size - 1 are unused."""
    if size == 1:
        return words
    out = words.copy()
    out[1:] = mix(words[:-1] * np.uint64(3) + words[1:])
    return out


class Patterns:
    """The patterns of one length: shift table, suffix buckets and texts."""

    def __init__(self, length: int, texts: dict[bytes, list[str | None]]):
        self.length, self.size = length, min(2, length)
        self.texts = sorted(texts)
        self.items = [_ordered(set(texts[t])) for t in self.texts]
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        offsets = np.cumsum([0, *map(len, self.texts)])
        begins, ends, _ = word_ranges(data, offsets, ALNUM_SPLIT)
        words = range_hashes(prefix_sums(data), begins, ends).reshape(-1, length)
        self.first = words[:, 0]
        blocks = np.stack([_block_hashes(row, self.size) for row in words])
        self.shift = np.full(1 << _TABLE_BITS, length - self.size + 1, np.uint8)
        for end in range(self.size - 1, length):
            np.minimum.at(self.shift, self._slot(blocks[:, end]), np.uint8(length - 1 - end))
        order = np.argsort(blocks[:, -1], kind="stable")
        self.by_suffix, self.keys = order, blocks[order, -1]

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence; bounds: the first word of each text."""
        m = self.length
        windows = np.maximum(np.diff(bounds) - m + 1, 0)
        lanes = -(-windows // _LANE)
        text = np.repeat(np.arange(len(windows)), lanes)
        at = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _LANE
        stop = np.minimum(at + _LANE, bounds[text] + windows[text])
        blocks = _block_hashes(words, self.size)
        slots = self._slot(blocks)
        found = []
        while len(at):
            jump = self.shift[slots[at + m - 1]]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        out = []
        if found:
            at = np.concatenate(found)
            suffix = blocks[at + m - 1]
            lo, hi = np.searchsorted(self.keys, suffix, "left"), np.searchsorted(self.keys, suffix, "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                bucket = self.by_suffix[a:b]
                bucket = bucket[self.first[bucket] == words[p]]
                if len(bucket):
                    own = b" ".join(data[begins[q] : ends[q]].tobytes() for q in range(p, p + m))
                    out += [(p, k) for k in bucket.tolist() if self.texts[k] == own]
        return out


def _ordered(items: set[str | None]) -> list[str | None]:
    """Ids sorted, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def windows_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[int, dict[bytes, list[str | None]]]:
    """By length in words: each distinct pattern and the items that it stands in."""
    out: dict[int, dict[bytes, list[str | None]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        begins, ends, _ = word_ranges(data, np.array([0, len(data)]), ALNUM_SPLIT)
        words = [data[a:b].tobytes() for a, b in zip(begins, ends)]
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            out[m][b" ".join(words[k : k + m])].append(item)
    return out


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, text: str, groups: list[Patterns]) -> DataFrame:
    """docs with _FIELDS."""
    sent = docs.sparkSession.sparkContext.broadcast(groups)
    names = [c for c in docs.columns if c.lower() not in {f.name for f in _FIELDS}]

    def make():
        searches = sent.value

        def work(batch: pa.RecordBatch) -> list:
            counts, spans, items = [], [], []
            for _, _, data, offsets in text_blocks(batch.column(names.index(text))):
                data = LOWER[data]
                begins, ends, bounds = word_ranges(data, offsets, ALNUM_SPLIT)
                hashes = range_hashes(prefix_sums(data), begins, ends)
                counts += np.diff(bounds).tolist()
                hits = defaultdict(list)
                for s in searches:
                    for p, k in s.search(data, begins, ends, hashes, bounds):
                        hits[int(np.searchsorted(bounds, p, "right")) - 1].append((p, s, k))
                for d in range(len(offsets) - 1):
                    runs: list[dict] = []
                    for p, s, _ in sorted(hits[d], key=lambda x: x[0]) if d in hits else ():
                        a, b = int(p - bounds[d]), int(p - bounds[d]) + s.length
                        if runs and a <= runs[-1]["end"]:
                            runs[-1]["end"] = max(b, runs[-1]["end"])
                        else:
                            runs.append({"begin": a, "end": b})
                    spans.append(runs)
                    items.append(_ordered({i for _, s, k in hits[d] for i in s.items[k]}) if d in hits else [])
            return [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]

        return work

    return append(docs, _FIELDS, make)


def _windows(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """item, m, pattern: the distinct windows of each item, made where the items are: a long item's are as many rows as any others."""
    items = benchmark.select(named(item_id).cast("string").alias("item"), named(item_text).cast("string").alias("text")).where("text is not null")

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for m, texts in windows_of([(item, text)], window).items():
                    own = list(texts)
                    for k in range(0, len(own), 10_000):
                        part = own[k : k + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([m] * len(part), pa.int32()), pa.array(part, pa.binary())], ["item", "m", "pattern"])

    small_batches(benchmark.sparkSession)
    return items.mapInArrow(released(run), "item string, m int, pattern binary").distinct()


def _patterns(windows: DataFrame) -> list[Patterns]:
    """The search tables of a bounded number of windows."""
    texts: dict[int, dict[bytes, list[str | None]]] = defaultdict(lambda: defaultdict(list))
    for r in windows.toLocalIterator():
        texts[r.m][bytes(r.pattern)].append(r.item)
    return [Patterns(m, own) for m, own in sorted(texts.items())]


def _merged(spans, items) -> tuple:
    """Lists of all blocks for one text as one list of spans that do not touch, and one of items, null last."""
    whole = F.aggregate(
        F.array_sort(F.flatten(spans)),
        F.array().cast(_FIELDS[1].dataType),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["begin"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    return whole, F.array_sort(F.array_distinct(F.flatten(items)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_windows: int = 100_000) -> DataFrame:
    """docs with n_words, hit_spans (ranges of words inside occurrences of benchmark windows), hit_items (ids as
    strings, sorted), n_hit and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Columns of docs with these names are replaced; others stay. A null or empty text has no words and is clean; a null or
    empty item text has no window; items that repeat count once by id; items without an id count as one, a null at the end of hit_items, which
    n_items counts and items_sha256 leaves out; an empty benchmark leaves all clean. Repeated rows of docs each get a result; long texts are searched
    whole.

    A benchmark of more than most_windows distinct windows is dealt into blocks by a hash of the window, whatever items they come from. Each
    block is one pass over docs that writes what it has found for a text, under 128 bits of hash of the text; docs are joined with that by these bits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    every = scratch.save(_windows(benchmark, item_id, item_text, window), "windows")
    total = every.select("m", "pattern").distinct().count()
    parts = max(1, -(-total // most_windows))
    if parts == 1:
        out = _scan(docs, text, _patterns(every))
    else:
        key = [F.xxhash64(named(text)).alias("_k0"), F.xxhash64(F.lit("decontaminate"), named(text)).alias("_k1")]
        blocks = None
        for k in range(parts):
            groups = _patterns(every.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k))
            found = _scan(docs.select(named(text).alias("text")).where("text is not null"), "text", groups).where("size(hit_spans) > 0")
            own = [F.xxhash64("text").alias("_k0"), F.xxhash64(F.lit("decontaminate"), F.col("text")).alias("_k1")]
            found = scratch.save(found.select(*own, "hit_spans", "hit_items").groupBy("_k0", "_k1").agg(F.first("hit_spans").alias("hit_spans"), F.first("hit_items").alias("hit_items")), f"block{k}")
            blocks = found if blocks is None else blocks.unionByName(found)
        spans, ids = _merged(F.col("s"), F.col("i"))
        hits = blocks.groupBy("_k0", "_k1").agg(F.collect_list("hit_spans").alias("s"), F.collect_list("hit_items").alias("i")).select("_k0", "_k1", spans.alias("hit_spans"), ids.alias("hit_items"))  # as many as blocks
        base = without(docs, [f.name for f in _FIELDS])
        words = F.regexp_count(F.translate(named(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        base = base.select("*", F.coalesce(words, F.lit(0)).cast("long").alias("n_words"), *key).join(hits, ["_k0", "_k1"], "left").drop("_k0", "_k1")
        out = base.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in _FIELDS[1:]})
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: counts and the digest of the items' ids."""
    return found.select(
        named(doc_id), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
