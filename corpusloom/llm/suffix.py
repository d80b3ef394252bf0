"""Removal of long byte strings that repeat anywhere in the corpus, with suffix arrays built by two-stage sorting.

Equal strings of `length` bytes have equal minimizers: the smallest hash of the k-grams inside. So each string belongs to one
anchor (a place of a k-gram), all equal strings belong to anchors with the same k-gram, and a suffix array over the strings
of each k-gram sees every repeat. An anchor's segment is the bytes that its strings cover; equal segments are counted
and sorted once. A k-gram whose anchors all have one segment needs no sorting: all its strings repeat. Several lengths can be asked for at
once: strings are assigned by the least of them, segments reach as far as the greatest, and common prefixes tell them apart. The others go,
many k-grams together, into suffix arrays:

* stage 1 sorts directly the suffixes that are smaller than their successors,
* stage 2 induces the larger ones by a scan over the buckets of first bytes,
* then neighbours in the array are tested for a common prefix of `length`.

A k-gram with more than `most` different segments is split: each segment falls into classes of adjacent strings, keyed
by the bytes that all strings of the class share, so that only strings that can be equal stay together; classes that
are still crowded are split into single strings, for which counting is enough. Nothing is cut off or left out.

Texts and segments are told apart by 128 bits of hash; within suffix arrays, bytes are compared. Equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import named, released, text_blocks
from ._store import Scratch
from ._words import prefix_sums, range_hashes

LENGTH = 400
GRAM = 32
#: Bytes in one suffix array, about; a k-gram's segments are never dealt over two.
_SORT_BYTES = 256 << 10
_POSITION_BITS = 22


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` bytes. Equal beginnings are found by hash, confirmed, and compared once."""
    data = text.tobytes()
    size = np.minimum(depth, len(text) - at)
    hashes = range_hashes(prefix_sums(text), at, at + size)
    _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
    lead = at[one][group]
    if any(data[i : i + n] != data[j : j + n] for i, j, n in zip(at.tolist(), lead.tolist(), size.tolist()) if i != j):
        one, group = np.arange(len(at)), np.arange(len(at))  # two beginnings with one hash
    order = sorted(range(len(one)), key=lambda k, p=at[one].tolist(): data[p[k] : p[k] + depth])
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    return at[np.argsort(rank[group], kind="stable")]


def suffix_array(text: np.ndarray, depth: int, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Positions of a uint8 text that ends with its smallest byte 0, in the order of their suffixes' first `depth` bytes at
    least. Zeros are separators: their own order is left open. With begins and ends only the positions in these ranges, which ascend and are apart,
    and those up to the next suffix that is smaller than its successor, from which they are induced."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1)).astype(np.int8)
    runs = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(runs[::-1])[::-1]] > 0
    smaller[text == 0] = True
    wanted = np.ones(n, bool)
    if begins is not None:
        stops = np.flatnonzero(smaller)
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, begins, 1)
        np.add.at(marks, stops[np.searchsorted(stops, ends - 1)] + 1, -1)
        wanted = np.cumsum(marks)[:n] > 0
    larger = ~smaller & wanted
    sizes = np.bincount(text[wanted], minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.empty(ends[-1], np.int32)
    out[: sizes[0]] = np.flatnonzero((text == 0) & wanted)
    # stage 1: the smaller suffixes, compared directly
    direct = _sorted_directly(text, np.flatnonzero(smaller & wanted & (text > 0)), depth)
    own = np.bincount(text[direct], minlength=256)
    place = np.arange(len(direct)) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(ends - own, own) + place] = direct
    # stage 2: the larger ones, induced from what stands before them, bucket by bucket
    filled = heads.copy()

    def induce(block: np.ndarray) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[larger[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first = first[order]
            counts = np.bincount(first, minlength=256)
            out[filled[first] + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)] = before[order]
            filled[:] += counts

    filled[0] = ends[0]
    induce(out[: sizes[0]])
    for c in np.flatnonzero(sizes[1:]) + 1:
        done = heads[c]
        while done < filled[c]:
            block = out[done : filled[c]]
            done = filled[c]
            induce(block)
        induce(out[ends[c] - own[c] : ends[c]])
    return out


def repeated_starts(segments: list[bytes], own: list[int], weights: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each of the lengths and each segment: which of its first `own` starts begin a string of that length that also begins at another
    such start of any segment, or stands in a segment that occurs twice. No byte of a segment is 0xFF, as in UTF-8."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8) + np.uint8(1)
    order = suffix_array(text, max(lengths), begins, begins + np.array(own)).astype(np.int64)
    at = np.arange(len(text))
    room = np.repeat(ends - 1, sizes + 1) - at
    mine = at - np.repeat(begins, sizes + 1) < np.repeat(np.array(own), sizes + 1)
    order = order[mine[order]]
    sums = prefix_sums(text)
    data = text.tobytes()
    found = []
    for length in lengths:
        repeats = np.zeros(len(text), bool)
        have = order[room[order] >= length]
        hashes = range_hashes(sums, have, have + length)
        same = np.flatnonzero(hashes[1:] == hashes[:-1])
        a, b = np.minimum(have[same], have[same + 1]), np.maximum(have[same], have[same + 1])
        by = np.lexsort((a, b - a))
        a, b = a[by], b[by]
        cuts = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
            if hi > lo:
                i, j, n = int(a[lo]), int(b[lo]), hi - lo
                if data[i : i + n - 1 + length] == data[j : j + n - 1 + length]:  # adjacent common prefixes, confirmed
                    repeats[i : i + n] = repeats[j : j + n] = True
                else:
                    for i, j in zip(a[lo:hi].tolist(), b[lo:hi].tolist()):
                        if data[i : i + length] == data[j : j + length]:
                            repeats[i] = repeats[j] = True
        rows = zip(begins.tolist(), sizes.tolist(), own, weights)
        found.append([np.arange(max(0, min(k, size - length + 1))) if w > 1 else np.flatnonzero(repeats[p : p + k]) for p, size, k, w in rows])
    return found


# ---- anchors -------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each text of a block the anchors of its strings: text, position in the block, the k-gram's hash, and the first and
    last start of the strings that it is the leftmost smallest k-gram of."""
    n, width = len(data), length - gram + 1
    valid = np.zeros(n + 1, np.int32)
    full = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[full], 1)
    np.add.at(valid, offsets[full + 1] - length + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    step = (1 << _POSITION_BITS) - length
    parts = []
    for lo in range(0, n - length + 1, step):
        own = data[lo : lo + step + length - 1]
        sums = prefix_sums(own)
        at = np.arange(len(own) - gram + 1)
        hashes = range_hashes(sums, at, at + gram)
        low = ((hashes >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64)
        have = 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if width > have:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        starts = np.flatnonzero(valid[lo : lo + len(low)])
        if not len(starts):
            continue
        least = (low[starts] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        text = np.searchsorted(offsets, starts + lo, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
        parts.append((text[new], least[new] + lo, hashes[least[new]].view(np.int64), starts[new] + lo, starts[last] + lo))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(p) for p in zip(*parts))


#: A text's name: 128 bits of hash in two columns. Rows with one text have one name, whatever their ids.
_NAME = ["h1", "h2"]


def _name(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


def _anchor_rows(texts: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """texts: h1, h2, n, z. One row for each anchor: where its strings of the least length start, its k-gram, and 128 bits of hash of its
    segment: the bytes from its first start on up to `reach`, as far as a string of the greatest length at its last start goes."""
    names = ["at", "first", "last", "reach", "gram", "s1", "s2"]
    schema = T.StructType([*_fields([*_NAME, "n"], T.LongType()), *_fields(names[:4], T.IntegerType()), *_fields(names[4:], T.LongType())])
    least, most = min(lengths), max(lengths)

    def run(batches):
        h, press = xxhash.xxh3_128_digest, zstandard.ZstdDecompressor()
        for b in batches:
            column = pa.array([press.decompress(z.as_py()) for z in b.column(3)], pa.large_binary())
            for lo, hi, data, offsets in text_blocks(column):
                text, at, grams, first, last = anchors(data, offsets, least, gram)
                raw = data.tobytes()
                ends = np.minimum(last + most, offsets[text + 1])
                digests = b"".join([h(raw[f:e], p - f) for p, f, e in zip(at.tolist(), first.tolist(), ends.tolist())])
                segment = np.frombuffer(digests, np.int64).reshape(-1, 2)
                rows, base = pa.array(text + lo), offsets[text]
                places = [pa.array((x - base).astype(np.int32)) for x in (at, first, last, ends)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(3)), *places, pa.array(grams), *(pa.array(np.ascontiguousarray(segment[:, k])) for k in (0, 1))], schema.names)

    return texts.mapInArrow(released(run), schema)


# ---- segments and classes ------------------------------------------------------------------------------------------

_SEGMENT = "gram long, s1 long, s2 long"
_KEY = ["gram", "s1", "s2"]


def _squeezed(docs: DataFrame) -> DataFrame:
    """docs (h1, h2, text) with the text compressed, for shuffles."""
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("z", T.BinaryType())])

    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(x.encode()) for x in b.column(2).to_pylist()], pa.binary())], schema.names)

    return docs.mapInArrow(released(run), schema)


def _fetch(texts: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """The bytes of the wanted segments. texts: h1, h2, z; wanted: h1, h2, at, first, last, gram, s1, s2, n. own: how many starts a segment has;
    first: the first of them, from the k-gram."""
    lists = wanted.groupBy(*_NAME).agg(F.collect_list(F.struct(*_KEY, "n", *[F.col(c).cast("long").alias(c) for c in ("at", "first", "last")])).alias("want"))
    met = texts.join(lists, _NAME).select("z", "want")

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            want = b.column(1)
            flat, ends = want.flatten(), np.asarray(want.offsets) - want.offsets[0].as_py()
            first, last, at = (np.asarray(flat.field(n)) for n in ("first", "last", "at"))
            own = []
            for k, z in enumerate(b.column(0)):
                text = press.decompress(z.as_py())
                own += [text[f : e + longest] for f, e in zip(first[ends[k] : ends[k + 1]].tolist(), last[ends[k] : ends[k + 1]].tolist())]
            places = [pa.array(x.astype(np.int32)) for x in (first - at, last - first + 1)]
            yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in (*_KEY, "n")), *places, pa.array(own, pa.binary())], [*_KEY, "n", "first", "own", "bytes"])

    return met.mapInArrow(released(run), f"{_SEGMENT}, n long, first int, own int, bytes binary")


_FOUND = f"{_SEGMENT}, level int, begin int, end int"


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs in a sorted array of integers."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1


def _sort_segments(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """rows: key, gram, s1, s2, n, first, own, bytes, sorted by key. Ranges of repeated starts, from the k-gram; level: which of the lengths."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = [*_KEY, "level", "begin", "end"]

    def work(rows):
        found = repeated_starts([r[7] for r in rows], [r[6] for r in rows], [r[4] for r in rows], lengths)
        out = []
        for level, by_row in enumerate(found):
            for r, s in zip(rows, by_row):
                for a, e in zip(*_ranges(s)):
                    out.append((r[1], r[2], r[3], level, int(a) + r[5], int(e) + r[5]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, kinds)], names)

    def run(batches):
        held, size, key = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != key and size >= _SORT_BYTES:
                    yield work(held)
                    held, size = [], 0
                key = r[0]
                held.append(r)
                size += len(r[7])
        if held:
            yield work(held)

    return rows.mapInArrow(released(run), _FOUND)


def _classes(segments: DataFrame, width: int, length: int) -> DataFrame:
    """Each segment (gram, s1, s2, n, first, own, bytes) in classes of `width` adjacent starts. k1, k2: a hash of the bytes that all strings of a
    class share, with their place; c1, c2: one of all its bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(16), pa.binary(16))
    names = [*_KEY, "n", "first", "own", "bytes", "k1", "k2", "c1", "c2"]

    def batch(out):
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        halves = [np.frombuffer(c.buffers()[1], np.int64).reshape(-1, 2)[: len(out)] for c in columns[7:]]
        return pa.RecordBatch.from_arrays([*columns[:7], *(pa.array(np.ascontiguousarray(h[:, k])) for h in halves for k in (0, 1))], names)

    def run(batches):
        h = xxhash.xxh3_128_digest
        for b in batches:
            out = []
            for gram, s1, s2, n, first, own, data in zip(*(c.to_pylist() for c in b.columns)):
                last = first + own - 1
                for c in range(first // width, last // width + 1):
                    a, z = max(first, c * width), min(last, c * width + width - 1)
                    low, high = c * width + width - 1 - first, c * width - first + length
                    key = h(data[low:high], (gram ^ (c & 0xFFFF)) & 0xFFFFFFFFFFFFFFFF)
                    part = data[a - first : z - first + length]
                    out.append((gram, s1, s2, n, a, z - a + 1, part, key, h(part, a & 0xFFFF)))
                    if len(out) >= 2000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    schema = f"{_SEGMENT}, n long, first int, own int, bytes binary, k1 long, k2 long, c1 long, c2 long"
    return segments.select(*_KEY, "n", "first", "own", "bytes").mapInArrow(released(run), schema)


def _crowded(segments: DataFrame, scratch: Scratch, level: int, length: int, most: int, widths: tuple[int, ...]) -> list[DataFrame]:
    """The repeated starts, for one length, of segments whose k-gram is crowded; the last of the widths is 1."""
    room = F.least(F.col("own"), F.octet_length("bytes") - length + 1)
    segments = segments.withColumn("own", room).where("own > 0").withColumn("bytes", F.substring("bytes", F.lit(1), F.col("own") + (length - 1)))
    found = []
    for width in widths:
        rows = scratch.save(_classes(segments, width, length), f"classes{level}-{width}")
        same = (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))
        groups = rows.groupBy("k1", "k2").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), same.alias("same")).where("total > 1")
        met = scratch.save(rows.join(scratch.save(groups, f"groups{level}-{width}"), ["k1", "k2"]), f"met{level}-{width}")
        found.append(met.where("same").select(*_KEY, F.lit(level).alias("level"), F.col("first").alias("begin"), (F.col("first") + F.col("own")).alias("end")))
        few = met.where(~F.col("same") & (F.col("rows") <= most)).select(F.col("k1").alias("key"), *_KEY, "n", "first", "own", "bytes")
        found.append(_sort_segments(few.repartition("key").sortWithinPartitions("key"), (length,)).withColumn("level", F.lit(level)))
        segments = met.where(~F.col("same") & (F.col("rows") > most))
        if not segments.head(1):
            break
    return found


def repeated_spans(docs: DataFrame, text: str = "text", lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, most: int = 2048, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, texts). texts: h1, h2, the number n of rows and the compressed bytes z of each different text that is long enough. spans: h1, h2,
    and for the k-th of the lengths, which ascend, spans<k> (begin, end in bytes; in any order): the ranges of bytes inside a string of that
    length that also starts anywhere else in the corpus."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    own = docs.where(F.octet_length(named(text)) >= lengths[0]).select(*_name(named(text)), named(text).alias("text"))
    texts = scratch.save(_squeezed(own).groupBy(*_NAME).agg(F.count("*").alias("n"), F.first("z").alias("z")), "texts")
    rows = scratch.save(_anchor_rows(texts, lengths, gram), "anchors")
    same = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))
    groups = rows.groupBy("gram").agg(F.sum("n").alias("rows"), same.alias("whole")).where("rows > 1").select("gram", "whole")
    # written first, here and below: a join whose sides are both fresh shuffles can split a hot key
    met = scratch.save(rows.join(scratch.save(groups, "groups"), "gram"), "met")
    mixed = met.where("not whole")
    one = F.min(F.struct(*_NAME, "at", "first", "last"))
    distinct = scratch.save(mixed.groupBy(*_KEY).agg(F.sum("n").alias("n"), one.alias("one")).select(*_KEY, "n", "one.*"), "distinct")
    bytes_ = scratch.save(_fetch(texts, distinct, lengths[-1]), "segments")
    crowd = bytes_.groupBy("gram").agg(F.count("*").alias("segments")).where(F.col("segments") > most)
    crowd = scratch.save(crowd, "crowd")
    few = bytes_.join(crowd, "gram", "left_anti").select(F.col("gram").alias("key"), *_KEY, "n", "first", "own", "bytes")
    found = [_sort_segments(few.repartition("key").sortWithinPartitions("key"), lengths)]
    if crowd.head(1):
        many = scratch.save(bytes_.join(crowd.select("gram"), "gram"), "many")
        for k, length in enumerate(lengths):
            found += _crowded(many, scratch, k, length, most, (96, 24, 6, 1))
    starts = found[0]
    for f in found[1:]:
        starts = starts.unionByName(f)
    starts = scratch.save(starts, "starts").groupBy(*_KEY, "level").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    size = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("level") + 1)
    moved = F.transform("ranges", lambda r: F.struct((F.col("at") + r["begin"]).alias("begin"), (F.col("at") + r["end"] - 1 + size).alias("end")))
    exact = mixed.select(*_NAME, *_KEY, "at").join(scratch.save(starts, "ranges"), _KEY).select(*_NAME, "level", moved.alias("spans"))
    # a k-gram with one segment: every start repeats, as far as there is room for the length
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("size")) for k, n in enumerate(lengths)])
    whole = met.where("whole").withColumn("x", F.explode(levels)).where("first + x.size <= reach")
    span = F.struct(F.col("first").alias("begin"), F.least(F.col("last") + F.col("x.size"), F.col("reach")).alias("end"))
    spans = exact.unionByName(whole.select(*_NAME, F.col("x.level").alias("level"), F.array(span).alias("spans"))).groupBy(*_NAME)
    return scratch.save(spans.agg(*[F.flatten(F.collect_list(F.when(F.col("level") == k, F.col("spans")))).alias(f"spans{k}") for k in range(len(lengths))]), "spans"), texts


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, and apart from each other."""
    begin, end = (np.array([x[n] for x in spans], np.int64) for n in ("begin", "end"))
    order = np.argsort(begin, kind="stable")
    out: list[list[int]] = []
    for a, e in zip(begin[order].tolist(), end[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [tuple(x) for x in out]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, e in spans:
        parts.append(data[at:a])
        at = e
    return b"".join([*parts, data[at:]])


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller until no character is cut."""
    out = []
    for a, e in spans:
        while a < e and data[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if a < e:
            out.append((a, e))
    return out


def _of_words(data: bytes, spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The spans that hold `least` words (what blanks separate) or more."""
    return [(a, e) for a, e in spans if len(data[a:e].split()) >= least]


#: What a long passage is: over 50 words, found by strings that so many words always fill.
PASSAGE_LENGTH, PASSAGE_WORDS = 240, 51


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, passage_length: int = PASSAGE_LENGTH, passage_words: int = PASSAGE_WORDS, most: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes) of each row; and n_passages and passage_bytes: runs of bytes
    inside strings of `passage_length` bytes that also start elsewhere, those of `passage_words` words or more, and has_passage.

    A null or empty text has no bytes. Repeated rows repeat each other's strings, so texts of `length` bytes or more that occur twice are
    removed whole, whatever their ids; null and repeated ids do no harm. Other columns are not read."""
    t = F.coalesce(named(text), F.lit(""))
    spans, texts = repeated_spans(docs, text, (passage_length, length), most=most)
    own = docs.select(named(doc_id), *_name(t), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t.cast("binary"), 256).alias("whole_sha256"))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, passages, spans in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                data = press.decompress(z)
                spans, passages = _merged(spans), _of_words(data, _merged(passages), passage_words)
                out.append((sum(e - a for a, e in spans), len(spans), hashlib.sha256(_cut(data, spans)).hexdigest(), len(passages), sum(e - a for a, e in passages)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 5, kinds))], [*_NAME, *names])

    met = texts.join(spans, _NAME).select(*_NAME, "z", "spans0", "spans1")
    cut = met.mapInArrow(released(run), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    return own.join(cut, _NAME, "left").select(named(doc_id), "n_bytes", zero("n_removed"), zero("n_spans"), kept, zero("n_passages"), zero("passage_bytes"), (F.coalesce("n_passages", F.lit(0)) > 0).alias("has_passage"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs, all columns and rows, without the repeated bytes in their texts: runs of bytes inside strings of `length` bytes that also start
    elsewhere, if they hold `least_words` words. Spans shrink to whole characters; a null text stays null; rows with one text are copies of each
    other. Names of columns that begin with two underscores are kept for this function."""
    spans, _ = repeated_spans(docs, text, (length,))
    spans = spans.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("spans0").alias("__spans"))
    keyed = docs.select("*", *[c.alias(f"__{n}") for c, n in zip(_name(named(text)), _NAME)])
    names, schema = docs.columns, docs.schema
    met = keyed.join(spans, ["__h1", "__h2"], "left").select(*[named(c) for c in names], "__spans")
    at = names.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, own in enumerate(b.column(len(names)).to_pylist()):
                if own:
                    data = texts[k].encode()
                    texts[k] = _cut(data, _whole_characters(data, _of_words(data, _merged(own), least_words))).decode()
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.mapInArrow(released(run), schema)
