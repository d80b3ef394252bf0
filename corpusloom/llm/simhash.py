"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit word. The perfect binary
Golay code puts every word within 3 bits of one codeword; a word at exactly 3 also has five codewords at 4 bits. Two
words that differ in 2 bits or fewer share a codeword within 4 bits: the one that a word between them decodes to.
By the pigeonhole principle, fingerprints at 2 or fewer differing bits agree in a whole segment, and the errors of the
next segment are within the code's reach, so a key of one exact segment and one codeword index of the next is shared.
Each distinct fingerprint gets 3 to 18 keys; those with a key in common are compared.

Copies never meet as pairs: distinct fingerprints are linked, documents join their fingerprint's component afterwards.
A key with more than `most` fingerprints is not compared within; its fingerprints emit the 65 words within one bit
instead, and all that share such a word are within 2 bits of each other, so a star to the smallest one links them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import append, named, released, text_blocks
from ._store import Scratch
from ._words import LOWER

#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1 generates the binary Golay code of length 23.
_GENERATOR = 0b110001110101
_SEGMENTS = ((42, 22), (21, 21), (0, 21))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word modulo the generator."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (_GENERATOR << (bit - 11)), out)
    return out


def _nearby_errors() -> np.ndarray:
    """By syndrome: the error of at most 3 bits, and the five of 4 bits where that one has 3 (else the first again)."""
    ones = 1 << np.arange(23)
    sums = [np.array([0])]
    for _ in range(4):  # all words of one more bit, each once
        sums.append(np.unique((sums[-1][:, None] | ones)[(sums[-1][:, None] & ones) == 0]))
    table = np.zeros((2048, 6), np.int64)
    for weight in range(4):
        table[_syndromes(sums[weight])] = sums[weight][:, None]
    far = np.bitwise_count(table[:, 0]) == 3
    s = _syndromes(sums[4])
    order = np.argsort(s, kind="stable")
    s, errors = s[order], sums[4][order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    own = far[s]
    table[s[own], place[own] + 1] = errors[own]
    return table


_ERRORS = _nearby_errors()


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Six 12-bit indices for each 23-bit word: of the codewords within 4 bits; the first repeats where there is one."""
    return (words[:, None].astype(np.int64) ^ _ERRORS[_syndromes(words)]) >> 11


def golay_keys(prints: np.ndarray) -> np.ndarray:
    """18 keys for each 64-bit fingerprint, the same one repeated where there are fewer."""
    parts = [(prints >> np.uint64(low)).astype(np.int64) & ((1 << size) - 1) for low, size in _SEGMENTS]
    fuzzy = [codeword_indices(p) for p in parts]
    return np.concatenate([(k << 40) | (parts[k][:, None] << 12) | fuzzy[(k + 1) % 3] for k in range(3)], axis=1)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every word shingle of a lower-cased text, repeats included."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    h = xxhash.xxh64_intdigest
    pairs = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([h(joined[a:b], 42) for a, b in pairs], np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """docs with simhash (long): a bit is set if more than half of the shingle hashes have it. No word: 0."""
    at = [c for c in docs.columns if c.lower() != "simhash"].index(text)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = []
            for _, _, data, offsets in text_blocks(batch.column(at)):
                low = LOWER[data].tobytes()
                out += [fingerprint(low[a:b], size) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [pa.array(np.array(out, np.uint64).view(np.int64))]

        return work

    return append(docs, [T.StructField("simhash", T.LongType())], make)


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            values = np.asarray(b.column(0)).view(np.uint64)
            keys = np.sort(golay_keys(values), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(values.view(np.int64), new.sum(axis=1)))], ["key", "simhash"])

    return prints.select("simhash").mapInArrow(released(run), "key long, simhash long")


def _links_within(rows: DataFrame, bits: int) -> DataFrame:
    """rows (key, simhash), sorted by key within partitions: pairs of the same key that differ in few bits."""

    def linked(keys, prints):
        out = []
        at = np.arange(len(keys))
        step = 1
        while True:
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= bits]
            out.append(np.stack([prints[near], prints[near + step]]))
            step += 1
        a, b = np.concatenate(out, axis=1).view(np.int64) if out else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, np.asarray(b.column(0))])
            prints = np.concatenate([prints, np.asarray(b.column(1)).view(np.uint64)])
            if len(keys) > 50_000:
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield linked(keys[:cut], prints[:cut])
                    keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield linked(keys, prints)

    return rows.mapInArrow(released(run), "a long, b long")


def links(prints: DataFrame, scratch: Scratch, bits: int = 2, most: int = 256) -> DataFrame:
    """prints: distinct simhash. Pairs (a < b) of fingerprints that connect all those at `bits` (2) or fewer differing bits:
    every such pair, but in a crowded key only a star for those within one bit of the same word."""
    if bits > 2:
        raise ValueError("the code reaches 2 bits")
    keys = scratch.save(_keys(prints), "keys")
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = scratch.save(keys.join(shared, "key"), "met")
    few = met.where(F.col("n") <= most).select("key", "simhash").repartition("key").sortWithinPartitions("key")
    close = _links_within(few, bits)
    crowded = met.where(F.col("n") > most).select("simhash").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    words = crowded.select("simhash", F.explode(F.transform(flips, lambda f: F.col("simhash").bitwiseXOR(f))).alias("word"))
    least = words.groupBy("word").agg(F.min("simhash").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    star = words.join(least, "word").where("a < simhash").select("a", F.col("simhash").alias("b"))
    if bits == 1:
        star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return scratch.save(close.unionByName(star).distinct(), "links")


def connect(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root): the smallest node of each one's connected component, for all nodes but the roots.

    Alternates large stars and small stars; every round is a few joins on node ids and is written to the shared folder."""
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    state = None
    for k in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: the join's sides are then both fresh shuffles, and a root with very many nodes can be split
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least{k}")
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").unionByName(down.select("v", F.col("m").alias("u"))).distinct()
        pairs = scratch.save(small, f"round{k}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if k > 1:
            scratch.drop(f"round{k - 2}")
            scratch.drop(f"least{k - 2}")
        if now == state:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now
    raise RuntimeError("no end of the rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, text_hash, simhash, root and component_id (the smallest doc_id reachable over links, itself included) of each row.
    root is the component's smallest fingerprint: it tells components apart even where ids repeat.

    A null or empty text has fingerprint 0 and is linked like any other. Rows with a null doc_id take part, but are
    never the smallest unless all are null. Repeated rows fall in one component. Other columns are not carried.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    docs = docs.select(named(doc_id), named(text))
    rows = scratch.save(fingerprints(docs, text, size).select(named(doc_id), F.xxhash64(named(text)).alias("text_hash"), "simhash"), "prints")
    groups = scratch.save(rows.groupBy("simhash").agg(F.min(named(doc_id)).alias("least")), "groups")
    roots = connect(links(groups.select("simhash"), scratch, bits), scratch)
    labelled = groups.join(roots, groups.simhash == roots.node, "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("simhash", "root").join(smallest, "root").select("simhash", "root", "component_id")
    return rows.join(by_print, "simhash").select(named(doc_id), "text_hash", "simhash", "root", "component_id")
