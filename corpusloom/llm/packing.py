"""Token sequences of a fixed size from documents: hierarchical residual packing.

Each partition packs its pieces best-fit (longest first). Bins that are nearly full are final; the underfull ones go up as
items of the next round, in which a few partitions become one, until one is left. A task holds at most `most_items` items at
once, counted by the pieces that they carry, whatever the number of bins; what is packed before the next ones are taken leaves few bins underfull, and these
meet others in the next round. Where more pieces than that would meet at the top, the tree ends with several roots. Only lengths and keys
travel: token ids are counted and digested where they are made.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import named, released, small_batches, text_blocks
from ._store import Scratch
from ._words import word_ranges

CAPACITY = 4096
END_ID = 1
#: Pieces whose ids a task remembers, and the longest such piece in bytes.
_KNOWN, _KNOWN_BYTES = 250_000, 40

#: Classes of bytes: blank, letter, sign, anything that asks for the whole tokenizer.
_BLANK, _LETTER, _SIGN, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = _SIGN


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and takes runs of letters and runs of signs as
    words of their own. Such runs are cut out here, and each different one is encoded once. Blank-separated words with a digit,
    an apostrophe, a `<` or a character beyond Latin-1 letters are given to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.model.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.count = 0
        self.ids, self.sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]

    def learn(self, plain: list[str], whole: list[str]) -> None:
        encode = self.model.encode_batch_fast
        if plain:
            joined = [" ".join(plain[k : k + 500]) for k in range(0, len(plain), 500)]
            for k in range(0, len(joined), 16):
                ids = np.concatenate([np.array(e.ids, np.uint32) for e in encode(joined[k : k + 16], add_special_tokens=False)])
                self.ids.append(ids)
                self.sizes.append(np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))
        for k in range(0, len(whole), 1000):
            own = [np.array(e.ids, np.uint32) for e in encode(whole[k : k + 1000], add_special_tokens=False)]
            self.ids += own
            self.sizes.append(np.array([len(i) for i in own], np.int64))
        self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        for w in (*plain, *whole):
            self.known[w] = self.count
            self.count += 1

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of a block without blanks, lower-cased where that is plain; where each piece begins in them; whether it is one
        run; and each text's first piece."""
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        lead, tail = lead[(tail != 0x97) & (tail != 0xB7)], tail[(tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        up = lead[(tail >= 0x80) & (tail <= 0x9E)] + 1
        data[up] += 0x20
        inside = kind != _BLANK
        begins, ends, first = word_ranges(inside.view(np.uint8), offsets, np.arange(256) == 1)
        odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        whole = odd[ends] > odd[begins]
        own = kind[inside]
        own[np.repeat(whole, ends - begins)] = _OTHER
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        starts = np.cumsum(ends - begins) - (ends - begins)
        new[starts] = True
        at = np.flatnonzero(new)
        return data[inside], at, own[at] != _OTHER, np.searchsorted(at, np.concatenate([starts, [len(own)]])[first])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, end_id after each text, and where each text begins in them."""
        own, at, plain, first = self.split(data, offsets)
        if len(at):
            where = np.concatenate([at, [len(own)]]).astype(np.int64)
            coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(where), pa.py_buffer(own)).dictionary_encode()
            index, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
            if self.count > _KNOWN:
                self.forget()
            run = np.zeros(len(words), bool)
            run[index] = plain
            new = [k for k, w in enumerate(words) if w not in self.known]
            self.learn([words[k] for k in new if run[k]], [words[k] for k in new if not run[k]])
            number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[index]
            for k in new:
                if len(words[k]) > _KNOWN_BYTES:
                    del self.known[words[k]]
            sizes = self.sizes[0]
            at, size = (np.cumsum(sizes) - sizes)[number], sizes[number]
        else:
            at, size = np.empty(0, np.int64), np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        out_at = before[:-1] + np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        starts = before[first] + np.arange(len(offsets))
        out = np.full(starts[-1], end_id, np.uint32)
        inner = np.arange(before[-1])
        out[np.repeat(out_at - before[:-1], size) + inner] = self.ids[0][np.repeat(at - before[:-1], size) + inner]
        return out, starts


@functools.lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps what it has learnt for its next tasks."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 (and ids). A document's ids, end_id last, are cut
    only where they exceed the capacity. A null or empty text is the end_id alone; repeated rows give repeated pieces."""
    docs = docs.select(named(doc_id), named(text))
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = T.StructType([docs.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        model = _tokenizer(path)
        for b in batches:
            for lo, hi, data, offsets in text_blocks(b.column(1)):
                ids, starts = model.encode(data, offsets, end_id)
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for d in range(hi - lo):
                    a, z = int(starts[d]), int(starts[d + 1])
                    for k, p in enumerate(range(a, z, capacity)):
                        part = ids[p : min(p + capacity, z)]
                        rows.append(lo + d)
                        piece.append(k)
                        start.append(p - a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        own.append(part)
                out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.mapInArrow(released(run), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first, each item into the fullest bin that still takes it. The bin and the offset of each item; the fill
    of each bin."""
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        if room > n:
            rooms[room - n].append(k)
            some |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def _round(bins: DataFrame, capacity: int, slack: int, most_items: int, level: int) -> DataFrame:
    """Best fit within each partition. In and out: members (with their offsets), fill; also the bin's number and
    whether it is full enough to stay as it is."""
    schema = bins.select("members", "fill", F.lit(0).cast("long").alias("bin"), F.lit(True).alias("full")).schema

    def run(batches):
        from pyspark import TaskContext

        serial = (level << 58) + (TaskContext.get().partitionId() << 34)

        def packed(parts):
            nonlocal serial
            table = pa.Table.from_batches(parts).combine_chunks()
            members, fill = table.column(0).combine_chunks(), np.asarray(table.column(1))
            if isinstance(members, pa.ChunkedArray):
                members = members.chunk(0)
            bins, offsets, fills = best_fit(fill, capacity)
            order = np.lexsort((offsets, bins))
            members = members.take(pa.array(order))
            size = np.diff(np.asarray(members.offsets))
            inner = members.flatten()
            moved = np.asarray(inner.field("offset")) + np.repeat(offsets[order], size)
            fields = [moved if f.name == "offset" else inner.field(f.name) for f in inner.type]
            inner = pa.StructArray.from_arrays([pa.array(f) if isinstance(f, np.ndarray) else f for f in fields], fields=list(inner.type))
            ends = np.concatenate([[0], np.cumsum(np.bincount(bins[order], weights=size, minlength=len(fills)))]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends), inner), pa.array(fills), pa.array(serial + np.arange(len(fills))), pa.array(fills >= capacity - slack)]
            serial += len(fills)
            for b in pa.Table.from_arrays(out, ["members", "fill", "bin", "full"]).to_batches(max_chunksize=20_000):
                yield b

        parts, held = [], 0
        for b in batches:
            while b.num_rows:
                carried = np.cumsum(np.asarray(b.column(0).value_lengths()))
                n = max(1, int(np.searchsorted(carried, most_items - held, "right")))
                parts.append(b.slice(0, n))
                held += int(carried[min(n, b.num_rows) - 1])
                b = b.slice(n)
                if held >= most_items or b.num_rows:
                    yield from packed(parts)
                    parts, held = [], 0
        if held:
            yield from packed(parts)

    return bins.mapInArrow(released(run), schema)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, slack: int = 8, fan_in: int = 8, most_items: int = 400_000) -> DataFrame:
    """items with sequence_id and offset: every item whole in one sequence of at most `capacity`, sequences gapless from 0.

    Lengths are 1 to capacity. Columns of the same names are replaced. Null lengths are an error. Bins within `slack` of the capacity are final. items
    are written first: where they come from a tokenizer, its workers and those of the packing are then not in memory at the same time.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    items = scratch.save(items, "items")
    own = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    size = named(length).cast("long")
    size = F.when(size.between(1, capacity), size).otherwise(F.raise_error(F.lit("a length is null, below 1 or above the capacity")).cast("long"))
    member = F.struct(F.struct(*[named(c) for c in own]).alias("item"), F.lit(0).cast("long").alias("offset"))
    bins = items.select(F.array(member).alias("members"), size.alias("fill"))
    done = []
    level, parts = 0, None
    while True:
        last = parts == 1 or level == 14
        out = scratch.save(_round(bins, capacity, slack, most_items, level), f"level{level}")
        full = out if last else out.where("full")
        done.append(full)
        if last:
            break
        rest = out.where("not full").select("members", "fill")
        left, bins_left = rest.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)), F.count("*")).first()
        if not bins_left:
            break
        here = rest.rdd.getNumPartitions() if parts is None else parts
        parts = max(-(-here // fan_in), -(-left // most_items))
        if parts >= here > 1:  # so many stay underfull that no task could take more of them
            done[-1] = out
            break
        bins = rest.coalesce(parts)
        level += 1
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return packed.select("bin", F.explode("members").alias("m")).select(*[F.col("m.item").getField(c).alias(c) for c in own], F.col("bin").alias("sequence_id"), F.col("m.offset").alias("offset"))


def assemble(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and its ids in order, from packed pieces that carry their ids. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", named(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
