"""Groups of spelling variants: words at one edit from each other, and for each word the far more frequent form that it stands for.

Two words that differ by one inserted, deleted or replaced character share their first half or their last half. So the dictionary is sorted forward, and
sorted reversed, and words are compared only within blocks that share that half. A block belongs to a length m, the shorter word's, and to a
window of it that holds the edit: the second half in the forward dictionary, the first half in the reversed one. The characters outside
the window are the block's key. A block of more than MOST_BLOCK words is subdivided: its window is halved, and its words go to two blocks whose keys
have the characters of the other half too, down to windows of one character. Blocks are counted with map-side sums, laid out by range, sorted, and
scanned; each pair is verified. The place of the first difference belongs to one window only, so every pair is found exactly once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._columns import named, released, small_batches
from ._store import Scratch

#: Runs of letters, and characters of a word at least.
LETTERS, LEAST = r"A-Za-zÀ-ÿ", 7
#: Of 31 (document, run) pairs one loses a character.
DIVISOR = 31
#: Words of a block that is compared; a larger one is subdivided.
MOST_BLOCK = 64
#: A word's form has at least so many times its occurrences.
FACTOR = 10

#: Characters of a text that are searched at once, and bytes of counted words that a task holds.
_PIECE, _HELD = 1 << 22, 16 << 20


def _pieces(text: str, run: re.Pattern) -> Iterator[str]:
    """The text in parts that no run of letters crosses, unless it is longer than a part."""
    at = 0
    while len(text) - at > _PIECE:
        end = at + _PIECE
        while end < len(text) and run.match(text, end):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = LETTERS, least: int = LEAST, divisor: int = DIVISOR, occurrences: int = 2) -> DataFrame:
    """word, n of the words with enough characters and occurrences over whole texts. A null text has none; a null id counts as an empty one; repeated
    rows count each. What a document's run becomes depends on the document and the run, so runs are counted by document first, then by task."""
    long_run, letter = re.compile(f"[{letters}]{{{least},}}"), re.compile(f"[{letters}]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for own, whole in zip(b.column(0), b.column(1), strict=True):
                start, body = zlib.crc32(f"{own.as_py()}:".encode()), whole.as_py()
                for part in _pieces(body, letter):
                    for token, n in Counter(long_run.findall(part)).items():
                        word = token.encode().lower()  # bytes: A-Z only
                        h = zlib.crc32(word, start)
                        if h % divisor == 0:
                            chars = word.decode()
                            k = h % len(chars)
                            if len(chars) <= least:
                                continue
                            word = (chars[:k] + chars[k + 1 :]).encode()
                        if word in counts:
                            counts[word] += n
                        else:
                            counts[word] = n
                            held += len(word) + 100
                    if held > _HELD:
                        yield out()
                        counts, held = {}, 0
        yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(named(doc_id).cast("string"), F.lit("")).alias("id"), named(text).cast("string").alias("text")).where("text is not null")
    found = rows.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= occurrences)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, m, longer, s, e) with key: the characters outside the window from s to e of a word of m characters, or outside one longer window
    of a word of m + 1; those behind it are reversed, so that words sorted by key are a forward or a reversed dictionary."""
    front, back = F.left("word", F.col("s")), F.expr("substring(word, e + longer + 1)")
    return rows.withColumn("key", F.concat(F.when(F.col("s") > 0, front).otherwise(""), F.reverse(back)))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its window."""
    mid = F.col("s") + F.floor((F.col("e") - F.col("s")) / 2).cast("int")
    halves = F.array(F.struct(F.col("s").alias("a"), mid.alias("z")), F.struct(mid.alias("a"), F.col("e").alias("z")))
    half = rows.select("word", "n", "m", "longer", F.explode(halves).alias("_w"))
    return _keyed(half.select("word", "n", "m", "longer", F.col("_w.a").alias("s"), F.col("_w.z").alias("e")))


_BLOCK = ["m", "s", "e", "key"]


def _compare(words: np.ndarray, longer: np.ndarray, block: np.ndarray, m: int, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one block whose words are at one edit with the first difference in the block's window. words: a character in each column, m or
    m + 1 of them; in a block words of m come first."""
    left, right = [], []
    i = np.flatnonzero(~longer)
    for step in range(1, len(words)):
        i = i[: np.searchsorted(i, len(words) - step)]
        i = i[block[i] == block[i + step]]
        if not len(i):
            break
        j = i + step
        differ = words[i, :m] != words[j, :m]
        some = differ.any(1)
        first = np.where(some, differ.argmax(1), m)
        shifted = words[i, :m] != words[j, 1:]
        last = np.where(shifted.any(1), m - 1 - shifted[:, ::-1].argmax(1), -1)
        near = np.where(longer[j], last < first, differ.sum(1) == 1)
        near &= (first >= s[i]) & ((first < e[i]) | (e[i] == m))
        left.append(i[near])
        right.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of sorted rows, each in both directions: word, other, other_n. Whole blocks are gathered up to a few MB."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        size = rows["m"].to_numpy()
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1), len(size)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            own, m = rows.slice(a, z - a), int(size[a])
            text, n = own["word"].to_pylist(), own["n"].to_numpy()
            longer, s, e, new = own["longer"].to_numpy().astype(bool), own["s"].to_numpy(), own["e"].to_numpy(), own["new"].to_numpy()
            try:
                chars = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in text).encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                chars = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in text).encode("utf-32-le"), np.uint32)
            i, j = _compare(chars.reshape(-1, m + 1), longer, new, m, s, e)
            if len(i):
                one, two = np.concatenate([i, j]), np.concatenate([j, i])
                yield pa.RecordBatch.from_arrays([pa.array([text[k] for k in one]), pa.array([text[k] for k in two]), pa.array(n[two])], ["word", "other", "other_n"])

    def numbered(rows: pa.Table) -> pa.Table:
        """rows with the number of their block."""
        change = np.zeros(len(rows), bool)
        for c in ("m", "s", "e"):
            x = rows[c].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        key = rows["key"].to_pylist()
        change[1:] |= [a != b for a, b in zip(key, key[1:], strict=False)]
        return rows.append_column("new", pa.array(np.cumsum(change)))

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        rows = pa.Table.from_batches(held)
        if rows.nbytes < 2 << 20 and len(rows) < 50_000:
            continue
        rows = numbered(rows)
        last = rows["new"].to_numpy()
        whole = int(np.searchsorted(last, last[-1]))
        if whole:
            yield from pairs(rows.slice(0, whole))
        held = rows.slice(whole).drop_columns("new").combine_chunks().to_batches()
    if held and sum(map(len, held)):
        yield from pairs(numbered(pa.Table.from_batches(held)))


def near_pairs(words: DataFrame, scratch: Scratch, least: int = LEAST, most_block: int = MOST_BLOCK) -> DataFrame:
    """word, other, other_n for every two of the distinct words (word, n) at one edit, in both directions."""
    size = F.char_length("word")
    roles = F.array(F.struct(size.alias("m"), F.lit(0).alias("longer")), F.struct((size - 1).alias("m"), F.lit(1).alias("longer")))
    rows = words.select("word", "n", F.explode(roles).alias("_r")).select("word", "n", "_r.*").where(F.col("m") >= least)
    level = _halves(rows.withColumn("s", F.lit(0)).withColumn("e", F.col("m")))
    found, at = [], 0
    while True:
        level = scratch.save(level, f"level{at}")
        blocks = level.groupBy(*_BLOCK).agg(F.count("*").alias("_size"), F.max("longer").alias("_long"), F.min("longer").alias("_short"))
        blocks = scratch.save(blocks.where("_size > 1 and _short = 0"), f"blocks{at}")  # words of m + 1 alone are no block
        large = (F.col("_size") > most_block) & (F.col("e") - F.col("s") > 1)
        scanned = level.join(blocks.where(~large).select(*_BLOCK), _BLOCK, "left_semi")
        order = [*_BLOCK, "longer", "word"]
        scanned = scanned.select("word", "n", "m", "longer", "s", "e", "key").repartitionByRange(*_BLOCK).sortWithinPartitions(*order)
        found.append(scratch.save(scanned.mapInArrow(released(_scan), "word string, other string, other_n long"), f"pairs{at}"))
        if not blocks.where(large).head(1):
            break
        level = _halves(level.join(blocks.where(large).select(*_BLOCK), _BLOCK, "left_semi"))
        at += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of forms (word, form): the last of the forms that follow from a word. Each step doubles what a word has followed; forms are ten times
    as frequent as their words, so a few steps do."""
    at, step = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        step += 1
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = scratch.save(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"roots{step}")
        if not at.where("moved").head(1):
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = LETTERS, least: int = LEAST, divisor: int = DIVISOR, occurrences: int = 2, factor: int = FACTOR, most_block: int = MOST_BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the whole texts: form is the near word of the largest n (ties: the smallest in code-point order)
    if that is at least `factor` times the word's own, else null; root is the last of the forms that follow, or the word itself.

    An empty table, and texts that are null, empty or without words, give no rows. Long texts are read whole; a document's id only decides which of its
    runs lose a character. Other columns are not looked at."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(count_words(docs, doc_id, text, letters, least, divisor, occurrences), "words")
    best = near_pairs(words, scratch, least, most_block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form"))).alias("_b"))
    near = best.select("word", "n_near", F.col("_b.form").alias("_form"), (-F.col("_b.k")).alias("_n"))
    takes = F.col("_n") >= factor * F.col("n")
    own = words.join(near, "word", "left").select("word", F.when(takes, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("_n")).alias("form_n"))
    own = scratch.save(own, "own")
    last = roots(own.where("form is not null"), scratch)
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
