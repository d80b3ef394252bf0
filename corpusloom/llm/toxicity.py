"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of those of its slots: the hash of the word, and the hashes of its beginnings of a few lengths that it
is longer than, so that unseen derivations of a known stem are recognised. Slots met in several training texts have an embedding, all others share a zero vector. Filters of
several widths run over the whole text, each filter's maximum is kept, and a logistic layer makes the score.

The model learns from every labelled row. It starts from one that is trained on the first rows (`most_rows`), with a task for each training; all
other rows follow in rounds, each several times as large as what came before: every task goes on from the model of the last round with its own rows, and the tasks'
changes are averaged. Slots are counted, and thresholds cut, over all labelled rows. Scoring is one pass with the model sent to the tasks.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import BLOCK_BYTES, append, named, released, text_blocks
from ._store import Scratch
from ._words import LOWER, prefix_sums, range_hashes, word_ranges

#: Bounds a model at 13 MB, whatever the words of the texts.
_SLOT_BITS = 18
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
#: Bytes of the beginnings of words.
STEMS = (5, 6, 7, 8)
#: The filter, and the word of its window, of each column of weights.
_OF = np.concatenate([np.arange(w * FILTERS, (w + 1) * FILTERS) for w, width in enumerate(WIDTHS) for _ in range(width)])
_WORD = np.repeat([j for width in WIDTHS for j in range(width)], FILTERS)
_CHUNK, _TOGETHER = 1 << 14, 1 << 12
#: Slots found in fewer labelled texts have no embedding.
LEAST_TEXTS = 4
WORD_DROPOUT = 0.2
#: Of gradient descent on the rows after the first ones: texts to a step, step sizes of embeddings and of the other weights, and how much larger than
#: all rows before it a round is.
_BATCH, _RATE, _DENSE_RATE, _GROWTH = 32, 0.1, 0.01, 8
#: Steps of the whole numbers in which tasks hand over their changes: sums do not depend on the order of tasks.
_UNIT = 1 << 30

#: Letters after lower-casing, and every byte of a character beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of each word of a block of texts (the last for what there is none of), and each text's first word."""
    low = LOWER[data]
    begins, ends, first = word_ranges(low, offsets, _LETTERS)
    sums = prefix_sums(low)
    out = np.full((len(begins), 1 + len(STEMS)), 1 << _SLOT_BITS, np.int32)
    out[:, 0] = range_hashes(sums, begins, ends) >> np.uint64(64 - _SLOT_BITS)
    for k, size in enumerate(STEMS):
        long = np.flatnonzero(ends - begins > size)
        out[long, k + 1] = range_hashes(sums, begins[long], begins[long] + size) * np.uint64(2 * k + 3) >> np.uint64(64 - _SLOT_BITS)
    return out, first


def _only_windows(out: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
    """Set to minus infinity what a filter gives where none of its windows begins: texts have two blanks before and after; a window of one word may be the first blank after,
    a longer one has a word of the text, or is all there is."""
    for w, (before, after) in enumerate([(2, 1), (1, 2), (0, 2)]):
        for off in [*(begins + x for x in range(before)), *(ends - 1 - x for x in range(after))]:
            out[w * FILTERS : (w + 1) * FILTERS, off[(off >= 0) & (off < out.shape[1])]] = -np.inf


@dataclass
class Model:
    slots: np.ndarray  # with an embedding, sorted
    embedding: np.ndarray  # row 0 is for all other slots and stays zero
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float

    def index(self) -> np.ndarray:
        table = np.zeros((1 << _SLOT_BITS) + 1, np.int32)
        table[self.slots] = np.arange(1, len(self.slots) + 1)
        return table

    def activations(self, rows: np.ndarray) -> list[np.ndarray]:
        """By width: filter outputs for each window of one text's embedding rows; the text is padded with unknown words."""
        out = []
        own = self.embedding[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            own += self.embedding[rows[:, k]]
        for w, b in zip(self.filters, self.biases):
            width = len(w)
            e = np.concatenate([np.zeros((width - 1, SIZE), np.float32), own, np.zeros((width - 1 or 1, SIZE), np.float32)])
            n = len(e) - width + 1
            a = e[:n] @ w[0]
            for k in range(1, width):
                a += e[k : k + n] @ w[k]
            out.append(a + b)
        return out

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Maxima of the rectified filters over a whole text, worked off in overlapping parts."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for k in range(0, max(len(rows), 1), _CHUNK):
            part = rows[max(0, k - max(WIDTHS) + 1) : k + _CHUNK]
            np.maximum(best, np.concatenate([a.max(axis=0) for a in self.activations(part)]), out=best)
        return best

    def outputs(self, padded: np.ndarray) -> np.ndarray:
        """By filter, without biases: outputs of the windows that begin at each of these embedding rows, as if blanks followed."""
        own = self.embedding[padded[:, 0]]
        for k in range(1, padded.shape[1]):
            some = np.flatnonzero(padded[:, k])  # few words are longer than the longest stems
            own[some] += self.embedding[padded[some, k]]
        each = np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1).T @ own.T
        out, at = np.zeros((len(WIDTHS) * FILTERS, len(own)), np.float32), 0
        for w, width in enumerate(WIDTHS):
            for j in range(width):
                out[w * FILTERS : (w + 1) * FILTERS, : len(own) - j] += each[at : at + FILTERS, j:]
                at += FILTERS
        return out

    def peaks(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over one text that has two blanks before and after it, and the row where the window begins that has it."""
        best, at = np.full(len(self.out), -np.inf, np.float32), np.zeros(len(self.out), np.int64)
        for lo in range(0, len(padded), _CHUNK):
            out = self.outputs(padded[lo : lo + _CHUNK + 2])[:, :_CHUNK]
            end = len(padded) - lo
            if not lo:
                out[:FILTERS, :2] = out[FILTERS : 2 * FILTERS, :1] = -np.inf
            out[:FILTERS, end - 1 :] = out[FILTERS:, max(end - 2, 0) :] = -np.inf
            k = out.argmax(axis=1)
            top = out[np.arange(len(k)), k]
            at = np.where(top > best, k + lo, at)
            best = np.maximum(best, top)
        return best + np.concatenate(self.biases), at

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        features = np.zeros((len(first) - 1, len(self.out)), np.float32)
        lo = 0
        while lo < len(features):  # texts of some thousand words at once, which stay in the cache
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + _TOGETHER, "right")) - 1)
            if first[hi] - first[lo] > _CHUNK:
                features[lo] = self.pooled(rows[first[lo] : first[hi]])
            else:
                n = np.diff(first[lo : hi + 1])
                ends = np.cumsum(n + 4)
                padded = np.zeros((ends[-1], rows.shape[1]), rows.dtype)
                padded[np.arange(n.sum()) + np.repeat(4 * np.arange(len(n)) + 2, n)] = rows[first[lo] : first[hi]]
                out = self.outputs(padded)
                _only_windows(out, ends - n - 4, ends)
                best = np.array([out[:, a:b].max(axis=1) for a, b in zip((ends - n - 4).tolist(), ends.tolist())])
                features[lo:hi] = np.maximum(best + np.concatenate(self.biases), 0)
            lo = hi
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.bias, -30, 30)))

    def dense(self) -> np.ndarray:
        """All weights but the embedding, as rows of its size."""
        flat = np.concatenate([np.ravel(w) for w in (*self.filters, *self.biases, self.out, self.bias)]).astype(np.float32)
        return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)

    def moved(self, at: np.ndarray, by: np.ndarray) -> Model:
        """The model with rows `at` of the embedding, followed by dense(), changed by `by`."""
        rows = np.concatenate([self.embedding, self.dense()])
        rows[at] += by
        parts = np.split(rows[len(self.embedding) :].ravel(), np.cumsum([w.size for w in (*self.filters, *self.biases, self.out)] + [1]))
        n = len(WIDTHS)
        filters = [x.reshape(w.shape) for x, w in zip(parts[:n], self.filters)]
        return Model(self.slots, rows[: len(self.embedding)], filters, parts[n : 2 * n], parts[2 * n], float(parts[2 * n + 1][0]))

    def widened(self, slots: np.ndarray) -> Model:
        """The model with embeddings, of zero, for these slots too. One that has met a single label gets filters that count."""
        both = np.union1d(self.slots, slots).astype(np.int32)
        embedding = np.zeros((len(both) + 1, SIZE), np.float32)
        embedding[1 + np.searchsorted(both, self.slots)] = self.embedding[1:]
        out = self.out if self.out.any() else np.random.default_rng(7).normal(0, 0.3, len(self.out)).astype(np.float32)
        return replace(self, slots=both, embedding=embedding, out=out)


def _descend(m: Model, r: np.ndarray, y: float, bias: float, share: float, grads: list[np.ndarray], touched: list[np.ndarray], moves: list[np.ndarray]) -> float:
    """Add one text's gradients: of the weights but the embedding to grads, of rows of the embedding to touched and moves. The error, times share."""
    padded = np.zeros((len(r) + 4, r.shape[1]), np.int32)
    padded[2:-2] = r
    best, at = m.peaks(padded)
    features = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-np.clip(features @ m.out + bias, -30, 30)))
    g = (p - y) * share
    grads[-2] += g * features
    grads[-1] += g
    back = g * m.out
    gw = back * (best > 0)
    e = padded[at[_OF] + _WORD]
    seen = m.embedding[e].sum(axis=1) * gw[_OF, None]
    k = 0
    for w, width in enumerate(WIDTHS):
        grads[len(WIDTHS) + w] += gw[w * FILTERS : (w + 1) * FILTERS]
        for j in range(width):
            grads[w][j] += seen[k : k + FILTERS].T
            k += FILTERS
    on = np.flatnonzero(gw[_OF])
    touched.append(e[on].ravel())
    moves.append(np.repeat((np.concatenate([w[j] for w in m.filters for j in range(len(w))], axis=1).T * gw[_OF, None])[on], e.shape[1], axis=0))
    return g


def train(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = 12, batch: int = 32, rate: float = 0.02, least_texts: int = LEAST_TEXTS, decay: float = 1e-3, word_dropout: float = WORD_DROPOUT) -> Model:
    """Fit by Adam. Only slots found in `least_texts` texts get an embedding."""
    rng = np.random.default_rng(seed)
    words = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        words.append(word_slots(data, np.array([0, len(data)]))[0])
    y = np.array(labels, np.float32)
    seen, n = np.unique(np.concatenate([np.unique(w) for w in words] or [np.empty(0, np.int32)]), return_counts=True)
    slots = seen[(n >= least_texts) & (seen < 1 << _SLOT_BITS)]
    m = Model(slots, np.zeros((len(slots) + 1, SIZE), np.float32), [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    m.embedding[1:] = rng.normal(0, 0.1, (len(slots), SIZE))
    rate_of_ones = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        return m
    index = m.index()
    rows = [index[w] for w in words]
    weights = [*m.filters, *m.biases, m.out, np.array([m.bias], np.float32), m.embedding]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            step += 1
            own = order[k : k + batch]
            grads = [np.zeros_like(w) for w in weights[:-1]]
            touched, moves = [], []
            for d in own.tolist():
                r = np.where(rng.random((len(rows[d]), 1)) < word_dropout, 0, rows[d]).astype(np.int32)
                _descend(m, r, y[d], weights[-2][0], 1 / len(own), grads, touched, moves)
            e, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(e), SIZE), np.float32)
            np.add.at(ge, inverse, np.concatenate(moves))
            for w, g, a, b in zip(weights[:-1], grads, first, second):
                g = g + decay * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            ge += decay * m.embedding[e]
            a, b = first[-1], second[-1]
            a[e] += 0.1 * (ge - a[e])
            b[e] += 0.001 * (ge * ge - b[e])
            m.embedding[e] -= rate * (a[e] / (1 - 0.9**step)) / (np.sqrt(b[e] / (1 - 0.999**step)) + 1e-8)
            m.embedding[0] = 0
    m.bias = float(weights[-2][0])
    return m


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least_rows: int = 50) -> dict[str | None, float]:
    """By language, and at None for the rest: the cut with the best F1 on the given rows, halfway to the next score."""

    def cut(s, y):
        order = np.argsort(-s, kind="stable")
        s, hits = s[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        last = np.append(s[1:] != s[:-1], True)  # rows with one score stay together
        k = int(np.argmax(np.where(last, f1, -1)))
        return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)

    out = {None: cut(scores, labels) if len(labels) and labels.any() else 0.5}
    for lang in set(langs) - {None}:
        here = np.array([x == lang for x in langs])
        if here.sum() >= least_rows and labels[here].any():
            out[lang] = cut(scores[here], labels[here])
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", most_rows: int = 4000, most_bytes: int = 64 << 20, folds: int = 3) -> tuple[Model, dict[str | None, float]]:
    """A model and thresholds by language from all labelled rows. About `most_rows` of them and `most_bytes` of text are the first, those whose id's
    hash is below the bound that leaves so many, without texts of over a sixteenth of the bytes; they go through several epochs, all other rows follow once. Ids of docs
    without a label of 0 or 1 are not used; repeated ids count each, null texts as empty ones; ties in score stay together at a threshold. Languages only set thresholds.

    The thresholds are cut on scores of rows that the scoring model has not seen: each of `folds` parts is scored by a model of the others. The
    model that is returned is trained on all."""
    spark = docs.sparkSession
    known = labels.select(named(doc_id).alias("_id"), named(label).cast("int").alias("_label")).where("_label in (0, 1)")
    own = docs.select(named(doc_id).alias("_doc"), F.coalesce(named(text), F.lit("")).alias("text"), named(lang).cast("string").alias("lang"))
    own = _packed(own.where("_doc is not null")).join(known.hint("shuffle_hash"), F.col("_doc") == F.col("_id"))
    fold = F.pmod(F.floor(F.crc32(F.col("_doc").cast("string")) / 4), F.lit(folds)).cast("int")
    scratch = Scratch(spark, "toxicity")
    table = scratch.save(own.select(F.col("_doc").cast("string").alias("id"), "packed", "lang", "_label", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)).alias("hash"), fold.alias("fold"), "size"), "labelled")

    def first(share: float):
        return (F.col("hash") < F.lit(int(share * (1 << 30)))) & (F.col("size") <= most_bytes // 16)

    share = min(1.0, most_rows / max(table.count(), 1))
    share *= min(1.0, most_bytes / max(table.where(first(share)).agg(F.sum("size")).first()[0] or 0, 1))
    rows = sorted(((r.id, _unpacked([r.packed], [r.size])[0].as_py().decode(), r._label, r.lang, r.fold) for r in table.where(first(share)).drop("hash").collect()), key=lambda r: r[:3])  # most_rows, about
    texts, marks = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    models, scored = _trained(spark, texts, marks, np.array([r[4] for r in rows], np.int64), folds)
    rest = table.where(~first(share))
    if rest.isEmpty():
        cuts = thresholds(scored, marks, [r[3] for r in rows])
    else:
        slots = _slots(table)
        models = [m.widened(slots) for m in models]
        low, high = 0.0, share
        while low < 1:
            high = min(1.0, max(high * _GROWTH, 2.0**-20))
            models = _round(rest.where((F.col("hash") >= int(low * (1 << 30))) & (F.col("hash") < int(high * (1 << 30)))), models, scratch)
            low = high
        cuts = thresholds_of_all(scratch.save(_unseen(table, models), "unseen"), scratch)
    scratch.clear()
    return models[-1], cuts


_CODEC = "zstd"


def _packed(rows: DataFrame) -> DataFrame:
    """_doc, lang, size in bytes and the compressed text: a join with many labels shuffles the rows."""

    def run(batches):
        codec = pa.Codec(_CODEC)
        for b in batches:
            texts = [x.encode() for x in b.column("text").to_pylist()]
            packed = pa.array([codec.compress(x, asbytes=True) if x else b"" for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("lang"), pa.array([len(x) for x in texts], pa.int32()), packed], ["_doc", "lang", "size", "packed"])

    out = T.StructType([rows.schema["_doc"], rows.schema["lang"], T.StructField("size", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    return rows.mapInArrow(released(run), out)


def _unpacked(packed: list[bytes], sizes: list[int]) -> pa.Array:
    codec = pa.Codec(_CODEC)
    return pa.array([codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(packed, sizes)], pa.large_binary())


def _blocks(b: pa.RecordBatch, rows: int = 500):
    """text_blocks of columns packed and size, unpacked a few rows at a time."""
    sizes = b.column("size").to_pylist()
    lo = 0
    while lo < len(sizes):
        hi, room = lo + 1, BLOCK_BYTES - sizes[lo]
        while hi < min(len(sizes), lo + rows) and room >= sizes[hi]:
            room -= sizes[hi]
            hi += 1
        for x, y, data, offsets in text_blocks(_unpacked(b.column("packed").slice(lo, hi - lo).to_pylist(), sizes[lo:hi])):
            yield lo + x, lo + y, data, offsets
        lo = hi


def _slots(rows: DataFrame) -> np.ndarray:
    """The slots of at least LEAST_TEXTS texts."""

    def count(batches):
        n = np.zeros((1 << _SLOT_BITS) + 1, np.int64)
        for b in batches:
            for _, _, data, offsets in _blocks(b):
                slots, first = word_slots(data, offsets)
                for k, end in zip(first[:-1].tolist(), first[1:].tolist()):
                    n[np.unique(slots[k:end])] += 1
        at = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["slot", "n"])

    counts = rows.select("packed", "size").mapInArrow(released(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= LEAST_TEXTS).select("slot").toArrow().column(0).to_numpy()).astype(np.int32)  # 2 ** _SLOT_BITS at most


class _Walk:
    """Gradient descent of one model over a task's rows."""

    def __init__(self, model: Model):
        self.start = model
        self.m = replace(model, embedding=model.embedding.copy(), filters=[w.copy() for w in model.filters], biases=[w.copy() for w in model.biases], out=model.out.copy())
        self.bias = np.array([model.bias], np.float32)
        self.weights = [*self.m.filters, *self.m.biases, self.m.out, self.bias]
        self.mass, self.error = np.zeros(len(model.embedding)), 0.0
        self._clear()

    def _clear(self) -> None:
        self.n, self.grads, self.touched, self.moves = 0, [np.zeros_like(w) for w in self.weights], [], []

    def add(self, r: np.ndarray, y: int) -> None:
        self.error += abs(_descend(self.m, r, y, self.bias[0], 1.0, self.grads, self.touched, self.moves))
        self.n += 1
        if self.n == _BATCH:
            self.step()

    def step(self) -> None:
        if not self.n:
            return
        for w, g in zip(self.weights, self.grads):
            w -= _DENSE_RATE * g
        e, inverse = np.unique(np.concatenate(self.touched), return_inverse=True)
        moves = np.concatenate(self.moves)
        ge = np.zeros((len(e), SIZE), np.float32)
        np.add.at(ge, inverse, moves)
        self.m.embedding[e] -= _RATE * ge
        self.m.embedding[0] = 0
        self.mass[e] += np.bincount(inverse, np.abs(moves).sum(axis=1), len(e))
        self.mass[0] = 0
        self._clear()

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the embedding, and after them of dense(), with the weight of their change, and the change times the weight, in whole units."""
        self.step()
        self.m.bias = float(self.bias[0])
        dense = self.m.dense() - self.start.dense()
        mass = np.round(np.append(self.mass, np.full(len(dense), self.error)) * _UNIT)
        at = np.flatnonzero(mass >= 1000)  # gradients of a millionth in sum move nothing
        by = np.concatenate([self.m.embedding - self.start.embedding, dense])[at].astype(float) * mass[at, None]
        return at, mass[at].astype(np.int64), np.round(by).astype(np.int64)


_CHANGES = [f"d{k}" for k in range(SIZE)]


def _round(rows: DataFrame, models: list[Model], scratch: Scratch) -> list[Model]:
    """The models after one pass over the rows; all but the last leave out the rows of their fold. A task's change of a weight counts by the sum of its gradients, so that
    a word that few tasks meet moves as far as one that all meet."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        walks = [_Walk(m) for m in sent.value]
        index, rng = walks[-1].m.index(), np.random.default_rng(7)  # all models have the same slots
        for b in batches:
            marks, folds = b.column("_label").to_pylist(), b.column("fold").to_pylist()
            for lo, hi, data, offsets in _blocks(b):
                slots, first = word_slots(data, offsets)
                for d in range(lo, hi):
                    own = slots[first[d - lo] : first[d - lo + 1]]
                    off = rng.random(len(own)) < WORD_DROPOUT
                    r = index[own]
                    r[off] = 0
                    for k, w in enumerate(walks):
                        if folds[d] != k:
                            w.add(r, marks[d])
        for k, w in enumerate(walks):
            at, mass, by = w.changes()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(mass), *[pa.array(np.ascontiguousarray(c)) for c in by.T]], ["model", "at", "mass", *_CHANGES])

    schema = "model int, at int, mass long, " + ", ".join(f"{c} long" for c in _CHANGES)
    changes = rows.select("packed", "size", "_label", "fold").mapInArrow(released(run), schema)
    mean = changes.groupBy("model", "at").agg(*[(F.sum(c) / F.sum("mass")).cast("float").alias(c) for c in _CHANGES])
    mean = scratch.save(mean, "changes")
    out = []
    for k, m in enumerate(models):  # a model's size at a time
        got = mean.where(F.col("model") == k).drop("model").toArrow()
        by = np.array([got.column(c).to_numpy() for c in _CHANGES], np.float32).reshape(SIZE, -1).T
        out.append(m.moved(got.column("at").to_numpy(), by))
    sent.unpersist()
    return out


def _unseen(rows: DataFrame, models: list[Model]) -> DataFrame:
    """lang, label and score by the model of the other folds."""
    sent = rows.sparkSession.sparkContext.broadcast(models[:-1])

    def run(batches):
        models = sent.value
        index = models[0].index()  # all models have the same slots
        for b in batches:
            fold, scores = b.column("fold").to_numpy(), np.zeros(b.num_rows)
            for lo, hi, data, offsets in _blocks(b):
                slots, first = word_slots(data, offsets)
                rows = index[slots]
                for k in np.unique(fold[lo:hi]).tolist():
                    own = np.flatnonzero(fold[lo:hi] == k)
                    ends = np.cumsum([0, *np.diff(first)[own].tolist()])
                    scores[lo + own] = models[k].scores(np.concatenate([rows[first[d] : first[d + 1]] for d in own.tolist()]), ends)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("_label"), pa.array(scores)], ["lang", "label", "score"])

    return rows.select("packed", "size", "fold", "lang", "_label").mapInArrow(released(run), "lang string, label int, score double")


def thresholds_of_all(scored: DataFrame, scratch: Scratch, least_rows: int = 50) -> dict[str | None, float]:
    """`thresholds` of rows of lang, label and score, whatever their number. Equal scores are one row with counts; running sums go over bins of the logit
    (some thousand for a language), then over the scores inside each bin."""
    every = F.array(F.struct(F.lit(True).alias("general"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("general"), F.col("lang").alias("lang")))
    keyed = scored.select("label", "score", F.explode(every).alias("key")).where("key.general or key.lang is not null").select(F.col("key.general").alias("general"), F.coalesce("key.lang", F.lit("")).alias("lang"), "label", "score")
    # score and 1 - score: both ends of the scale are crowded
    bins = F.when(F.col("score") < 0.5, F.floor(F.log2(F.greatest("score", F.lit(1e-300))) * 64)).otherwise(-F.floor(F.log2(F.greatest(1 - F.col("score"), F.lit(1e-300))) * 64))
    by = ["general", "lang"]
    groups = scratch.save(keyed.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).withColumn("bin", bins), "groups")
    down = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = groups.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(
        *by, "bin", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(down), F.lit(0)).alias("hits0"), F.sum("n").over(whole).alias("rows"), F.sum("hits").over(whole).alias("ones"),
    )
    inside = Window.partitionBy(*by, "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = groups.select(*by, "bin", "score", F.sum("n").over(inside).alias("n"), F.sum("hits").over(inside).alias("hits")).join(before, [*by, "bin"])
    f1 = 2 * (F.col("hits0") + F.col("hits")) / (F.col("n0") + F.col("n") + F.col("ones"))
    best = sums.where((F.col("ones") > 0) & (F.col("general") | (F.col("rows") >= least_rows))).groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), F.col("score"))).alias("best")).select(*by, F.col("best.score").alias("best"))
    best = scratch.save(best, "best")
    lower = groups.join(best, by).groupBy(*by, "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    cuts = {None if r.general else r.lang: (r.best + (r.next or 0.0)) / 2 for r in lower.collect()}  # a row for each language
    return {None: 0.5} | cuts


def _part(k: int, texts: list[str], marks: np.ndarray, fold: np.ndarray) -> tuple[Model | None, np.ndarray, np.ndarray]:
    """A model of all rows but those of fold k, these rows, and their scores; None where there are none."""
    here, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
    if not len(here):
        return None, here, np.empty(0)
    model = train([texts[j] for j in rest], marks[rest].tolist())
    return model, here, score_texts(model, [texts[j] for j in here])


def _trained(spark: SparkSession, texts: list[str], marks: np.ndarray, fold: np.ndarray, folds: int) -> tuple[list[Model], np.ndarray]:
    """A model of the rows of all folds but one, for each, and at last that of all rows; and each row's score by the model without its fold. Every training is a task of its own."""
    sent = spark.sparkContext.broadcast((texts, marks, fold))

    def run(batches):
        texts, marks, fold = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                model, here, scores = (train(texts, marks.tolist()), [], []) if k == folds else _part(k, texts, marks, fold)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(model)], pa.binary()), pa.array([list(here)], pa.list_(pa.int64())), pa.array([list(scores)], pa.list_(pa.float64()))], ["k", "model", "rows", "scores"])

    scored, models = np.full(len(texts), 0.5), [None] * (folds + 1)
    for r in spark.range(0, folds + 1, 1, folds + 1).mapInArrow(released(run), "k long, model binary, rows array<long>, scores array<double>").collect():
        scored[np.array(r.rows, np.int64)] = r.scores
        models[r.k] = pickle.loads(bytes(r.model))
    return [m or models[-1] for m in models], scored  # where a fold has no rows, all are without it


def score_texts(model: Model, texts: list[str], index: np.ndarray | None = None) -> np.ndarray:
    column = pa.array(texts, pa.string())
    index = model.index() if index is None else index
    out = []
    for _, _, data, offsets in text_blocks(column):
        slots, first = word_slots(data, offsets)
        out.append(model.scores(index[slots], first))
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, from the text alone: a null or empty text has the score of a text without known words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [c for c in docs.columns if c.lower() != "score"].index(text)

    def make():
        m = sent.value
        index = m.index()

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for _, _, data, offsets in text_blocks(batch.column(at)):
                slots, first = word_slots(data, offsets)
                out.append(m.scores(index[slots], first))
            return [pa.array(np.concatenate(out).astype(float) if out else [], pa.float64())]

        return work

    return append(docs, [T.StructField("score", T.DoubleType())], make)


def flag(scored: DataFrame, cuts: dict[str | None, float], lang: str = "lang") -> DataFrame:
    """scored with threshold (of the row's language, or the general one) and flagged (score at or above it)."""
    known = [(k, v) for k, v in cuts.items() if k is not None]
    limit = F.lit(cuts[None])
    if known:
        table = F.create_map(*[F.lit(x) for kv in sorted(known) for x in kv])
        limit = F.coalesce(F.try_element_at(table, named(lang).cast("string")), limit)
    return scored.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))
