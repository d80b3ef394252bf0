"""A trigram index of files: searches open only the files that can match.

Every file's distinct trigrams of normalised characters are in a postings table, sorted by trigram, so that a reader skips all others: a row holds
those files of a trigram that one task has met together. A literal query is a
conjunction of its trigrams. A regular expression is a formula over the literals that every match must have: what stands in sequence is joined by
and, alternatives by or, and a part that may be absent demands nothing. Files that satisfy the formula are read, from the buckets that hold them,
and searched by the same functions as without an index, so the rows are the same.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _constants as codes
    from re import _parser as parser

from ..functions import text as tx
from ..sources import tables
from . import search as scan

_FILES = "path string, content string, size_bytes long, doc long"
_POSTINGS = "gram long, docs array<long>"

#: Characters whose trigrams are sorted at once.
_AT_ONCE = 1 << 21

#: Letters that match an ASCII letter without regard to case, though lower-casing does not make them one; and the dot that lower-casing
#: leaves behind a capital i with a dot.
_ALIKE = {"ſ": "s", "ı": "i", "̇": ""}


def normal(text: str) -> str:
    """What trigrams are taken of, of a text in lower case."""
    return text.translate(str.maketrans(_ALIKE))


def grams_of(text: str) -> set[int]:
    """Trigrams of a normalised text as numbers: 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return set((c[:-2] << 42 | c[1:-1] << 21 | c[2:]).tolist()) if len(c) > 2 else set()


# ---- what a match must have ----------------------------------------------------------------------------------------

#: A formula is None (nothing is demanded), a literal, or ("and" | "or", formulas).
Formula = str | tuple | None


def _all(parts: list[Formula]) -> Formula:
    own = [p for p in parts if p is not None]
    return None if not own else own[0] if len(own) == 1 else ("and", own)


def _any(parts: list[Formula]) -> Formula:
    """One alternative that demands nothing makes the choice demand nothing."""
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _walk(tree) -> Formula:
    parts, run = [], ""

    def close():
        nonlocal run
        if len(normal(run.lower())) > 2:
            parts.append(normal(run.lower()))
        run = ""

    for op, arg in tree:
        if op is codes.LITERAL and arg < 128:
            run += chr(arg)
            continue
        close()
        if op is codes.SUBPATTERN:
            parts.append(_walk(arg[3]))
        elif op is codes.BRANCH:
            parts.append(_any([_walk(x) for x in arg[1]]))
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[0] > 0:
            parts.append(_walk(arg[2]))
    close()
    return _all(parts)


def demands(query: str, is_regex: bool = False) -> Formula:
    """The formula that every matching text satisfies."""
    if not is_regex:
        low = normal(query.lower())
        return low if len(low) > 2 else None
    tx.user_regex(query)  # checked first
    return _walk(parser.parse(query))


def literals(formula: Formula) -> list[str]:
    if formula is None:
        return []
    return [formula] if isinstance(formula, str) else [x for f in formula[1] for x in literals(f)]


def _holds(formula: Formula, found: Column) -> Column:
    if isinstance(formula, str):
        return F.size(F.array_intersect(found, F.array(*[F.lit(g).cast("long") for g in sorted(grams_of(formula))]))) == len(grams_of(formula))
    out = None
    for f in formula[1]:
        own = _holds(f, found)
        out = own if out is None else (out & own if formula[0] == "and" else out | own)
    return out


# ---- the index -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int

    def candidates(self, formula: Formula) -> DataFrame | None:
        """doc: files that satisfy the formula, as far as trigrams tell; None where it demands nothing."""
        wanted = sorted({g for x in literals(formula) for g in grams_of(x)})
        if formula is None or not wanted:
            return None
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("gram").isin(*wanted)).select("gram", F.explode("docs").alias("doc"))
        return rows.groupBy("doc").agg(F.collect_set("gram").alias("found")).where(_holds(formula, F.col("found"))).select("doc")  # as many as the query has

    def files(self, formula: Formula) -> DataFrame:
        """The files that can match, from their buckets only."""
        every = self.spark.read.schema(f"{_FILES}, bucket int").parquet(f"{self.path}/files")
        few = self.candidates(formula)
        if few is None:
            return every.drop("doc", "bucket")
        held = [r[0] for r in few.select(F.pmod("doc", F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # at most one for each bucket
        return every.where(F.col("bucket").isin(*held)).join(few, "doc", "left_semi").drop("doc", "bucket")

    def search(self, query: str, is_regex: bool = False, file_pattern: str = "") -> DataFrame:
        """The rows of search.matching_lines over the indexed files."""
        return scan.matching_lines(tables.lines(self.files(demands(query, is_regex))), query, is_regex, file_pattern)


def build(files: DataFrame, path: str, buckets: int = 64) -> Index:
    """An index of files (path, content, size_bytes). A file is named by a hash of its path: if two had the same, both would be read where one
    can match. Files without content are kept and have no trigrams."""
    spark = files.sparkSession
    own = files.select("path", "content", "size_bytes", F.xxhash64("path").alias("doc"))
    own.withColumn("bucket", F.pmod("doc", F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/files")

    def run(batches):
        def rows(texts, docs):
            """Of each trigram the texts that have it; a trigram across two texts is none."""
            c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            size = np.array([len(x) for x in texts])
            text = np.repeat(np.arange(len(texts)), size)
            gram, text = (c[:-2] << 42 | c[1:-1] << 21 | c[2:], text[: len(c) - 2]) if len(c) > 2 else (c[:0], text[:0])
            own = np.arange(len(gram)) + 2 < np.cumsum(size)[text]
            gram, text = gram[own], text[own]
            order = np.argsort(gram, kind="stable")  # texts stay in order
            gram, text = gram[order], text[order]
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
            gram, text = gram[first], text[first]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            for k in range(0, len(starts), 50_000):
                part = starts[k : k + 50_000]
                end = starts[k + 50_000] if k + 50_000 < len(starts) else len(gram)
                lists = pa.ListArray.from_arrays(pa.array(np.append(part - part[0], end - part[0]).astype(np.int32)), pa.array(docs[text[part[0] : end]]))
                yield pa.RecordBatch.from_arrays([pa.array(gram[part]), lists], ["gram", "docs"])

        held, docs, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(normal(text))
                docs.append(doc)
                size += len(held[-1])
                if size >= _AT_ONCE:
                    yield from rows(held, np.array(docs))
                    held, docs, size = [], [], 0
        if held:
            yield from rows(held, np.array(docs))

    # dealt out by trigram and by files, without a look at the rows before: a trigram that all files have is in several files of the index
    postings = own.where("content is not null").select("doc", F.lower("content")).mapInArrow(run, _POSTINGS)
    postings.repartition("gram", F.pmod(F.get("docs", F.lit(0)), F.lit(8))).sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    return Index(spark, path, buckets)


# ---- many identifiers ----------------------------------------------------------------------------------------------


def holding(files: DataFrame, identifiers: dict[str, str]) -> DataFrame:
    """path, identifier, low of the files whose content has an identifier without regard to case: one automaton finds all of them in one look at a content.
    identifiers: each with its lower case."""
    import ahocorasick

    kind = "path string, identifier string, low string"
    names = list(identifiers)

    def run(batches):
        a = ahocorasick.Automaton()
        by_low: dict[str, list[int]] = {}
        for k, i in enumerate(names):
            by_low.setdefault(identifiers[i], []).append(k)
        for low, own in by_low.items():
            if low:
                a.add_word(low, own)
        a.make_automaton()
        for b in batches:
            paths, at = b.column(0).to_pylist(), []
            for row, text in enumerate(b.column(1).to_pylist()):
                hits = {k for _, own in a.iter(text) for k in own} | set(by_low.get("", []))
                at += [(row, k) for k in sorted(hits)]
            rows = [[paths[r] for r, _ in at], [names[k] for _, k in at], [identifiers[names[k]] for _, k in at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], ["path", "identifier", "low"])

    if not any(identifiers.values()):  # an automaton without words
        every = F.array(*[F.struct(F.lit(i).alias("identifier"), F.lit("").alias("low")) for i in names]).cast("array<struct<identifier:string,low:string>>")
        return files.where("content is not null").select("path", F.explode(every).alias("w")).select("path", "w.*")
    return files.where("content is not null").select("path", F.lower("content").alias("low")).mapInArrow(run, kind)
