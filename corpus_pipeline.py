"""Training sequences from raw documents, in five stages.

Each stage is one operator of corpusloom.llm over all that the stage before has kept, and its decisions hold: documents
go, or their texts change. The first four return the columns of `documents`; the last returns the packed pieces.

Stages number the columns while they work, so that names of columns, with dots or equal to those that operators add, do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, packing, quality, queries, simhash, suffix
from corpusloom.llm._columns import named
from corpusloom.llm._store import Scratch, cleared

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.7
#: Passages that are removed wherever they repeat: over 50 words. So many words fill this many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = suffix.PASSAGE_WORDS, suffix.PASSAGE_LENGTH


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns _d0, _d1, ..., and the names that doc_id and text have there."""
    number = {c: f"_d{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[named(c).alias(n) for c, n in number.items()]), number["doc_id"], number["text"]


def _renamed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names again."""
    return found.select(*[F.col(f"_d{k}").alias(c) for k, c in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores at LEAST_QUALITY or more. It is fitted on the labelled ones of this stage's input that are
    not held out; with too few labels, or no rows, nothing is rejected. A null or empty text scores as an empty one; repeated rows and ties
    score alike. Texts are read once: rows and statistics are written together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    stats = Scratch(spark, "quality").save(quality.statistics(docs, [named(c) for c in names]), "statistics")
    keys = [f"_keep{k}" for k in range(len(names))]
    doc_id = keys[names.index("doc_id")]
    model = quality.train(queries.training(stats, doc_id), labels, doc_id)
    kept = stats if model is None else stats.where(quality.logistic(model) >= LEAST_QUALITY)
    return kept.select(*[F.col(k).alias(c) for k, c in zip(keys, names)])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (linked fingerprints): the one with the smallest doc_id (a null one is the
    largest), then with the smallest text hash. Of rows that agree in both one stays. Null and empty texts are one group."""
    own, doc_id, text = _numbered(docs)
    found = simhash.near_duplicates(own, doc_id, text)
    lead = F.min(F.struct(F.col(doc_id).isNull().alias("none"), doc_id, "text_hash")).alias("first")
    leads = found.groupBy("root").agg(lead).select(F.col("first").getField(doc_id).alias("_id"), F.col("first.text_hash").alias("_hash"))
    own = own.withColumn("_text_hash", F.xxhash64(text))
    kept = own.join(leads, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    if found.groupBy(doc_id, "text_hash").count().where("count > 1").head(1):
        kept = kept.dropDuplicates([doc_id, "_text_hash"])
    return _renamed(kept, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages: runs of bytes, of PASSAGE_WORDS words or more, inside strings of PASSAGE_BYTES bytes that also start
    elsewhere (whole characters only). Documents of which nothing but white space is left go; null, empty and blank texts stay; rows with one
    text are copies of each other. n_chars follows the text. With no repeats, or no rows, all stays as it is."""
    own, _, text = _numbered(docs)
    cut = suffix.remove_repeats(own.withColumn("_before", F.octet_length(text)), text, PASSAGE_BYTES, PASSAGE_WORDS)
    emptied = (F.octet_length(text) < F.col("_before")) & (F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "")
    left = cut.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn(f"_d{docs.columns.index('n_chars')}", F.length(text).cast(docs.schema["n_chars"].dataType))
    return _renamed(left, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item. A null or empty text is clean; an empty benchmark leaves all; repeated rows
    stay or go together; columns named like those of the operator keep their values."""
    own, _, text = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(own, benchmark, text)
    return _renamed(found.where(~F.col("contaminated")), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: the pieces of all documents with their places. A null or empty text is one token; repeated rows
    are packed each; equal lengths fit in any order; no rows make no sequence. Other columns are not carried."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL for tokenizers and fingerprints; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` on; what a stage returns is written and read again. Tables that a stage needed are deleted when its
    result is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with cleared():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
