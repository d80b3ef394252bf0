"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import langid, licenses, oracles, outliers, packing, quality, simhash, spelling, suffix, toxicity, urls, warc, whitening
from ._columns import named
from ._store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.reject_outliers(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dc.digest(dc.decontaminate(docs, _table(spark, sf_dir, "benchmark")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(_table(spark, sf_dir, "documents"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(_table(spark, sf_dir, "pages"))


def _remainder(divisor: int, doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo divisor; a null id has none and is never held out."""
    return F.pmod(F.crc32(named(doc_id).cast("string")), F.lit(divisor))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.coalesce(_remainder(5) != 0, F.lit(True))))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def training(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learnt."""
    return docs.where(F.coalesce(_remainder(4, doc_id) != 2, F.lit(True)))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, cuts = toxicity.fit(training(docs), _table(spark, sf_dir, "labels"))
    found = toxicity.flag(toxicity.score(docs, model), cuts)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    stats = Scratch(spark, "quality").save(quality.statistics(docs, [F.col("doc_id"), held_out]), "statistics")
    model = quality.train(stats.where("not _keep1"), _table(spark, sf_dir, "labels"))
    scored = stats.select(F.col("_keep0").alias("doc_id"), F.col("_keep1").alias("held_out"), quality.logistic(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_sort(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
        F.get(best, F.lit(0))["license"].alias("best_license"), F.round(-F.get(best, F.lit(0))["d"], 6).alias("best_dice"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(_table(spark, sf_dir, "embeddings"))


#: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mcd_outliers, op2_decontaminate, op3_best_fit_packing, op4_suffix_dedup, op6_simhash_golay, op7_warc, op8_language_id, op9_quality_qda, op5_toxicity_cnn,
        op10_license_scan, op11_embedding_whitening, op12_url_filters, op13_spelling_variants,
    )
}
#: The others need a tokenizer, a fingerprint, a trained model or a choice among overlapping runs; tests compare them with plain versions or by held-out rows.
ORACLE_SQL = {"op2_decontaminate": oracles.DECONTAMINATE, "op4_suffix_dedup": oracles.SUFFIX, "op7_warc": oracles.WARC, "op12_url_filters": oracles.url_filters(URL_RULES)}
