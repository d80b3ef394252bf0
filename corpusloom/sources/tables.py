"""Corpus tables derived from the benchmark's tables, so that every query runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, size_bytes of each document; four suffixes by turns."""
    d = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("py", "ts", "go", "sql")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    return d.select(path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text. A last empty piece is no line; one carriage return at the end of a line goes."""
    parts = F.split("content", "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    exploded = files.select("path", F.posexplode(parts).alias("at", "raw"))
    return exploded.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: the brand is the file, the size the line, the type kind and signature."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("function", "class", "method", "constant", "type")])
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"),
        F.col("p_brand").alias("file"), F.lit("python").alias("language"), F.col("p_size").alias("line"), (F.col("p_size") + 3).alias("end_line"),
        F.col("p_type").alias("signature"), F.lit("").alias("summary"), F.lit("").alias("docstring"), F.split("p_name", " ").alias("keywords"),
        F.floor("p_retailprice").cast("int").alias("byte_length"), F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("content_hash"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as import records: source_file, specifier, names, resolved."""
    g = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return g.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source_file"), F.explode(hrefs).alias("specifier")).select(
        "source_file", "specifier", F.array(tx.path_base(F.col("specifier"))).alias("names"), F.col("specifier").alias("resolved")
    )


def edges(spark: SparkSession, sf_dir: str, orders: str = "true") -> DataFrame:
    """A directed graph of suppliers from line items (those that meet the condition `orders`): source, target; distinct, no loops."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    li = table(spark, sf_dir, "lineitem").where(orders).crossJoin(F.broadcast(suppliers))  # one row
    found = li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % F.col("n")).alias("target"))
    return found.where("source <> target").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """namespace, id, embedding, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("main").alias("namespace"), F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: tokens and durations from their value."""
    e = table(spark, sf_dir, "events")
    tokens = F.floor(F.abs(F.col("value"))).cast("long")
    return e.select(
        F.col("ts").alias("captured_at"), F.col("event_type").alias("tool_name"), F.col("user_id").alias("session"), F.abs("value").alias("duration_ms"),
        tokens.alias("request_tokens"), (tokens * 2).alias("response_tokens"), (tokens * 3).alias("total_tokens"),
        (tokens + 5).alias("input_tokens_saved"), (F.col("event_id") % 7).cast("long").alias("output_tokens_saved"), F.col("event_id"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of file changes: folder, path, change_type, event_time, seq."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "modified", "view", "modified", "signup", "added", "purchase", "added", "error", "deleted")])
    return e.select((F.col("user_id") % 10).cast("int").alias("folder"), F.col("user_id").cast("string").alias("path"), F.element_at(kind, F.col("event_type")).alias("change_type"), F.col("ts").alias("event_time"), F.col("event_id").alias("seq"))
