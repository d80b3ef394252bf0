"""Symbol search, relations, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import Steps

#: Kinds that can be asked for.
KINDS = ("function", "class", "method", "constant", "type", "template", "import")


def normalise(rows: DataFrame) -> DataFrame:
    """Symbols with the defaults that queries rely on; rows without id, name or file go; of equal ids the first by file and line stays."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.greatest(F.coalesce("line", F.lit(0)), F.lit(0))
    size = F.octet_length(F.concat(blank("name"), blank("signature"), blank("summary"), blank("docstring")))
    out = rows.where((F.trim(blank("id")) != "") & (F.trim(blank("name")) != "") & (F.trim(blank("file")) != "")).withColumns({
        "line": line, "end_line": F.greatest(line, F.coalesce("end_line", F.lit(0))),
        "language": F.coalesce(F.nullif(F.lower(F.trim(blank("language"))), F.lit("")), tx.language_of(F.col("file"))),
        "byte_length": F.greatest(F.when(F.coalesce("byte_length", F.lit(0)) > 0, F.col("byte_length")).otherwise(size), F.lit(20)),
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
    })
    return out.withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy("file", "line"))).where("_rn = 1").drop("_rn")


def centrality(symbols: DataFrame) -> DataFrame:
    """symbols with centrality: 0.3 ln n for the n symbols of a file, 0 for one. Counted and joined by file before any filter, so
    that a crowded file is a sum of partial counts."""
    per_file = symbols.groupBy("file").agg(F.count("*").alias("_n")).select("file", F.when(F.col("_n") > 1, 0.3 * F.log(F.col("_n").cast("double"))).otherwise(0.0).alias("centrality"))
    return symbols.join(per_file, "file")


def _frequency(tokens: Column, terms: list[str]) -> Column:
    """How many of the tokens are each of the terms, in sum."""
    return F.size(F.filter(tokens, lambda t: t.isin(*terms)))


def search(symbols: DataFrame, query: str, kind: str = "", language: str = "", file_pattern: str = "") -> DataFrame:
    """symbols with lexical and score, those that match: name tokens count 3, keywords and signature 2, summary and docstring 1, and 50
    if the name is the query. An empty query keeps symbols with centrality."""
    if len(query.encode()) > 500:
        raise ValueError("the query is longer than 500 bytes")
    terms = tx.unique_terms(tx.tokens_of(query)) or ([query.strip().lower()] if query.strip() else [])
    df = centrality(symbols)
    if kind:
        df = df.where(F.lower("kind") == kind.lower())
    if language:
        df = df.where(F.lower("language") == language.lower())
    df = df.where(tx.matches_path(F.col("file"), file_pattern))
    if not terms:
        return df.where("centrality > 0").withColumns({"lexical": F.lit(0.0), "score": F.col("centrality")})
    tokens = lambda c: tx.tokenize(F.coalesce(F.col(c), F.lit("")))
    keywords = F.flatten(F.transform("keywords", tx.tokenize))
    lexical = 3 * _frequency(tokens("name"), terms) + 2 * _frequency(keywords, terms) + 2 * _frequency(tokens("signature"), terms) + _frequency(tokens("summary"), terms) + _frequency(tokens("docstring"), terms)
    lexical = (lexical + F.when(F.lower("name") == " ".join(terms), 50).otherwise(0)).cast("double")
    return df.withColumn("lexical", lexical).where("lexical > 0").withColumn("score", F.col("lexical") + F.col("centrality"))


def ranked(found: DataFrame, most: int = 10) -> DataFrame:
    return found.orderBy(F.desc("score"), "file", "line", "name", "id").limit(max(1, min(most, 100)))


def pack_budget(found: DataFrame, token_budget: int, least_bytes: int = 20) -> DataFrame:
    """Best first, each symbol that still fits 4 bytes a token; later, smaller ones may fit after a skip.

    Every taken symbol has at least `least_bytes`, so only the best `budget / least_bytes` of each size can be taken: that many of
    each byte_length are kept before the fold, and the fold is over a bounded list."""
    budget = token_budget * 4
    order = [F.desc("score"), F.col("file"), F.col("line"), F.col("name"), F.col("id")]
    per_size = W.partitionBy("byte_length").orderBy(*order)
    few = found.where(F.col("byte_length") <= budget).withColumn("_k", F.row_number().over(per_size)).where(F.col("_k") * F.col("byte_length") <= budget).drop("_k")
    rank = F.row_number().over(W.orderBy(*order))
    rows = few.withColumn("rank", rank)
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "byte_length"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,rank:int>>").alias("taken"))
    fold = F.aggregate("all", start, lambda a, s: F.when(a["used"] + s["byte_length"] <= budget, F.struct((a["used"] + s["byte_length"]).alias("used"), F.concat(a["taken"], F.array(F.struct(s["id"].alias("id"), s["rank"].alias("rank")))).alias("taken"))).otherwise(a))
    return lists.select(fold.alias("f")).select((F.floor(F.col("f.used") / 4)).cast("long").alias("tokens_used"), F.explode("f.taken").alias("t")).select("t.rank", "t.id", "tokens_used")


def related(symbols: DataFrame, imports: DataFrame, symbol_id: str, most: int = 10) -> DataFrame:
    """Other symbols by relation to one: same file 3, else an importer in common 1.5, and 0.5 for each shared name token."""
    target = symbols.where(F.col("id") == symbol_id).select(F.col("file").alias("_file"), tx.tokenize(F.col("name")).alias("_tokens")).limit(1)
    who = imports.where("resolved is not null").select(F.col("resolved").alias("file"), "source_file").distinct()
    mine = who.join(F.broadcast(target), F.col("file") == F.col("_file"), "left_semi").select("source_file")
    shared = who.join(mine, "source_file", "left_semi").select("file").distinct().withColumn("_shared", F.lit(True))
    met = symbols.where(F.col("id") != symbol_id).crossJoin(F.broadcast(target)).join(shared, "file", "left")  # one row
    overlap = F.size(F.array_intersect(F.array_distinct(tx.tokenize(F.col("name"))), "_tokens"))
    score = F.when(F.col("file") == F.col("_file"), 3.0).when(F.col("_shared"), 1.5).otherwise(0.0) + 0.5 * overlap
    return met.withColumn("score", score).where("score > 0").select("id", "name", "kind", "file", "line", F.round("score", 2).alias("score")).orderBy(F.desc("score"), "file", "name", "id").limit(max(1, min(most, 50)))


def keyword_histogram(symbols: DataFrame, most: int = 15) -> DataFrame:
    words = symbols.select(F.explode("keywords").alias("k")).select(F.lower(F.trim("k")).alias("keyword")).where("keyword <> ''")
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(most)


def most_imported(imports: DataFrame, most: int = 8) -> DataFrame:
    """Files by the number of import records that resolve to them."""
    return imports.where("resolved is not null and resolved <> ''").groupBy(F.col("resolved").alias("file")).agg(F.count("*").alias("imported_by")).orderBy(F.desc("imported_by"), "file").limit(most)


#: Where a signature names bases.
_EXTENDS = r"(?i)\bextends\s+([A-Za-z0-9_$.,\s]+)"
_IMPLEMENTS = r"(?i)\bimplements\s+([A-Za-z0-9_$.,\s]+)"
_IN_PARENTHESES = r"(?i)\bclass\s+\w[\w$]*\s*\(([^)]+)\)"
_EXTERNAL = r"^[A-Z][\w.]*$"


def class_bases(symbols: DataFrame) -> DataFrame:
    """name, base of each class: what follows extends (up to implements, which is no base) and implements, else the capitalised names in the
    parentheses of a definition. A base ends where a brace, a parenthesis or a type parameter begins."""
    own = symbols.where(F.lower("kind") == "class").select("name", F.coalesce("signature", F.lit("")).alias("sig"))
    bare = lambda b: tx.trim_unicode(F.regexp_extract(b, r"^([^{(<]*)", 1))
    names = lambda text: F.filter(F.transform(F.split(text, ","), bare), lambda b: b != "")
    extends = F.regexp_replace(F.regexp_extract("sig", _EXTENDS, 1), r"(?is)(^|\s)implements\b.*$", "")
    named = F.concat(names(extends), names(F.regexp_extract("sig", _IMPLEMENTS, 1)))
    inside = F.filter(names(F.regexp_extract("sig", _IN_PARENTHESES, 1)), lambda b: b.rlike(_EXTERNAL))
    return own.select("name", F.explode(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(inside))).alias("base")).where("name <> base").distinct()


def closure(bases: DataFrame, start: str, up: bool = True) -> DataFrame:
    """All ancestors (or descendants) of a class with the level at which each is first met, however many levels there are. The frontier is a table:
    each level is one join with the bases, and only classes not met before go on, so that cycles end."""
    spark = bases.sparkSession
    near, far = ("name", "base") if up else ("base", "name")
    written = Steps(spark, "closure")
    steps = written.save(bases.select(F.col(near).alias("near"), F.col(far).alias("far")))
    seen = front = spark.createDataFrame([(start, 0)], "name string, level int")
    level = 0
    while True:
        level += 1
        met = front.join(steps, front.name == steps.near).select(F.col("far").alias("name")).distinct()
        front = written.save(met.join(seen.select("name"), "name", "left_anti").withColumn("level", F.lit(level)))
        if not front.head(1):
            return seen.where("level > 0")
        seen = written.save(seen.unionByName(front))


#: Ids of a block of token_overlap on either side, about.
_BLOCK = 500


def token_overlap(symbols: DataFrame, asked: Column) -> DataFrame:
    """a, b, overlap: symbols b (id, name) whose names share tokens with those of the asked symbols a, and how many; rows with one id count together.

    Ids are met only once they are told apart by their tokens: lists of tokens are compared once for all ids that have them, and the pairs of ids are
    blocks of two bounded lists, dealt out evenly and taken apart in place, a b at a time: a task holds the pairs of one b, not of a whole block. No
    pair of ids is shuffled, sorted or counted; an id is looked for only among those with its own tokens."""
    tokens = F.array_distinct(tx.tokenize(F.col("name")))
    own = symbols.where("id is not null").select("id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    own = own.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("tokens").agg(F.count("*").alias("n"))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / _BLOCK))
        return df.join(sizes, "tokens").groupBy(F.col("tokens").alias(f"{name}_tokens"), part.alias("part")).agg(F.collect_list("id").alias(f"{name}_ids")).drop("part")

    some = own.where(asked)
    words = lambda df, name: df.select("tokens").distinct().select(F.col("tokens").alias(f"{name}_tokens"), F.explode("tokens").alias("token"))
    shared = words(some, "a").join(words(own, "b"), "token").groupBy("a_tokens", "b_tokens").agg(F.count("*").cast("int").alias("overlap"))
    many = 16 * symbols.sparkSession.sparkContext.defaultParallelism  # stated: few bytes are many pairs, and would be joined into few tasks
    lists = shared.join(blocks(some, "a"), "a_tokens").repartition(many, F.xxhash64("a_ids", "b_tokens"))
    met = lists.join(blocks(own, "b"), "b_tokens").select("a_ids", "b_ids", "overlap", (F.col("a_tokens") == F.col("b_tokens")).alias("same"))
    dealt = met.repartition(many, F.xxhash64("a_ids", "b_ids"))
    by_b = dealt.select("a_ids", F.explode("b_ids").alias("b"), "overlap", "same")
    itself = F.col("same") & F.array_contains("a_ids", F.col("b"))
    others = F.when(itself, F.filter("a_ids", lambda a: a != F.col("b"))).otherwise(F.col("a_ids"))  # also parts the two loops: a lambda is not compiled with them
    return by_b.select(others.alias("a_ids"), "b", "overlap").select(F.explode("a_ids").alias("a"), "b", "overlap")
