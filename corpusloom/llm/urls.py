"""Verdicts on URLs from a table of rules, by hashes of host suffixes and path prefixes.

A rule is a host, a path and a verdict; it fits a URL of this host or of a subdomain whose path starts with the rule's. Each distinct URL is expanded
into expressions (a suffix of its host at a label's border, a prefix of its path), only of sizes that some rule has. Expressions meet rules in an
equi-join on the first digits of their SHA-256; the whole digest confirms, and of a URL's rules the longest wins. Then every row looks up its URL. A hot
URL is one row before it is expanded; a hot expression meets one rule in a join that adaptive execution splits, or no shuffle at all where
the rules are few enough to be sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import named, without

#: Hexadecimal digits of a digest that the join is on.
SHORT = 8
#: Rules of so many bytes in all are sent to every task; more are joined by shuffles.
SENT_BYTES = 16 << 20
#: Up to so many different lengths of rules' paths are listed one by one; beyond it a URL is expanded at every length up to the longest.
LISTED = 256
#: The verdict on a URL that no rule fits: a block list passes what it does not know.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end; A-Z in lower case. Empty for null and where there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """Neither a host nor the path of a URL holds a question mark."""
    return F.sha2(F.concat(host, F.lit("?"), path), 256)


def compiled(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with digests. Hosts are compared in lower case; a rule with a null host or path fits nothing; where two rules have
    the same host and path, block wins over allow."""
    host = F.translate("host", _UPPER, _LOWER)
    own = rules.where("host is not null and path is not null").groupBy(host.alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return own.withColumn("r_digest", digest).withColumn("short", F.substring("r_digest", 1, SHORT))


def expressions(urls: DataFrame, lengths: Column, labels: int) -> DataFrame:
    """urls (u_host, u_path, ...) with a row for each suffix of at most so many labels and each path prefix of one of these lengths: host, path."""
    parts = F.split("u_host", r"\.", -1)
    first = F.greatest(F.lit(1), F.size(parts) - F.lit(labels) + 1)
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    size = F.char_length("u_path")
    prefixes = F.transform(F.filter(lengths, lambda m: m <= size), lambda m: F.left(F.col("u_path"), m))
    return urls.withColumn("host", F.explode(suffixes)).withColumn("path", F.explode(prefixes))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (host and path of the one that decides, or null) and verdict, in the place of columns with these names.

    Of the rules that fit, the one with the most characters decides; of two equally long ones that with the longer host. A null url and
    one without :// have an empty host and path, which only a rule with an empty host can fit. Every row of pages is there once,
    repeated ones too; empty pages give an empty table, and without rules every verdict is the default."""
    known = compiled(rules)
    r = known.agg(
        F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 100), F.lit(0)).alias("size"), F.coalesce(F.max(F.size(F.split("r_host", r"\.", -1))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.char_length("r_path")), F.lit(0)).alias("longest"), F.count_distinct(F.char_length("r_path")).alias("lengths"),
    ).first()
    listed = sorted(x.n for x in known.select(F.char_length("r_path").alias("n")).distinct().collect()) if r.lengths <= LISTED else None
    lengths = F.sequence(F.lit(0), F.lit(r.longest)) if listed is None else F.array(*map(F.lit, listed)).cast("array<int>")
    own = pages.select(named(url).cast("string").alias("u_url")).where("u_url is not null").distinct()
    own = own.select("u_url", host_of(F.col("u_url")).alias("u_host"), path_of(F.col("u_url")).alias("u_path"))
    asked = expressions(own, lengths, r.labels).select("u_url", "host", "path", _digest(F.col("host"), F.col("path")).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    met = asked.join(F.broadcast(known) if r.size <= SENT_BYTES else known.hint("merge"), "short")
    met = met.where((F.col("digest") == F.col("r_digest")) & (F.col("host") == F.col("r_host")) & (F.col("path") == F.col("r_path")))
    rank = F.struct(F.char_length(F.concat("host", "path")).alias("size"), F.char_length("host").alias("own"), F.concat("host", "path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("u_url").agg(F.max(rank).alias("u_best"))
    rows = without(pages.withColumn("_u", named(url).cast("string")), ["host", "path", "rule", "verdict"])
    out = rows.join(best, F.col("_u") == F.col("u_url"), "left")
    own_columns = [named(c) for c in rows.columns if c != "_u"]
    return out.select(
        *own_columns, host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"), F.col("u_best.rule").alias("rule"),
        F.coalesce(F.col("u_best.verdict"), F.lit(default)).alias("verdict"),
    )
