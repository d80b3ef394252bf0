"""What is in the corpus: trees, outlines, contents, differences, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: Directories that are never entered, hints of secrets in a base name, suffixes of documentation, directories that come first, the
#: size of a file at most, and the reasons why files are left out.
SKIPPED_DIRECTORIES = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "dist", "build", "target", "coverage", "__pycache__")
SECRET_HINTS = (".env", "api_key", "apikey", "credential", "credentials", "id_rsa", "passwd", "password", "private_key", "secret", "token")
DOCUMENT_SUFFIXES = (".adoc", ".markdown", ".md", ".mdown", ".mkd", ".mkdn", ".rst", ".text", ".txt", ".wiki")
PRIORITY_DIRECTORIES = ("src", "lib", "pkg", "cmd", "internal")
MOST_BYTES = 500 * 1024
SKIP_REASONS = ("skip_dir", "symlink", "symlink_escape", "path_traversal", "skip_file", "gitignore", "extra_ignore", "secret", "wrong_extension", "too_large", "unreadable", "binary", "file_limit")


def file_tree(files: DataFrame, prefix: str = "") -> DataFrame:
    """Every directory on the way to a file, with the number and bytes of the files below it; `(root)` for all."""
    own = files.where(F.startswith("path", F.lit(prefix))) if prefix else files
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    dirs = own.select("size_bytes", F.explode(F.concat(F.array(F.lit("(root)")), above)).alias("directory"))
    return dirs.groupBy("directory").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))


def repo_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts by top directory, by symbol kind, by language: section, key, n."""
    top = F.when(F.contains("path", F.lit("/")), F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"))).otherwise("(root)")
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "unknown").otherwise(F.col("kind"))
    section = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")
    languages = files.select(tx.language_of(F.col("path")).alias("language")).where("language is not null")
    return section(files, "directories", top).unionByName(section(symbols, "kinds", kind)).unionByName(section(languages, "languages", F.col("language")))


def staleness(indexed_at: Column, now: Column, days: int = 7) -> Column:
    """true after so many whole days, else null."""
    return F.when(F.floor((F.unix_timestamp(now) - F.unix_timestamp(indexed_at)) / 86400) >= days, True)


def content_slice(files: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end (clamped to what there is) of each file, joined with line feeds and without carriage returns."""
    parts = F.split("content", "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    df = files.select("path", parts.alias("parts"))
    last = F.greatest(F.size("parts"), F.lit(1))
    first = tx.clamp(F.lit(start), 1, last)
    until = F.least(F.greatest(F.lit(end), first), last)
    body = F.transform(F.slice("parts", first, until - first + 1), lambda x: F.regexp_replace(x, "\r$", ""))
    return df.select("path", first.alias("start_line"), until.alias("end_line"), F.size("parts").alias("line_count"), F.array_join(body, "\n").alias("content"))


def file_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each file with the number and names (in line order) of its symbols."""
    own = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbol_count"), F.array_sort(F.collect_list(F.struct("line", "id", "name"))).alias("own"))
    return files.join(own, "path", "left").select("path", tx.language_of(F.col("path")).alias("language"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce(F.array_join(F.transform("own", lambda s: s["name"]), ","), F.lit("")).alias("names"))


def file_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, change (new, deleted, changed) between two tables of path and content_hash."""
    a, b = stored.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    met = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def symbol_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, kind, status (added, removed, changed, unchanged), hash_changed. Of symbols that share name and kind the first by file,
    line and id stands for all."""
    first = F.min_by(F.struct("file", "signature", "content_hash"), F.struct("file", "line", "id"))
    one = lambda df, n: df.groupBy("name", "kind").agg(first.alias(n))
    met = one(a, "a").join(one(b, "b"), ["name", "kind"], "full_outer")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    both = F.when(~blank(F.col("a.content_hash")), ~blank(F.col("b.content_hash")) & (F.col("a.content_hash") != F.col("b.content_hash"))).otherwise(~F.col("a.signature").eqNullSafe(F.col("b.signature")))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(both, "changed").otherwise("unchanged")
    known = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~blank(F.col("a.content_hash")) & ~blank(F.col("b.content_hash")), F.col("a.content_hash") != F.col("b.content_hash"))
    return met.select("name", "kind", F.coalesce("b.file", "a.file").alias("file"), status.alias("status"), known.alias("hash_changed"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Matches a subset of ignore files: `dir/` is a folder at the start of the path, a glob matches the path, or the base name if it has no
    slash, anything else is also a path or a folder at its start."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip().replace("\\", "/").removeprefix("./").removeprefix("/")
        if not p or p.startswith(("#", "!")):
            continue
        if p.endswith("/"):
            out = out | (path == p[:-1]) | F.startswith(path, F.lit(p))
            continue
        regex = tx.glob_to_regex(p)
        if regex:
            out = out | path.rlike(regex)
            if "/" not in p:
                out = out | tx.path_base(path).rlike(regex)
        if not any(c in p for c in "*?[]"):
            out = out | F.startswith(path, F.lit(f"{p}/"))
    return out


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """root, rules: the folder of each ignore file among the files (blank: the top), and its patterns as regular expressions: on_path for paths
    below the folder, on_base for base names (null where the pattern has a slash). The same subset of patterns as in ignored()."""
    own = files.where(tx.path_base(F.col("path")) == name).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("root"), F.split("content", r"\r?\n", -1).alias("lines"))
    bare = lambda x: F.regexp_replace(F.replace(tx.trim_unicode(x), F.lit("\\"), F.lit("/")), r"^(\./)?/?", "")
    patterns = F.filter(F.transform("lines", bare), lambda p: (p != "") & ~p.rlike("^[#!]"))
    literal = lambda p: F.regexp_replace(p, r"([.+^${}()|\\])", r"\\$1")
    glob = lambda p: F.replace(F.replace(literal(p), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    folder = lambda p: F.concat(F.lit("^"), literal(F.regexp_replace(p, "/$", "")), F.lit("(/.*)?$"))
    whole = lambda p: F.concat(F.lit("^"), glob(p), F.when(p.rlike(r"[*?\[\]]"), "$").otherwise("(/.*)?$"))
    rule = lambda p: F.struct(F.when(F.endswith(p, F.lit("/")), folder(p)).otherwise(whole(p)).alias("on_path"), F.when(~F.contains(p, F.lit("/")), F.concat(F.lit("^"), glob(p), F.lit("$"))).alias("on_base"))
    return own.select("root", F.transform(patterns, rule).alias("rules")).where(F.size("rules") > 0)


def scoped_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the files that an ignore file in one of their folders leaves out. A path meets the rules of its folders by equality: one row for
    each folder on its way, never all rules."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = files.select("path", F.explode(above).alias("root")).join(rules, "root")
    below = F.when(F.col("root") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("root") + 2, F.length("path")))
    base = tx.path_base(F.col("path"))
    hit = F.exists("rules", lambda r: F.rlike(below, r["on_path"]) | F.coalesce(F.rlike(base, r["on_base"]), F.lit(False)))
    return met.where(hit).select("path").distinct()


def likely_secret(path: Column, excluded: list[str] | None = None) -> Column:
    """A hint in the base name; not for documentation whose path has `secret`. An excluded hint or glob lets a match pass."""
    low = F.lower(tx.trim_unicode(path))
    base = tx.path_base(low)
    hit = F.lit(False)
    for hint in SECRET_HINTS:
        own = F.contains(base, F.lit(hint))
        for pattern in excluded or []:
            p = pattern.strip().lower().replace("\\", "/")
            if p == hint:
                own = F.lit(False)
            elif p and (regex := tx.glob_to_regex(p)):
                own = own & ~base.rlike(regex) & ~low.rlike(regex)
        hit = hit | own
    return hit & ~(F.contains(low, F.lit("secret")) & tx.path_extension(low).isin(*DOCUMENT_SUFFIXES))


def likely_binary(content: Column) -> Column:
    """A NUL anywhere, or over 30 % of the first 4096 bytes other than tab, line ends and printable ASCII."""
    codes = F.hex(F.substring(content.cast("binary"), 1, 4096))
    plain = F.regexp_count(codes, F.lit(r"\G(?:[0-9A-F]{2})*?(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])"))
    size = F.length(codes) / 2
    return F.when(F.octet_length(content) == 0, False).otherwise(F.locate("\0", F.decode(content.cast("binary"), "ISO-8859-1")).cast("int").__gt__(0) | (size - plain > 0.3 * size))


def discover(files: DataFrame, ignore: list[str] | None = None, extra_ignore: list[str] | None = None, excluded_secrets: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """files (path, size_bytes, content or none) with skip_reason, null for those that are taken: the first reason in order counts.

    With a cap, the files that come first by priority directory, depth and path are kept. The rank needs all taken files in one
    order; only their paths are sorted."""
    path = F.col("path")
    in_skipped = F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(*SKIPPED_DIRECTORIES))
    reason = (
        F.when(in_skipped, "skip_dir").when(path.rlike(r"(^|/)\.\.(/|$)"), "path_traversal").when(ignored(path, ignore or []), "gitignore").when(ignored(path, extra_ignore or []), "extra_ignore")
        .when(likely_secret(path, excluded_secrets), "secret").when(tx.language_of(path).isNull(), "wrong_extension").when(F.col("size_bytes") > MOST_BYTES, "too_large")
    )
    if "content" in files.columns:  # without contents, what paths and sizes tell
        reason = reason.when(F.col("content").isNull(), "unreadable").when(likely_binary(F.col("content")), "binary")
    out = files.withColumn("skip_reason", reason)
    return out if cap is None else limited(out, cap)


def limited(discovered: DataFrame, cap: int) -> DataFrame:
    """discovered with the reason file_limit for what is taken beyond the first `cap` files by priority directory, depth and path."""
    path = F.col("path")
    first = F.split_part(path, F.lit("/"), F.lit(1))
    rank = F.when(F.array_position(F.array(*[F.lit(x) for x in PRIORITY_DIRECTORIES]), first) > 0, F.array_position(F.array(*[F.lit(x) for x in PRIORITY_DIRECTORIES]), first)).otherwise(len(PRIORITY_DIRECTORIES) + 1)
    taken = discovered.where("skip_reason is null").select("path").orderBy(rank, F.size(F.split(path, "/")), "path").limit(cap).withColumn("_in", F.lit(True))
    met = discovered.join(taken, "path", "left")
    return met.withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & F.col("_in").isNull(), "file_limit").otherwise(F.col("skip_reason"))).drop("_in")


def discover_remote(listing: DataFrame, ignore: list[str] | None = None, extra_ignore: list[str] | None = None, excluded_secrets: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """raw_path, path, blob_sha, skip_reason of a remote tree's listing (path, size_bytes, blob_sha or null), before any content is fetched. A remote tree has an
    order of reasons of its own: the language is judged before secrets. path: without blanks and slashes at its ends, `.` parts and doubled slashes; a blank
    one is skip_file, one that leaves the tree path_traversal. A file without a blob hash has that of its path."""
    raw = F.coalesce("path", F.lit(""))
    bare = F.regexp_replace(tx.trim_unicode(F.replace(raw, F.lit("\\"), F.lit("/"))), r"^(\./)?/*|/+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: (p != "") & (p != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    df = listing.select(F.col("path").alias("raw_path"), "size_bytes", bare.alias("_bare"), fold.alias("_parts"), F.lower(tx.trim_unicode(F.col("blob_sha"))).alias("_sha"))
    df = df.withColumn("path", F.array_join("_parts", "/"))
    path = F.col("path")
    reason = (
        F.when(F.col("_bare") == "", "skip_file").when((path == "") | (F.get("_parts", F.lit(0)) == ".."), "path_traversal")
        .when(F.exists("_parts", lambda p: tx.trim_unicode(p).isin("", *SKIPPED_DIRECTORIES)), "skip_dir").when(ignored(path, ignore or []), "gitignore").when(ignored(path, extra_ignore or []), "extra_ignore")
        .when(tx.language_of(path).isNull(), "wrong_extension").when(likely_secret(path, excluded_secrets), "secret").when(F.col("size_bytes") > MOST_BYTES, "too_large")
    )
    sha = F.when(F.coalesce("_sha", F.lit("")) != "", F.col("_sha")).otherwise(F.sha2(path.cast("binary"), 256))
    out = df.select("raw_path", "path", sha.alias("blob_sha"), reason.alias("skip_reason"))
    return out if cap is None else limited(out, cap)


def skip_counts(discovered: DataFrame) -> DataFrame:
    """All reasons with their counts, zeros included."""
    spark = discovered.sparkSession
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in SKIP_REASONS])).alias("skip_reason"))
    counts = discovered.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))
    return keys.join(counts, "skip_reason", "left").select("skip_reason", F.coalesce("n", F.lit(0)).alias("n"))


def _entry() -> Column:
    return F.concat("path", F.lit("\0"), F.sha2(F.col("content").cast("binary"), 256), F.lit("\n"))


def tree_digest(files: DataFrame) -> DataFrame:
    """tree_sha256 and file_count by top directory, of any number of files: entries as in tree_hash, in blocks by the first three digits of the path's
    SHA-256; each block's sorted entries are digested, then the digests of a directory's blocks (4096 at most) in order. Equal trees have equal
    digests; they are not those of tree_hash."""
    block = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 3)
    parts = files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory"), block.alias("block")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(_entry())), ""), 256).alias("d"), F.count("*").alias("n"))
    return parts.groupBy("directory").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), ""), 256).alias("tree_sha256"), F.sum("n").alias("file_count"))


def tree_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over the sorted `path NUL hash LF` entries, by top directory: one digest over one sequence, so a directory's list of paths and
    digests is one row. For directories of very many files there is tree_digest."""
    entry = _entry()
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("tree_sha256"), F.count("*").alias("file_count"))


def fixture_digest(files: DataFrame) -> DataFrame:
    """digest and file_count of a fixture by top directory: SHA-256 over each path in order, a line feed, and the 32 bytes of the content's digest. One sequence, so
    a directory's list is one row; fixtures are small, and merkle.fold is the way for corpora."""
    entry = F.concat(F.hex(F.col("path").cast("binary")), F.lit("0A"), F.upper(F.sha2(F.col("content").cast("binary"), 256)))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), "")
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(F.concat(F.lit("sha256:"), F.sha2(F.unhex(own), 256)).alias("digest"), F.count("*").alias("file_count"))


def latest_per_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the longest root that contains it: a path is joined by equality with each of its own ancestors."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = paths.select("path", F.explode(above).alias("root")).join(roots.select("root", "repo"), "root")
    return met.groupBy("path").agg(F.max_by(F.struct("root", "repo"), F.struct(F.length("root"), "root")).alias("m")).select("path", "m.root", "m.repo")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
