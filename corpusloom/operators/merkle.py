"""A Merkle tree of a corpus: digests folded from files to the root, and differences found by going down only where digests differ.

A directory's children are dealt into blocks by a hash of their names. A block's digest is the SHA-256 of its children's entries in order of names, and a
directory's that of its blocks' digests in order. So no list is longer than a block, however many children a directory has, and a
changed child makes one block of its directory differ. A stored tree has its rows in buckets; a comparison reads, level by level, only the
buckets of blocks and directories that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Steps

#: Hexadecimal digits of a name's SHA-256 that make its block.
BLOCK_DIGITS = 3

_CHILD = "directory string, block string, name string, kind string, digest string, file_count long, size_bytes long"
_BLOCK = "directory string, block string, digest string"


def _block(name: Column) -> Column:
    return F.substring(F.sha2(name.cast("binary"), 256), 1, BLOCK_DIGITS)


def _entry() -> Column:
    return F.concat("name", F.lit("\0"), "kind", F.lit("\0"), "digest", F.lit("\n"))


def _above(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def fold(files: DataFrame, name: str = "merkle") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(directories, blocks, children) of files (path, content or content_hash, size_bytes).

    directories: directory (the root is blank), digest, file_count, size_bytes. One round for each level of depth, from the deepest up; a
    round's table is written, so that the next one does not compute it again. An empty table gives the root alone, with the digest of nothing."""
    steps = Steps(files.sparkSession, name)
    digest = F.col("content_hash") if "content_hash" in files.columns else F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
    path = F.col("path")
    own = files.select(_above(path).alias("directory"), _base(path).alias("name"), F.lit("f").alias("kind"), digest.alias("digest"), F.lit(1).cast("long").alias("file_count"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    own = steps.save(own.withColumn("block", _block(F.col("name"))).withColumn("depth", depth))
    deepest = own.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    children = blocks = directories = None
    below = None
    for level in range(deepest, -1, -1):
        here = own.where(F.col("depth") == level).drop("depth").select(*[c.split()[0] for c in _CHILD.split(", ")])
        if below is not None:
            up = below.select(_above(F.col("directory")).alias("directory"), _base(F.col("directory")).alias("name"), F.lit("d").alias("kind"), "digest", "file_count", "size_bytes")
            here = here.unionByName(up.withColumn("block", _block(F.col("name"))))
        here = steps.save(here)
        sums = F.sum("file_count").alias("file_count"), F.sum("size_bytes").alias("size_bytes")
        part = here.groupBy("directory", "block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", _entry().alias("e")))), lambda x: x["e"]), ""), 256).alias("digest"), *sums)
        part = steps.save(part)
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: F.concat(x["block"], x["digest"])), ""), 256)
        below = steps.save(part.groupBy("directory").agg(whole.alias("digest"), *sums))
        part = part.select("directory", "block", "digest")
        children, blocks, directories = (x if y is None else y.unionByName(x) for x, y in ((here, children), (part, blocks), (below, directories)))
    if not own.head(1):
        directories = files.sparkSession.range(1).select(F.lit("").alias("directory"), F.sha2(F.lit("").cast("binary"), 256).alias("digest"), F.lit(0).cast("long").alias("file_count"), F.lit(0).cast("long").alias("size_bytes"))
    return directories, blocks, children


class Tree:
    """A stored tree: blocks and children in buckets of their own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def write(self, files: DataFrame) -> Tree:
        directories, blocks, children = fold(files)
        directories.where("directory = ''").write.parquet(f"{self.path}/root")
        for df, name, by in ((blocks, "blocks", ["directory"]), (children, "children", ["directory", "block"])):
            df.withColumn("bucket", self._bucket(*by)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return self

    def digest(self) -> str:
        return self.spark.read.parquet(f"{self.path}/root").first().digest

    def read(self, name: str, buckets: list[int]) -> DataFrame:
        """The rows of some buckets of `blocks` or `children`: other buckets' files are not listed as input."""
        schema = f"{_BLOCK if name == 'blocks' else _CHILD}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(*buckets)).drop("bucket")

    def of(self, name: str, wanted: DataFrame, *by: str) -> DataFrame:
        """The rows whose key is among the wanted ones. Only bucket numbers reach the driver."""
        buckets = [r[0] for r in wanted.select(self._bucket(*by).alias("b")).distinct().collect()]
        return self.read(name, buckets).join(wanted.select(*by), [*by], "left_semi")


def _differing(a: DataFrame, b: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Keys whose values differ or that one side lacks, with both sides as structs."""
    side = lambda df, n: df.select(*keys, F.struct(*values).alias(n))
    return side(a, "a").join(side(b, "b"), keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def diff(before: Tree, after: Tree) -> DataFrame:
    """path, change (new, changed, deleted) of the files that differ between two stored trees. A round for each level on which something differs; where
    the roots are equal nothing is read. A file in the place of a directory is new, and what was below the directory is deleted."""
    spark = before.spark
    if before.digest() == after.digest():
        return spark.createDataFrame([], "path string, change string")
    steps = Steps(spark, "merkle-diff")
    frontier, found = spark.createDataFrame([("",)], "directory string"), []
    while True:
        blocks = _differing(before.of("blocks", frontier, "directory"), after.of("blocks", frontier, "directory"), ["directory", "block"], "digest")
        blocks = steps.save(blocks.select("directory", "block"))
        key = ["directory", "block"]
        met = steps.save(_differing(before.of("children", blocks, *key), after.of("children", blocks, *key), [*key, "name"], "kind", "digest"))
        path = F.concat(F.when(F.col("directory") == "", "").otherwise(F.concat("directory", F.lit("/"))), "name")
        was, now = F.coalesce(F.col("a.kind") == "f", F.lit(False)), F.coalesce(F.col("b.kind") == "f", F.lit(False))
        change = F.when(was & now, "changed").when(now, "new").when(was, "deleted")
        found.append(met.select(path.alias("path"), change.alias("change")).where("change is not null"))
        frontier = met.where((F.coalesce(F.col("a.kind") == "d", F.lit(False))) | (F.coalesce(F.col("b.kind") == "d", F.lit(False)))).select(path.alias("directory"))
        if not frontier.head(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# ---- nested trees --------------------------------------------------------------------------------------------------

#: Characters of a run of neighbours that one row holds before a directory's runs are joined.
_RUN = 1 << 20


def _runs(batches):
    """Sorted rows (directory, name, json) to runs of neighbours: directory, at, run."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    directory, held, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([directory]), pa.array([part << 32 | n]), pa.array([",".join(held)])], ["directory", "at", "run"])

    for b in batches:
        for d, json in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held and (d != directory or size > _RUN):
                yield out()
                n, held, size = n + 1, [], 0
            directory = d
            held.append(json)
            size += len(json)
    if held:
        yield out()


def nested(files: DataFrame, prefix: str = "", summaries: bool = False) -> DataFrame:
    """directory, tree: for each directory of the paths that begin with prefix, below the prefix, the JSON list of its children by name, with their own children
    inside; the root is blank. A file has path, type, language and symbol_count; a directory path (its name and a slash), type and children. A
    directory hides a file of the same name.

    Built from the deepest level up. Children are laid out and sorted by range, so a directory of very many children is dealt over many tasks, which join
    runs of neighbours; one row holds a directory's finished text."""
    from ..functions import text as tx

    steps = Steps(files.sparkSession, "nested")
    path = F.col("path")
    relative = F.regexp_replace(F.regexp_replace(F.substring(path, len(prefix) + 1, F.length(path)), "^/", ""), "/+", "/")
    fields = [tx.language_of(path).alias("language"), path.alias("path"), F.lit(0).alias("symbol_count"), *([F.lit("").alias("summary")] if summaries else []), F.lit("file").alias("type")]
    own = files.where(F.startswith(path, F.lit(prefix))).select(relative.alias("r"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")).where(~F.endswith("r", F.lit("/")) & (F.col("r") != ""))
    own = own.select(_above(F.col("r")).alias("directory"), _base(F.col("r")).alias("name"), "json")
    own = steps.save(own.withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))))
    out, below = None, None
    for level in range(own.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], -1, -1):
        here = own.where(F.col("depth") == level).select("directory", "name", "json")
        if below is not None:
            tail = F.to_json(F.struct(F.concat(_base(F.col("directory")), F.lit("/")).alias("path"), F.lit("dir").alias("type")))
            node = F.concat(F.lit('{"children":'), "tree", F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))
            up = below.select(_above(F.col("directory")).alias("directory"), _base(F.col("directory")).alias("name"), node.alias("json"))
            here = here.join(up.select("directory", "name"), ["directory", "name"], "left_anti").unionByName(up)
        here = steps.save(here).repartitionByRange("directory", "name").sortWithinPartitions("directory", "name")
        runs = here.mapInArrow(_runs, "directory string, at long, run string")
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "run"))), lambda x: x["run"]), ",")
        below = steps.save(runs.groupBy("directory").agg(F.concat(F.lit("["), whole, F.lit("]")).alias("tree")))
        out = below if out is None else out.unionByName(below)
    return out
