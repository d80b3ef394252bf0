"""Commits as a graph: how far one is ahead of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Steps


def generations(parents: DataFrame) -> DataFrame:
    """commit, generation of a table of (commit, parent; null for a first commit): the longest way down to a commit without parents, which has 1. A round for each
    generation that some commit is raised to; only what was raised goes on. Written once, it serves all later questions."""
    steps = Steps(parents.sparkSession, "generations")
    e = steps.save(parents.where("parent is not null").select("commit", "parent").distinct())
    every = parents.select("commit").unionByName(e.select(F.col("parent").alias("commit"))).distinct()
    known = steps.save(every.withColumn("generation", F.lit(1)))
    front = known
    while True:
        raised = e.join(front.select(F.col("commit").alias("parent"), "generation"), "parent").groupBy("commit").agg((F.max("generation") + 1).alias("up"))
        raised = steps.save(raised.join(known, "commit").where("up > generation").select("commit", F.col("up").alias("generation")))
        if not raised.head(1):
            return known
        known = steps.save(known.join(raised, "commit", "left_anti").unionByName(raised))
        front = raised


def _reached(parents: DataFrame, base: str, head: str) -> DataFrame:
    """commit: those that head can reach and base cannot. Both are followed to the first commits, a round for each step down. A round reads the parents, and writes
    what it meets for the first time; the parents are written once and never sorted."""
    spark = parents.sparkSession
    steps = Steps(spark, "reached")
    e = steps.save(parents.select("commit", "parent"))
    names = {"base": base, "head": head}
    there = e.agg(*[F.coalesce(F.bool_or((F.col("commit") == x) | F.coalesce(F.col("parent") == x, F.lit(False))), F.lit(False)).alias(k) for k, x in names.items()]).first()
    if missing := sorted(x for k, x in names.items() if not there[k]):
        raise ValueError(f"Commit not found: {missing[0]}")
    front = seen = steps.save(spark.createDataFrame([(base, True), (head, False)], "commit string, of_base boolean"))
    met, first = e.where("parent is not null"), steps.n
    while front.head(1):
        below = front.join(met, "commit").select(F.col("parent").alias("commit"), "of_base").distinct()
        front = steps.save(below.join(seen, ["commit", "of_base"], "left_anti"))
        seen = spark.read.schema(front.schema).parquet(*[f"{steps.path}/{k}" for k in range(first, steps.n + 1)])
    return seen.where("not of_base").select("commit").join(seen.where("of_base").select("commit"), "commit", "left_anti")


def ahead(parents: DataFrame, base: str, head: str, generation: DataFrame | None = None) -> DataFrame:
    """commit: those that head can reach and base cannot, as a count of them tells how far head is ahead. A head or base that is not in the table is an error.

    With generations, which are written once for many questions, both sides go down together, the commits of the highest generations first: a commit is judged when
    everything that can reach it has been. A round takes all waiting commits that no other waiting commit can reach by their generations, and it ends as soon as only
    commits are waiting that base reaches, so that history below the fork stays unread. Without them both are followed to the first commits: generations of all
    commits cost more than one question."""
    if generation is None:
        return _reached(parents, base, head)
    steps = Steps(parents.sparkSession, "ahead")
    e = parents.where("parent is not null").select("commit", "parent").distinct()
    g = generation
    start = g.where(F.col("commit").isin(base, head)).withColumn("of_base", F.col("commit") == base).withColumn("of_head", F.col("commit") == head)
    known = {r["commit"] for r in start.collect()}  # two at most
    if missing := {base, head} - known:
        raise ValueError(f"Commit not found: {sorted(missing)[0]}")
    waiting, found = steps.save(start), None
    while waiting.where("of_head and not of_base").head(1):
        top = waiting.agg(F.max("generation")).first()[0]
        now = waiting.where(F.col("generation") == top)
        own = steps.save(now.where("of_head and not of_base").select("commit"))
        found = own if found is None else found.unionByName(own)
        below = now.join(e, "commit").select(F.col("parent").alias("commit"), "of_base", "of_head").join(g, "commit").select("commit", "generation", "of_base", "of_head")
        rest = waiting.where(F.col("generation") < top).select("commit", "generation", "of_base", "of_head").unionByName(below)
        waiting = steps.save(rest.groupBy("commit", "generation").agg(F.bool_or("of_base").alias("of_base"), F.bool_or("of_head").alias("of_head")))
    return found if found is not None else start.where("false").select("commit")


def distance(parents: DataFrame, base: str, head: str, generation: DataFrame | None = None) -> int:
    """How many commits head has that base has not."""
    return ahead(parents, base, head, generation).count()
