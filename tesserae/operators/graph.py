"""Bounded walks over parent links and manifest trees, by links of doubling length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.scratch import saved


def walk(starts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(start, node, depth): each start (start, node) and what ``links`` (a, b) lead to in fewer than ``most`` steps.

    A table holds what was reached in fewer than 2^k steps beside the links of exactly 2^k steps. One join of it with those links
    makes the next one, so nine tables reach 512 steps. Nodes with several ways to them occur once for each; a cycle ends at ``most``.
    """
    at = F.lit(None)
    table = saved(
        links.select(F.lit(True).alias("link"), F.lit(None).cast(starts.schema["start"].dataType).alias("start"), F.col("a").alias("from"), F.col("b").alias("node"), at.cast("int").alias("depth"))
        .unionByName(starts.select(F.lit(False).alias("link"), "start", at.cast(links.schema["a"].dataType).alias("from"), "node", F.lit(0).alias("depth")))
    )
    step = 1
    while step < most:
        jump = table.where("link").select(F.col("from").alias("node"), F.col("node").alias("_to"))
        if not jump.take(1):
            break
        further = table.join(jump, "node").select("link", "start", "from", F.col("_to").alias("node"), (F.col("depth") + step).alias("depth"))
        further = further.where(F.col("link") | (F.col("depth") < most))
        step *= 2
        if step >= most:
            further = further.where("not link")
        table = saved(table.where("not link").unionByName(further))
    return table.where("not link").select("start", "node", "depth")


def ancestors(starts: DataFrame, parents: DataFrame, most: int) -> DataFrame:
    """(ref, commit, depth): each start (ref, commit) and its ancestors by ``parents`` (commit, parent), at most ``most`` commits."""
    links = parents.where("parent is not null").select(F.col("commit").alias("a"), F.col("parent").alias("b"))
    return walk(starts.select(F.col("ref").alias("start"), F.col("commit").alias("node")), links, most).toDF("ref", "commit", "depth")


def flatten(roots: DataFrame, children: DataFrame, levels: int = 8) -> DataFrame:
    """(root, node, depth): everything below each root by ``children`` (parent, child), to a bounded depth."""
    links = children.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return walk(roots.select(F.col("root").alias("start"), F.col("root").alias("node")), links, levels + 1).toDF("root", "node", "depth")


def rollup(own: DataFrame, children: DataFrame, parts: int, levels: int = 8) -> DataFrame:
    """(root, depth, leaves, ...): for each node of ``own`` (node, ...) the number of nodes at a depth below it and the sums of their other columns.

    It is what grouping :func:`flatten` would give, but totals of a level come from those of the level below, so no pair of a node and
    one above it is ever a row. Nodes with several ways to them count once for each. Work is in ``parts`` parts.
    """
    sums = [c for c in own.columns if c != "node"]
    links = saved(children.select("parent", "child").repartition(parts, "child"))
    level = own.select(F.col("node").alias("root"), F.lit(1).cast("long").alias("leaves"), *sums)
    out = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, levels + 1):
        up = links.join(level.repartition(parts, "root"), F.col("child") == F.col("root")).select(F.col("parent").alias("root"), "leaves", *sums)
        level = saved(up.repartition(parts, "root").groupBy("root").agg(*(F.sum(c).alias(c) for c in ("leaves", *sums))))
        if not level.take(1):
            break
        out.append(level.withColumn("depth", F.lit(depth)))
    nodes = own.select(F.col("node").alias("root"))
    below = reduce(DataFrame.unionByName, out[1:]).join(nodes, "root", "left_semi") if out[1:] else out[0].limit(0)
    return out[0].unionByName(below).select("root", "depth", "leaves", *sums)


def reachable(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks of the manifests (manifest, chunk) that any root (manifest) names."""
    return entries.join(roots.distinct(), "manifest", "left_semi").select("chunk").distinct()
