"""Recursive operators over edge tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the folder all executors share, so that loops keep no lineage and survive lost executors.

    ``by``: columns by whose values the table is divided into folders.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)  # of this process alone, gone with it
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def signature(df: DataFrame) -> tuple:
    """Row count and two sums of row hashes: equal for equal sets of rows, and for no others but by chance (2**-95)."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(1 << 31)))).first())


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every dst reachable from src in one step or more; on a cycle a node reaches itself.

    Semi-naive with doubling: each round extends the pairs that the last one found by all known ones, so the
    rounds grow with the logarithm of the longest path.
    """
    base = kept(edges.select("src", "dst").distinct())
    parts, new = [base], base
    while not new.isEmpty():
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        step = new.join(seen.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        new = kept(step.join(seen, ["src", "dst"], "left_anti"))
        parts.append(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(src, dst, distance): every dst reachable from src with the least number of steps; rounds grow with that number."""
    base = kept(edges.select("src", "dst").distinct())
    seen = new = kept(base.withColumn("distance", F.lit(1).cast("long")))
    while not new.isEmpty():
        step = new.select("src", F.col("dst").alias("via"), "distance").join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst", (F.col("distance") + 1).alias("distance")).distinct()
        new = kept(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def depth(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, depth): 1 without a parent, else the parent's depth + 1; a parent that is no node counts as depth 1.

    ``parents`` (node, parent) has one row a node at most and no cycles; a node on a cycle gets no row.
    """
    known = parents.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    roots = nodes.join(known.select("node"), "node", "left_anti").join(parents.select("node", F.lit(1).alias("__outer")), "node", "left")
    level = kept(roots.select("node", (F.coalesce("__outer", F.lit(0)) + 1).cast("long").alias("depth")))
    parts = [level]
    while not level.isEmpty():
        level = kept(known.join(level.select(F.col("node").alias("parent"), "depth"), "parent").select("node", (F.col("depth") + 1).alias("depth")))
        parts.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, node, component): components within each group by passing the smallest label along edges (grp, a, b).

    Labels halve their distance each round by jumping to the label of the label.
    """
    both = kept(edges.select("grp", "a", "b").unionByName(edges.select("grp", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(nodes.select("grp", "node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(labels.select("grp", F.col("node").alias("b"), "component"), ["grp", "b"]).groupBy("grp", F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, ["grp", "node"], "left").select("grp", "node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = stepped.select("grp", F.col("node").alias("component"), F.col("component").alias("far"))
        after = kept(stepped.join(jump, ["grp", "component"]).select("grp", "node", F.col("far").alias("component")))
        before, labels = signature(labels), after
        if signature(labels) == before:
            return labels
