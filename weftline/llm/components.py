"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, attach_groups, few_files


def _smallest(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m) with m the smallest of u and its neighbours; minima are combined before the shuffle, and the edges of a node with many are dealt out."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return attach_groups(edges, low, ["u"], "v", total).select("u", "v", "m")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node of links (a, b), label the smallest node that can be reached.

    Large-star links a node's larger neighbours to its smallest one, small-star its smaller ones and itself. Rounds go on
    until a pair of them changes nothing; each is written to the shared folder, in few files, and the edges never outgrow links.
    """
    edges = scratch.small(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, n, total = None, 0, edges.count()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large, total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        n += 1
        edges = scratch.table(small.coalesce(few_files(scratch.spark, total)), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        total = now[0]
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = now
