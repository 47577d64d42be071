"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm._rows import stream


#: Edges of a partition.
EDGES = 200_000


def with_checkpoints(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder that the session names; without one this raises an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint after which the files of the shuffles that led to it can go."""
    out = with_checkpoints(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def joinable(grouped: DataFrame) -> DataFrame:
    """A grouped table for a join on its key.

    Joined as it is, it would fix the partitioning of the other side, and all
    rows of a frequent key would go to one task.  After a rebalance both sides
    are exchanged for the join, and adaptive execution splits such a key.
    """
    return grouped.hint("rebalance")


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (columns ``a``, ``b``) as stars around the smallest node of what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        types: list[pa.DataType] = []

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for batch in batches:
            types = batch.schema.types
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for k in range(0, len(nodes), 10_000):
            own = [(x, r) for x in nodes[k : k + 10_000] if (r := root(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in own], t) for i, t in enumerate(types)], names=["a", "b"])

    return stream(edges.select("a", "b"), run, edges.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the component's smallest node.

    Each partition first contracts its own edges.  While that leaves more than one
    partition's worth, large-star and small-star steps alternate until the edges are stars.
    Each step takes minima by key and joins them back, so that no neighbourhood is
    ever gathered in one place.
    """
    e = with_checkpoints(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Partitions follow the number of edges, else each step would write mostly empty files.
    parts = e.count() // EDGES + 1
    e = with_checkpoints(contracted(e.coalesce(parts)))
    before = _sum(e)
    while parts > 1:
        if (fewer := before[0] // EDGES + 1) < parts:
            parts = fewer
            e = with_checkpoints(contracted(e.coalesce(parts)))
            before = _sum(e)
            continue
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        e = with_checkpoints(small.distinct().coalesce(parts))
        after = _sum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
