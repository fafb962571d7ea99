"""Connected components of an edge table, on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, written

#: Tables of at most so many edges are solved by the driver, in one job instead of some twenty; larger ones in rounds.
FEW = 100_000


def _joined(edges: pa.Table) -> pa.Table:
    """(node, component) of a small edge table (u, v), by union-find with the least node as root."""
    up: dict = {}

    def root(x: object) -> object:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in zip(edges.column("u").to_pylist(), edges.column("v").to_pylist(), strict=True):
        one, two = root(up.setdefault(u, u)), root(up.setdefault(v, v))
        up[max(one, two)] = min(one, two)
    kind = edges.schema.field("u").type
    return pa.table({"node": pa.array(list(up), kind), "component": pa.array([root(x) for x in up], kind)})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of an undirected edge table (a, b), written; the component is its least node.

    Alternates large-star and small-star steps: each node links its neighbours to the least of them, first the
    larger ones, then the smaller ones, until all edges go to the least node of their component. The table never
    grows, and takes a logarithmic number of rounds. Each round is written to the shared folder. Nodes with very many
    neighbours are met by broadcast, so their edges stay spread; after that, a node has no more lower neighbours than
    it had to begin with. A table of at most ``FEW`` edges is solved by the driver, with the same result.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "components")
    n = now.count()
    if n <= FEW and now.schema["u"].dataType.typeName() in ("long", "integer", "short", "byte"):
        found = written(now.sparkSession.createDataFrame(_joined(now.toArrow()), f"node {now.schema['u'].dataType.simpleString()}, component {now.schema['u'].dataType.simpleString()}"), "components")
        discard(now)
        return found
    while n:
        # every node's neighbours are linked to the least of them and itself
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("rows"))
        large = hot_join(both, least, ["u"], 2 * n, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "components")
        # and then the neighbours below a node, with itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda u: F.struct(F.col(u).alias("u"), F.col("m").alias("v"))
        small = large.join(low, "u").select(F.explode(F.array(pair("v"), pair("u"))).alias("e"))
        last, now = now, written(small.select("e.*").where("u <> v").distinct(), "components")
        discard(last, large)
        # at the end every node has one edge, to a node that has none
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        n, todo = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.sum("up"), F.sum(F.when(F.col("up") + F.col("down") > 1, 1).otherwise(0))).first()
        if not todo:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    discard(now)
    return found
