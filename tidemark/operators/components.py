"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined on the map side) and a join back on
that node. Nodes with a large share of the links, the hubs of large components,
are salted, so that no node's links
are ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_per_key
from tidemark.sources.scratch import materialize, release


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    moved = join_per_key(both.filter("v > u"), least, ["u"], "n", 2 * total, "v")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_per_key(down, least, ["u"], "n", total, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the smallest node reachable.

    Rows with a null end and loops carry no link and are ignored; an empty
    ``edges`` gives an empty result. Every round shortens the paths left, so
    rounds go on until one changes nothing.
    """
    state = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(state)
    while mark[0]:
        stars = materialize(_large_star(state, mark[0]).distinct(), "stars")
        after = materialize(_small_star(stars, stars.count()).distinct(), "edges")
        release(stars, state)
        state, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = materialize(state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    release(state)
    return found
