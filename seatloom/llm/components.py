"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. large: hang larger neighbours on the least one, else the smaller ones and itself.

    The least neighbours are written first, so that the join deals out both sides anew and Spark can
    split the edges of a hub.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("n"), "m")
        least = materialize(least, "least")
        moved = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "least")
        moved = edges.join(least, F.col("u") == F.col("n")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node that some edge joins to another, with the least node that it reaches: (node, component).

    edges: long columns a and b, in any direction, repeats and loops allowed; rows with a null are
    not edges. Nodes without an edge are not returned. Each step is a few shuffles of the edges, whose
    number never grows, and the number of steps grows as the square of the logarithm of the nodes
    at worst. Steps are written to the shared folder; only their row counts and sums reach the driver.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    now = materialize(now, "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        now = materialize(_stars(materialize(_stars(now, large=True), "edges"), large=False), "edges")
