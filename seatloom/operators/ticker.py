"""The feed of latest updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from .status import STATUSES


def items_from_index(municipalities: DataFrame) -> DataFrame:
    """Every municipality of feed B: name, status, ts, source, pos; absent texts empty."""
    return municipalities.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("status", F.lit("")).alias("status"), F.col("published").alias("ts"), F.lit("B").alias("source"), "pos")


def items_from_regions(views: DataFrame) -> DataFrame:
    """Feed A's municipalities; an unknown status counts as nothing counted."""
    return views.where("type = 0").select(F.coalesce("label", F.lit("")).alias("name"), decode("status", STATUSES, "Nulstand").alias("status"), F.timestamp_seconds("updated").alias("ts"), F.lit("A").alias("source"), "pos")


def latest(first: DataFrame, second: DataFrame, most: int = 5) -> DataFrame:
    """The newest items of both feeds; on ties the first feed, then its order. Items without a time come last.

    A sort with a limit: each task keeps its `most` newest.
    """
    both = first.withColumn("_feed", F.lit(0)).unionByName(second.withColumn("_feed", F.lit(1)))
    return both.orderBy(F.desc_nulls_last("ts"), "_feed", "pos").limit(most)


def signature(items: DataFrame) -> DataFrame:
    """The items' text: source, name and time, newest first; a change of status alone doesn't show."""
    text = F.concat_ws("|", "source", "name", F.unix_millis("ts").cast("string"))
    rows = items.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("t"), (-F.col("_feed")).alias("f"), (-F.col("pos")).alias("p"), text.alias("x"))), False).alias("s"))
    return rows.select(F.array_join(F.col("s.x"), "||").alias("signature"))
