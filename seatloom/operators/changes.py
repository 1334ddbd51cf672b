"""Sequences of snapshots: suppressed repeats, islands of an unchanged state, change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import falsy_text, relative_time


def until_changed(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column) -> DataFrame:
    """Rows whose value differs from the row before of the same key; each key's first row stays. A, A, B, A gives three."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~value.eqNullSafe(F.col("_before"))).drop("_before", "_n")


def since(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, at: str) -> DataFrame:
    """Add island (number of the run of equal values) and since (its first time)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    rows = rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("since", F.min(at).over(Window.partitionBy(*keys, "island"))).drop("_changed")


def split_runs(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, at: str, bucket: Column) -> DataFrame:
    """until_changed() and since() of keys of any size: changed (a run of equal values begins), island and since (its first row's time).

    bucket cuts the order into spans, a day for example: a later row of a key never has a lesser bucket. Rows
    meet within their key's bucket only. What joins the buckets is one row for each: its first and last
    value, how many runs begin inside, and when the last one did. Those few rows of a key are scanned in order.
    """
    rows = rows.withColumn("_bucket", bucket).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    first = F.row_number().over(inside) == 1
    rows = rows.withColumn("_begins", ~first & ~F.col("_value").eqNullSafe(F.lag("_value").over(inside))).withColumn("_first", first)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_runs", F.count_if("_begins").over(upto)).withColumn("_at", F.last(F.when(F.col("_first") | F.col("_begins"), F.struct(F.col(at).alias("t"))), True).over(upto))

    place = F.struct(*order)
    spans = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_span"))
    spans = spans.agg(F.min_by("_value", place).alias("_head"), F.max_by("_value", place).alias("_tail"), F.max("_runs").alias("_more"), F.max_by("_at", place).alias("_last"))
    scan = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_span")
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_new", F.coalesce(~F.col("_head").eqNullSafe(F.lag("_tail").over(scan)), F.lit(True)) | (F.row_number().over(scan) == 1))
    spans = spans.withColumn("_base", F.coalesce(F.sum(F.col("_more") + F.col("_new").cast("long")).over(before), F.lit(0)) + F.col("_new").cast("long"))
    spans = spans.withColumn("_since", F.last(F.when(F.col("_new") | (F.col("_more") > 0), F.col("_last")), True).over(before)).drop("_head", "_tail", "_more", "_last")

    same = F.col("_bucket").eqNullSafe(F.col("_span"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(spans, same)
    carried = (F.col("_runs") == 0) & ~F.col("_new")
    joined = joined.withColumns({"changed": F.col("_begins") | (F.col("_first") & F.col("_new")), "island": F.col("_base") + F.col("_runs"), "since": F.when(carried, F.col("_since")["t"]).otherwise(F.col("_at")["t"])})
    return joined.drop("_bucket", "_value", "_begins", "_first", "_runs", "_at", "_span", "_new", "_base", "_since", *(f"_k{i}" for i in range(len(keys))))


def since_time(updated: Column, now: Column) -> Column:
    """When a new state began: the update's time if it lies after the epoch and not after now, else now."""
    return F.when((F.unix_micros(updated) > 0) & (updated <= now), updated).otherwise(now)


def since_states(snapshots: DataFrame, keys: list[str], order: str, signature: str = "signature") -> DataFrame:
    """Add since to snapshots (keys, order, signature, updated, now): when the present signature began.

    A change, and the first snapshot, begin at since_time() of that snapshot; a repeat keeps the time.
    """
    islands = since(snapshots, keys, [order], F.col(signature), order)
    own = Window.partitionBy(*keys, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("since", F.first(since_time(F.col("updated"), F.col("now"))).over(own)).drop("island")


def banner(rows: DataFrame) -> DataFrame:
    """Add text: who gets the last remainder seat at whose cost, and since when, unless the count is final or neither is known.

    rows: winner, loser, finalized, since, now.
    """
    name = lambda c: F.coalesce(falsy_text(c, None), F.lit("-"))
    line = F.concat(F.lit("Laatste restzetel gaat naar: "), name("winner"), F.lit(", dit gaat ten koste van: "), name("loser"))
    known = F.coalesce(falsy_text("winner", None), falsy_text("loser", None)).isNotNull()
    return rows.withColumn("text", F.when(F.col("finalized") | ~known, line).otherwise(F.concat(line, F.lit(" (sinds "), relative_time("since", F.col("now")), F.lit(")"))))


def seat_changes(snapshots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """event for each snapshot but the first: seats if any party's seats differ, else votes if the total grew, else none.

    snapshots: keys, order, party, seats, votes. A party that the snapshot before lacks had 0 seats; one
    that has gone isn't noticed. Of repeated rows of a party the votes add up and the most seats count.
    """
    each = snapshots.groupBy(*keys, order, "party").agg(F.sum("votes").alias("votes"), F.max("seats").alias("seats"))
    per_order = each.groupBy(*keys, order).agg(F.sum("votes").alias("total"), F.map_from_entries(F.collect_list(F.struct("party", "seats"))).alias("seats"))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = per_order.withColumn("_total", F.lag("total").over(w)).withColumn("_seats", F.lag("seats").over(w)).where("_total is not null")
    moved = F.exists(F.map_entries("seats"), lambda e: e["value"] != F.coalesce(F.try_element_at(F.col("_seats"), e["key"]), F.lit(0)))
    return rows.select(*keys, order, F.when(moved, "seats").when(F.col("total") > F.col("_total"), "votes").otherwise("none").alias("event"))


def reject_late(rows: DataFrame, selected: str) -> DataFrame:
    """Without answers for an election that is no longer the selected one."""
    return rows.where(F.col("election") == selected)

