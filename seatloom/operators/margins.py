"""Votes to spare and votes short for the last remainder seat, summaries, and the deciding pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank_zero, format_number_nl
from .allocate import HOUSE, per

RESIDUAL = "OVERIG"


def margins(seats: DataFrame, by: list[str], house: int = HOUSE) -> DataFrame:
    """Add surplus and short, not rounded, to allocate().

    A party without full seats is short of the quota and has no surplus. For the others the last
    winner's average per seat is the mark: below it a party is short by the difference times its next
    seat. At or above it, the second highest average decides; equal averages count twice.
    """
    w = per(by)
    full = F.col("full_seats") > 0
    last = full & (F.col("last_round") == F.col("remainder"))
    held = F.col("votes") / F.nullif(F.col("seats"), F.lit(0))
    df = seats.withColumn("_avg", F.when(last, held).when(full, F.col("votes") / (F.col("seats") + 1)))
    df = df.withColumn("_mark", F.coalesce(F.max(F.when(last, held)).over(w), F.lit(0.0)))
    order = F.row_number().over(w.orderBy(F.desc_nulls_last("_avg"), "pos"))
    df = df.withColumn("_n", order).withColumn("_count", F.count("_avg").over(w))
    second = F.coalesce(F.max(F.when(F.col("_n") == F.least(F.lit(2), F.col("_count")), F.col("_avg"))).over(w), F.lit(0.0))
    df = df.withColumn("_second", second)
    level = F.when(F.col("_second") == 0, F.col("_avg")).otherwise(F.col("_second"))
    below = F.col("_avg") < F.col("_mark")
    surplus = F.when(full & below, F.col("votes") - F.col("seats") * F.col("_mark")).when(full, F.floor((held - level) * F.col("seats")).cast("double"))
    short = F.when(~full, F.col("total") / F.lit(float(house)) - F.col("votes")).when(below, (F.col("_mark") - F.col("_avg")) * (F.col("seats") + 1)).otherwise(F.ceil((level + 1) * (F.col("seats") + 1)).cast("double") - F.col("votes"))
    return df.withColumn("surplus", surplus).withColumn("short", short).drop("_avg", "_mark", "_n", "_count", "_second")


def not_residual(label: Column) -> Column:
    """Is a label not that of the bucket of other parties?"""
    return ~F.upper(F.coalesce(label, F.lit(""))).contains(RESIDUAL)


def seat_rows(margin_rows: DataFrame, by: list[str], label: str = "party") -> DataFrame:
    """by, party, full_seats, rest_seats, seats, surplus, short, pos as shown: whole votes, rounded up, 0 as null; a party without seats has all its votes to spare. The residual bucket is left out after the allocation it took part in."""
    rows = margin_rows.where(not_residual(F.col(label)))
    up = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0.0))).cast("bigint")
    surplus = F.when((F.col("full_seats") == 0) & (F.col("rest_seats") == 0), F.col("votes")).otherwise(up("surplus"))
    return rows.select(*by, F.col(label).alias("party"), "full_seats", "rest_seats", "seats", blank_zero(surplus).alias("surplus"), blank_zero(up("short")).alias("short"), "pos")


def with_total(rows: DataFrame, by: list[str]) -> DataFrame:
    """Append a total row to seat_rows() (is_total 1) and number the rows: seats, then shortfall, total last."""
    sums = rows.groupBy(*by).agg(F.lit("Totaal").alias("party"), *(F.sum(c).alias(c) for c in ("full_seats", "rest_seats", "seats")), F.lit(None).cast("bigint").alias("surplus"), F.lit(None).cast("bigint").alias("short"), F.lit(0).alias("pos"), F.lit(1).alias("is_total"))
    every = rows.withColumn("is_total", F.lit(0)).unionByName(sums)
    return every.withColumn("place", F.row_number().over(per(by).orderBy("is_total", F.desc("seats"), F.coalesce("short", F.lit(0)), "pos")).cast("bigint"))


def margin_pair(margin_rows: DataFrame, by: list[str]) -> DataFrame:
    """by, winner, round, surplus of the last award, and loser, short: the smallest shortfall of all, the winner and seatless parties included; ties go to input order."""
    winner = margin_rows.groupBy(*by).agg(F.max_by("party", "last_round").alias("winner"), F.max("last_round").alias("round"), F.max_by("surplus", "last_round").alias("surplus"))
    near = F.row_number().over(per(by).orderBy("short", "pos"))
    loser = margin_rows.where("short is not null").withColumn("_n", near).where("_n = 1").select(*by, F.col("party").alias("loser"), "short")
    key = by or ["_k"]
    if not by:
        winner, loser = winner.withColumn("_k", F.lit(1)), loser.withColumn("_k", F.lit(1))
    pair = winner.join(loser, key, "left").drop(*([] if by else ["_k"]))
    return pair.withColumn("surplus", F.ceil("surplus").cast("bigint")).withColumn("short", F.ceil("short").cast("bigint"))


def margin_text(pair: DataFrame) -> DataFrame:
    """Add text: one sentence about the pair; a placeholder where no seat was awarded."""
    text = F.format_string("%s houdt de laatste restzetel (%s over); %s komt %s stemmen tekort", F.col("winner"), format_number_nl("surplus"), F.col("loser"), format_number_nl("short"))
    return pair.withColumn("text", F.when(F.col("winner").isNull(), "-").otherwise(text))


def top_list(rows: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The share list: place and party of those with seats, by seats, then shortfall; overflow says that more follow."""
    with_seats = rows.where("seats > 0").withColumn("_all", F.count("*").over(per(by)))
    ranked = with_seats.withColumn("place", F.row_number().over(per(by).orderBy(F.desc("seats"), F.coalesce("short", F.lit(0)), "pos")).cast("bigint"))
    return ranked.where(F.col("place") <= most).select(*by, "place", "party", "seats", (F.col("_all") > most).alias("overflow"))


def list_text(top: DataFrame, by: list[str], header: str) -> DataFrame:
    """top_list() as one text per election, a line each, an ellipsis where more follow."""
    line = F.format_string("%s %d", F.col("party"), F.col("seats"))
    rows = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"), F.max("overflow").alias("overflow"))
    body = F.concat(F.array(F.lit(header)), F.col("lines.line"), F.when(F.col("overflow"), F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*by, F.array_join(body, "\n").alias("text"))


def poll_difference(rows: DataFrame, latest: DataFrame, name: Column) -> DataFrame:
    """Add expected and difference by normalised name; parties that the poll doesn't have get 0 expected and no difference."""
    joined = rows.join(latest.select(F.col("name").alias("_name"), "expected"), name == F.col("_name"), "left").drop("_name")
    return joined.withColumn("difference", F.col("seats") - F.col("expected")).withColumn("expected", F.coalesce("expected", F.lit(0)))


def poll_series(rows: DataFrame, polls: DataFrame, times: DataFrame, name: Column) -> DataFrame:
    """Rows (election, party, ...) with series: a poll's seats of the party by time, as array<struct<time, seats>>.

    A party of the poll has its own times in document order; one that the poll lacks has 0 seats at
    each time that any party of the election has. polls: exit_poll(); times: poll_times().
    """
    own = polls.where("time is not null").groupBy(F.col("election").alias("_e"), F.col("name").alias("_name"))
    own = own.agg(F.array_sort(F.collect_list(F.struct("pos", "time", "seats"))).alias("_own"))
    known = times.groupBy(F.col("election").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("place", "time"))).alias("_times"))
    joined = rows.withColumn("_key", name).join(own, (F.col("election") == F.col("_e")) & (F.col("_key") == F.col("_name")), "left").join(known, F.col("election") == F.col("_t"), "left")
    mine = F.transform("_own", lambda x: F.struct(x["time"].alias("time"), x["seats"].alias("seats")))
    none = F.transform("_times", lambda x: F.struct(x["time"].alias("time"), F.lit(0).alias("seats")))
    return joined.withColumn("series", F.coalesce(mine, none)).drop("_key", "_e", "_name", "_own", "_t", "_times")


def series_text(series: Column, title: str = "Exitpoll Ipsos") -> Column:
    """A series line by line below a title."""
    return F.array_join(F.concat(F.array(F.lit(title)), F.transform(series, lambda x: F.concat(x["time"], F.lit(" "), x["seats"].cast("string"), F.lit(" zetels")))), "\n")
