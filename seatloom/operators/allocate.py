"""Proportional seat allocation: full seats by quota, remainder seats by highest averages.

Input of each function: one row per party with the election columns `by`, party, pos (input order)
and votes. Parties are few once votes are summed, so windows per election are cheap; elections are
spread over tasks. With no `by`, all rows are one election.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.landing import once

HOUSE = 150


def per(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def sum_votes(df: DataFrame, by: list[str], party: str, votes: Column, order: Column | None = None) -> DataFrame:
    """Votes per election and party, nulls as 0, with pos by `order` (the party itself by default)."""
    rows = df.groupBy(*by, party).agg(F.sum(F.coalesce(votes, F.lit(0))).cast("bigint").alias("votes"))
    rows = rows.withColumnRenamed(party, "party")
    return rows.withColumn("pos", F.row_number().over(per(by).orderBy(*([order] if order is not None else []), "party")))


def quota(df: DataFrame, by: list[str], house: int = HOUSE) -> DataFrame:
    """total, quota and threshold (a quarter of the quota, whole) of each election."""
    sums = df.groupBy(*by).agg(F.sum(F.coalesce("votes", F.lit(0))).cast("bigint").alias("total"))
    return sums.withColumn("quota", F.col("total") / F.lit(float(house))).withColumn("threshold", F.floor(F.col("quota") * 0.25))


def full_seats(df: DataFrame, by: list[str], house: int = HOUSE, exact: bool = False) -> DataFrame:
    """Add total, full_seats and remainder (the election's seats left).

    Doubles divide as votes / (total / house), which falls short at some exact multiples; exact takes
    whole numbers instead. Without votes there are no full seats and all seats are left.
    """
    w = per(by)
    df = df.withColumn("votes", F.coalesce("votes", F.lit(0)).cast("bigint")).withColumn("total", F.sum("votes").over(w))
    share = F.expr(f"votes * {house} div nullif(total, 0)") if exact else F.floor(F.try_divide(F.col("votes").cast("double"), F.col("total") / F.lit(float(house))))
    df = df.withColumn("full_seats", F.coalesce(share, F.lit(0)).cast("bigint"))
    return df.withColumn("remainder", F.lit(house) - F.sum("full_seats").over(w))


def awards(seats: DataFrame, by: list[str], least_full: int = 1) -> DataFrame:
    """Remainder seats in order: by, round, party, average (rounded). seats: full_seats().

    Averages of one party never rise as it gains seats, so the awards of all rounds are the first
    `remainder` rows of all (party, next seat) averages, rounded, highest first; ties go to the party
    first in input order. Parties below least_full full seats take no part.
    """
    eligible = seats.where((F.col("full_seats") >= least_full) & (F.col("remainder") > 0))
    steps = eligible.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("remainder"))))
    steps = steps.withColumn("average", F.floor(F.col("votes") / (F.col("full_seats") + F.col("k")) + 0.5).cast("bigint"))
    steps = steps.withColumn("round", F.row_number().over(per(by).orderBy(F.desc("average"), "pos", "k")))
    return steps.where("round <= remainder").select(*by, F.col("round").cast("bigint").alias("round"), "party", "pos", "average")


def allocate(df: DataFrame, by: list[str], house: int = HOUSE, least_full: int = 1, exact: bool = False) -> DataFrame:
    """full_seats() with rest_seats, seats and last_round (the round of the party's last award, null without)."""
    seats = full_seats(df, by, house, exact)
    won = awards(seats, by, least_full).groupBy(*by, "party").agg(F.count("*").alias("rest_seats"), F.max("round").alias("last_round"))
    seats = seats.join(won, [*by, "party"], "left").withColumn("rest_seats", F.coalesce("rest_seats", F.lit(0)))
    return seats.withColumn("seats", F.col("full_seats") + F.col("rest_seats"))


#: Prices that are tried at once for each election.
PROBES = 63


def _priced(price: Column) -> Column:
    """Seats that a party wins at a price: those whose rounded average is the price or more, remainder at most; all of them at price 0."""
    # Whole-number division: a quotient of decimals is rounded, and one just below a whole number would reach it.
    number = F.call_function("div", F.lit(2).cast("decimal(20,0)") * F.col("votes"), F.greatest(F.lit(1), 2 * price - 1).cast("decimal(20,0)"))
    return F.when(price <= 0, F.col("remainder")).otherwise(F.least(F.col("remainder"), F.greatest(F.lit(0).cast("bigint"), number - F.col("full_seats"))))


def remainder_by_price(seats: DataFrame, by: list[str], least_full: int = 1) -> DataFrame:
    """Remainder seats without listing averages: by, party, rest_seats, last (is the election's last award its?).

    The same awards as awards(), for houses and ballots of any size. How many averages reach a price falls
    as the price rises, so the price of the last award is searched: each pass counts the awards at PROBES
    prices between the bounds of each election and keeps the bounds between which the remainder lies.
    The number of passes is the logarithm of the votes. What is left at that very price goes to the
    parties by position; only those with an average of just that price are ranked.
    """
    key = [*by, "_all"]
    rows = seats.where((F.col("full_seats") >= least_full) & (F.col("remainder") > 0)).withColumn("_all", F.lit(1))
    rows = once(rows.select(*key, "party", "pos", "votes", "full_seats", "remainder"), "eligible")
    best = F.floor(F.col("votes") / (F.col("full_seats") + 1) + 0.5).cast("bigint")
    state = rows.groupBy(*key).agg(F.lit(0).cast("bigint").alias("low"), (F.max(best) + 1).alias("high"), F.max("remainder").alias("wanted"))
    while True:
        state = once(state, "prices")
        if state.where("high - low > 1").isEmpty():
            break
        tried = state.where("high - low > 1").withColumn("price", F.explode(F.expr(f"array_distinct(transform(sequence(1, {PROBES}), j -> low + greatest(1, (high - low) * j div {PROBES + 1})))")))
        counts = rows.join(tried.select(*key, "price"), key).groupBy(*key, "price").agg(F.sum(_priced(F.col("price"))).alias("won"))
        bounds = counts.join(state.select(*key, "wanted"), key).groupBy(*key).agg(F.max(F.when(F.col("won") >= F.col("wanted"), F.col("price"))).alias("up"), F.min(F.when(F.col("won") < F.col("wanted"), F.col("price"))).alias("down"))
        state = state.join(bounds, key, "left").select(*key, F.coalesce("up", "low").alias("low"), F.coalesce("down", "high").alias("high"), "wanted")
    priced = rows.join(state.select(*key, F.col("low").alias("price"), "wanted"), key)
    priced = priced.withColumn("above", _priced(F.col("price") + 1)).withColumn("at", _priced(F.col("price")) - F.col("above"))
    sums = priced.groupBy(*key).agg(F.sum("above").alias("_sure"))
    priced = priced.join(sums, key).withColumn("left", F.col("wanted") - F.col("_sure"))
    tied = priced.where("at > 0")
    before = F.coalesce(F.sum("at").over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.withColumn("before", before).withColumn("extra", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("at"), F.col("left") - F.col("before"))))
    tied = tied.withColumn("last", (F.col("before") < F.col("left")) & (F.col("before") + F.col("at") >= F.col("left")))
    sure = priced.where("at = 0").withColumns({"extra": F.lit(0).cast("bigint"), "last": F.lit(False)})
    both = sure.select(*key, "party", "above", "extra", "last").unionByName(tied.select(*key, "party", "above", "extra", "last"))
    return both.select(*by, "party", (F.col("above") + F.col("extra")).cast("bigint").alias("rest_seats"), "last").where("rest_seats > 0")


def allocate_by_price(df: DataFrame, by: list[str], house: int = HOUSE, least_full: int = 1, exact: bool = False) -> DataFrame:
    """allocate() by remainder_by_price(): full_seats() with rest_seats, seats and last, which marks the party of the last award."""
    seats = full_seats(df, by, house, exact)
    won = remainder_by_price(seats, by, least_full)
    seats = seats.join(won, [*by, "party"], "left").withColumns({"rest_seats": F.coalesce("rest_seats", F.lit(0)).cast("bigint"), "last": F.coalesce("last", F.lit(False))})
    return seats.withColumn("seats", F.col("full_seats") + F.col("rest_seats"))


def average_matrix(seats: DataFrame, by: list[str], least_full: int = 1) -> DataFrame:
    """by, party, round, average (not rounded), won: each eligible party's average in each round, with the seats won before it."""
    rounds = seats.where((F.col("full_seats") >= least_full) & (F.col("remainder") > 0)).withColumn("round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("remainder"))))
    taken = awards(seats, by, least_full).select(*by, "party", "round", F.lit(1).alias("won"))
    cells = rounds.join(taken, [*by, "party", "round"], "left").withColumn("won", F.coalesce("won", F.lit(0)))
    before = Window.partitionBy(*by, "party").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("won").over(before), F.lit(0))
    return cells.withColumn("average", F.col("votes") / (F.col("full_seats") + held + 1)).select(*by, "party", "pos", "votes", "round", "average", "won")


def rank_averages(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Add place: 1 for a round's highest average, 2 for the highest below it if positive; others null."""
    place = F.dense_rank().over(Window.partitionBy(*by, "round").orderBy(F.desc("average")))
    return matrix.withColumn("place", F.when((place == 1) | ((place == 2) & (F.col("average") > 0)), place).cast("bigint"))


def pivot_rounds(matrix: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """A column round_1, round_2, ... for each of the first rounds."""
    named = matrix.where(F.col("round") <= rounds).withColumn("name", F.concat(F.lit("round_"), F.col("round").cast("string")))
    return named.groupBy(*by, "party").pivot("name", [f"round_{k}" for k in range(1, rounds + 1)]).agg(F.max("average"))


def winner_strip(seats: DataFrame, by: list[str], least_full: int = 1) -> DataFrame:
    """Round by round winners as one ordered array per election."""
    return awards(seats, by, least_full).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("round", "party"))).alias("strip")).select(*by, F.col("strip.party").alias("winners"))


def shown_seats(rows: DataFrame, by: list[str]) -> DataFrame:
    """allocate() with seats null throughout an election that has no votes at all."""
    counted = F.max(F.coalesce("votes", F.lit(0)) > 0).over(per(by))
    return rows.withColumns({c: F.when(counted, F.col(c)) for c in ("full_seats", "rest_seats", "seats")})
