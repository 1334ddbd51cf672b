"""Places, runs and remainder seats without one task for a large table, key or house."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seatloom.operators import allocate as al
from seatloom.operators import changes, sorts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_like_row_number(spark, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(1)
    rows = spark.createDataFrame([(r.choice([None, 1.5, 2.5, float("nan"), 7.0]), k) for k in range(700)], "v double, pos int").repartition(partitions)
    for keys in ([F.col("v").asc_nulls_last(), F.col("pos")], [F.col("v").desc_nulls_last(), F.desc("pos")]):
        found = sorts.place(rows, [], *keys)
        assert "SinglePartition" not in plan(found)
        want = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)).cast("bigint"))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_keep_together(spark):
    """Far more rows of one key than a part would have."""
    rows = spark.range(5000).select((F.col("id") % 3).alias("v"), F.col("id"))
    places = sorts.numbered(rows, F.col("v"))
    assert [tuple(x) for x in places.groupBy("v").agg(F.min("place"), F.max("place"), F.count_distinct("place")).orderBy("v").collect()] == [(0, 1, 1667, 1667), (1, 1668, 3334, 1667), (2, 3335, 5000, 1666)]
    assert sorts.numbered(rows.where("id < 0"), F.col("v")).count() == 0


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_runs_like_windows(spark, span):
    r = random.Random(2)
    rows = [("hot", t, r.choice(["a", "a", "a", "b", None])) for t in range(300)] + [("calm", t, "a") for t in range(60)] + [(None, t, r.choice("ab")) for t in range(40)] + [("one", 5, None)]
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(3)
    found = changes.split_runs(df, ["k"], ["t"], F.col("v"), "t", F.floor(F.col("t") / span))
    assert found.columns == ["k", "t", "v", "changed", "island", "since"]
    want = changes.since(df, ["k"], ["t"], F.col("v"), "t").select("k", "t", "v", (F.col("since") == F.col("t")).alias("changed"), "island", "since")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    kept = found.where("changed").select("k", "t", "v")
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, changes.until_changed(df, ["k"], ["t"], F.col("v")).collect()))


def test_no_task_has_a_hot_key(spark):
    """Of one key with 99 % of all rows no task sorts more than a bucket."""
    rows = spark.range(20000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7 < 3).alias("v"))
    found = changes.split_runs(rows, ["k"], ["t"], F.col("v"), "t", F.expr("t div 250"))
    largest = found.withColumn("b", F.expr("t div 250")).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert largest <= 250 and found.count() == 20000
    assert found.where("k = 1").agg(F.max("island")).first()[0] == changes.since(rows, ["k"], ["t"], F.col("v"), "t").where("k = 1").agg(F.max("island")).first()[0]


@pytest.mark.parametrize("house, least", [(20, 1), (150, 0), (2000, 1)])
def test_search_like_the_list_of_averages(spark, house, least):
    r = random.Random(house)
    rows = [(e, f"p{p}", p, r.choice([r.randint(0, 50), r.randint(0, 100_000), 700])) for e in range(12) for p in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "e int, party string, pos int, votes long")
    want = al.allocate(df, ["e"], house, least).select("e", "party", "full_seats", "rest_seats", "seats", F.coalesce(F.col("last_round") == F.col("remainder"), F.lit(False)).alias("last"))
    found = al.allocate_by_price(df, ["e"], house, least).select("e", "party", "full_seats", "rest_seats", "seats", "last")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_an_average_just_below_the_price_wins_nothing(spark):
    """a's second and b's first average are both 4,280,000; at one more, b has votes for 2.99999965 seats, not for a third."""
    rows = [("a", 1, 21_400_000), ("b", 2, 12_840_000), ("c", 3, 13_760_000)] + [(f"small{k}", 3 + k, 4_000_000) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "party string, pos int, votes long")
    found = {r.party: (r.full_seats, r.rest_seats, r.last) for r in al.allocate_by_price(df, [], 10).where("full_seats > 0").collect()}
    assert found == {"a": (3, 2, True), "b": (2, 0, False), "c": (2, 1, False)}
    want = {r.party: (r.full_seats, r.rest_seats, r.last_round == r.remainder) for r in al.allocate(df, [], 10).where("full_seats > 0").collect()}
    assert {k: v[:2] for k, v in want.items()} == {k: v[:2] for k, v in found.items()} and want["a"][2]


def test_ten_million_seats_for_a_hundred_thousand_parties(spark):
    house = 10_000_000
    df = spark.range(100_000).select(F.col("id").alias("party"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 20_000).alias("votes"))
    rows = al.allocate_by_price(df, [], house)
    one = rows.agg(F.sum("seats"), F.count_if("last"), F.max("rest_seats"), F.max("remainder"), F.count("*")).first()
    assert tuple(one)[:2] == (house, 1) and one[2] < 100 < one[3] and one[4] == 100_000
    # No award was worth less than what any party missed.
    worst = rows.agg(F.min(F.when(F.col("rest_seats") > 0, F.floor(F.col("votes") / F.col("seats") + 0.5))).alias("won"), F.max(F.floor(F.col("votes") / (F.col("seats") + 1) + 0.5)).alias("missed")).first()
    assert worst.won >= worst.missed


def test_repeated_party_in_a_snapshot(spark):
    rows = [("e", 1, "p", 1, 10), ("e", 1, "p", 1, 5), ("e", 2, "p", 2, 20)]
    out = changes.seat_changes(spark.createDataFrame(rows, "election string, day int, party string, seats int, votes int"), ["election"], "day")
    assert [tuple(x) for x in out.collect()] == [("e", 2, "seats")]
