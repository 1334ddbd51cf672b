"""The driver's tables in the shapes that the operators take.

Where a plan would go back to the large tables for each use of the votes, they are summed once and
written: a few rows for each election. Brand votes need no such table, since Spark reuses the exchange
below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.allocate import sum_votes
from ..sources.landing import once
from ..sources.readers import table


def brand_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """party = brand, votes = quantity sold."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return sum_votes(sold.join(part, F.col("l_partkey") == F.col("p_partkey")), [], "p_brand", F.col("q"))


def year_nation_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """election = order year, party = nation, votes = orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("election"))
    each = orders.groupBy("o_custkey", "election").agg(F.count("*").alias("n"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = each.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("election", "c_nationkey").agg(F.sum("n").alias("n"))
    return once(sum_votes(rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), ["election"], "n_name", F.col("n")), "votes")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds of brand votes, one for each return flag: A is feed a, N feed b, R official."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    rows = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", "p_brand").agg(F.sum("q").cast("bigint").alias("votes"))
    source = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "b").otherwise("official")
    return once(rows.select(source.alias("source"), F.col("p_brand").alias("party"), "votes"), "feeds")


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of nations. Codes are absent for a third and change case with the key's parity, so that all kinds of match occur."""
    n = table(spark, sf_dir, "nation")
    title = F.initcap("n_name")
    code = F.when(F.col("n_nationkey") % 3 == 2, None).when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name"))
    return n.select((F.col("n_nationkey") + 1).alias("list_number"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("party"), title.alias("label_long"), F.substring("n_name", 1, 3).alias("label_short"), code.alias("code"))


def nation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed B: code = the nation's name in capitals, votes = its customers, pos = its key."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("votes"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).select(F.upper("n_name").alias("code"), F.col("n_nationkey").alias("pos"), "votes")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def nation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = the nation's key, r = its region's, name, c = its customers."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return once(n.select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("int").alias("r"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("c")), "nations")
