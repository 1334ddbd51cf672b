"""Votes of several sources: dimension joins, conversion to one shape, and the choice of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import falsy_text, format_change, format_number_nl, format_permille, quota_parts
from ..sources.readers import last_per_key
from .allocate import HOUSE


def join_labels(rows: DataFrame, labels: DataFrame, on: list[str], default: str = "") -> DataFrame:
    """Left join of label_long, label_short and list_number. Labels are read as they are: Spark broadcasts them while they are small."""
    joined = rows.join(labels.select(*on, "label_long", "label_short", "list_number"), on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(default)) for c in ("label_long", "label_short")})


def official_to_parties(official: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Official rows by list number to parties; a number without a label becomes the number less one, as text."""
    named = official.join(labels.select(*by, "list_number", "party"), [*by, "list_number"], "left")
    return named.select(*by, F.coalesce("party", (F.col("list_number") - 1).cast("string")).alias("party"), "pos", "votes")


def feed_to_parties(feed: DataFrame, labels: DataFrame, by: list[str], casefold: bool = True, prefix: str = "NOS:", unknown: str = "ONBEKEND") -> DataFrame:
    """Feed B's codes to parties: in any case or exactly; of labels with the same code the last stands. Others get prefix and code."""
    key = F.upper if casefold else (lambda c: c)
    codes = last_per_key(labels.where("code is not null").withColumn("_code", key(F.col("code"))), [*by, "_code"], "list_number").select(*by, "_code", "party")
    rows = feed.withColumn("_code", key(F.coalesce("code", F.lit(""))))
    joined = rows.join(codes, [*by, "_code"], "left")
    return joined.select(*by, F.coalesce("party", F.concat(F.lit(prefix), falsy_text("code", unknown))).alias("party"), "pos", F.coalesce("votes", F.lit(0)).alias("votes"))


def choose_source(totals: DataFrame, by: list[str], by_rows: bool = True) -> DataFrame:
    """The source that counts: by, source, total. totals: by, source (official, a or b), total, n (rows).

    Official if it has rows (by_rows) or votes (not by_rows); else the feed with more votes, a on ties.
    """
    is_official = (F.col("source") == "official") & ((F.col("n") if by_rows else F.col("total")) > 0)
    usable = totals.where((F.col("source") != "official") | is_official)
    best = F.max_by(F.struct("source", "total", "n"), F.struct(F.col("source") == "official", "total", F.col("source") == "a"))
    return usable.groupBy(*by).agg(best.alias("_best")).where("_best is not null").select(*by, "_best.*")


def source_totals(votes: DataFrame, by: list[str]) -> DataFrame:
    return votes.groupBy(*by, "source").agg(F.sum(F.coalesce("votes", F.lit(0))).cast("bigint").alias("total"), F.count("*").alias("n"))


def quota_table(totals: DataFrame, house: int = HOUSE) -> DataFrame:
    """Add the quota in a whole part and 1/house parts (null for 0), and the preference threshold."""
    whole, parts = quota_parts(F.col("total"), house)
    return totals.select("*", whole.alias("quota_whole"), parts.alias("quota_parts"), F.floor(F.col("total") / F.lit(float(house)) * 0.25).alias("threshold"))


def votes_total(rows: DataFrame, house: int = HOUSE) -> DataFrame:
    """The total row of side_by_side() and what follows from it, one row: votes, votes_b, votes_official, sort_column, total and quota_table() of the source that counts.

    The official source counts if it has votes, else the feed with more of them, a on ties.
    """
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("votes", "votes_b", "votes_official")))
    column = default_vote_column(F.col("votes_official"), F.col("votes_b"), F.col("votes"))
    total = F.when(column == "official", F.col("votes_official")).when(column == "b", F.col("votes_b")).otherwise(F.col("votes"))
    return quota_table(sums.withColumns({"sort_column": column, "total": total}), house)


def default_vote_column(official: Column, b: Column, a: Column) -> Column:
    """The column that the votes page sorts by at first: official if it has votes, else the larger feed, a on ties."""
    return F.when(official > 0, "official").when(b > a, "b").otherwise("a")


def with_votes_total(rows: DataFrame, label: str) -> DataFrame:
    """side_by_side() and its total row as shown: texts, an empty one for no votes of a source; is_total marks the total."""
    shown = lambda c: F.when(F.col(c) == 0, "").otherwise(format_number_nl(c)).alias(c)
    own = rows.select("list_number", "label", shown("votes"), shown("votes_b"), shown("votes_official"), F.lit(0).alias("is_total"))
    total = votes_total(rows).select(F.lit(None).cast("bigint").alias("list_number"), F.lit(label).alias("label"), shown("votes"), shown("votes_b"), shown("votes_official"), F.lit(1).alias("is_total"))
    return own.unionByName(total)


def side_by_side(parties: DataFrame, feed_b: DataFrame, official: DataFrame, labels: DataFrame) -> DataFrame:
    """Feed A's parties (party, pos, votes, previous) with the other sources: feed B by its exact code, official by list number, 0 where absent."""
    dims = labels.select("party", "code", "list_number", "label_long", "label_short")
    rows = parties.join(dims, "party", "left")
    rows = rows.join(feed_b.select("code", F.col("votes").alias("votes_b")), "code", "left").join(official.select("list_number", F.col("votes").alias("votes_official")), "list_number", "left")
    rows = rows.where(~(F.upper(F.coalesce("label_short", F.lit(""))).contains("OVERIG") & (F.coalesce("votes", F.lit(0)) == 0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(F.coalesce("list_number", "pos").cast("bigint").alias("list_number"), "party", F.coalesce("label_long", F.lit("")).alias("label"), zero("votes"), zero("votes_b"), zero("votes_official"), (F.coalesce("votes", F.lit(0)) - F.coalesce("previous", F.lit(0))).alias("difference"), format_change(F.coalesce("votes", F.lit(0)), F.col("previous")).alias("change"), sort_change(F.col("votes"), F.col("previous")).alias("change_key"))


def sort_change(now: Column, before: Column) -> Column:
    """The sort key of a change: percent of the present votes, where the shown value is of the previous ones, to one decimal; a party without votes comes lowest."""
    now, before = F.coalesce(now, F.lit(0)), F.coalesce(before, F.lit(0))
    return F.when(now == 0, float("-inf")).otherwise(F.round(F.try_divide((now - before).cast("double"), now.cast("double")) * 100, 1))


def blank_at_zero(shown: Column, value: Column, zero_stand: Column) -> Column:
    """Empty instead of 0 while nothing has been counted."""
    return F.when(zero_stand & (value == 0), "").otherwise(shown)


def build_stats(results: DataFrame, index: DataFrame) -> DataFrame:
    """Five statistics, now and before, as rows: statistic, current, previous. Feed A's text if it isn't empty ("0" isn't), else feed B, else 0 or ''."""
    a, b = results.withColumn("_k", F.lit(1)), index.select("landelijke_uitslag.huidige_verkiezing", "landelijke_uitslag.vorige_verkiezing").withColumn("_k", F.lit(1))
    both = a.join(b, "_k", "full")
    paths = {"voters": "kiesgerechtigden", "turnout": "opkomst_promillage", "turnoutCount": "opkomst", "invalid": "ongeldig", "blank": "blanco"}
    cells = []
    for name, path in paths.items():
        pair = []
        for when, root in (("current", "huidige_verkiezing"), ("previous", "vorige_verkiezing")):
            other = format_permille(f"{root}.{path}") if name == "turnout" else F.coalesce(F.col(f"{root}.{path}").cast("string"), F.lit("0"))
            pair.append(falsy_text(f"{name}_{when}", other).alias(when))
        cells.append(F.struct(F.lit(name).alias("statistic"), *pair))
    return both.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def election_labels(year: Column) -> Column:
    """Two-digit labels of an election and the one before it: two years earlier, but 2017 before 2021."""
    before = F.when(year == 2021, 2017).otherwise(year - 2)
    return F.struct(F.right(year.cast("string"), F.lit(2)).alias("current"), F.right(before.cast("string"), F.lit(2)).alias("previous"))
