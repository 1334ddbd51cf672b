"""Regions and municipalities: status rows, labels of arrays and parents, progress, completeness, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode, falsy_text, format_datetime_nl, format_permille

#: Fixed values of the feeds' codes.
REGION_TYPES = {0: "Gemeente", 1: "Provincie", 2: "Land"}
STATUSES = {0: "Nulstand", 2: "Tussenstand", 4: "Eindstand"}
COUNTED = ("Tussenstand", "Eindstand")


def with_parent(rows: DataFrame, key: str, parent: str, label: str) -> DataFrame:
    """Add parent_label by a self join: the raw key where no row has it, empty for an empty parent."""
    other = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropDuplicates(["_key"])
    joined = rows.join(other, F.col(parent) == F.col("_key"), "left")
    return joined.withColumn("parent_label", F.when(F.coalesce(F.col(parent).cast("string"), F.lit("")).isin("", "0"), "").otherwise(F.coalesce("_label", F.col(parent).cast("string")))).drop("_key", "_label")


def array_labels(rows: DataFrame, id_col: str, array_col: str, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, labels): each array's elements replaced by labels, order kept, unknown ones as they are, joined by ', '."""
    each = rows.select(id_col, F.posexplode_outer(array_col).alias("_pos", "_key"))
    named = each.join(labels.select(F.col(key).alias("_k"), F.col(label).alias("_label")), F.col("_key") == F.col("_k"), "left")
    item = F.when(F.col("_key").isNotNull(), F.struct("_pos", F.coalesce("_label", "_key").alias("x")))
    return named.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(item))["x"], ", ").alias("labels"))


def region_rows(views: DataFrame, labels: DataFrame) -> DataFrame:
    """Feed A's regions as shown: codes decoded (unknown ones pass), parent and top parties by label."""
    rows = with_parent(views, "key", "parent", "label")
    for c in ("topPartiesCurrent", "topPartiesPrevious"):
        rows = rows.join(array_labels(views, "pos", c, labels, "party", "label_short").withColumnRenamed("labels", f"{c}_labels"), "pos", "left")
    return rows.select("pos", "label", decode("type", REGION_TYPES).alias("type"), decode("status", STATUSES).alias("status"), F.timestamp_seconds("updated").alias("updated"), format_datetime_nl(F.timestamp_seconds("updated")).alias("updated_text"), "countParties", "parent_label", F.coalesce("topPartiesCurrent_labels", F.lit("")).alias("top_current"), F.coalesce("topPartiesPrevious_labels", F.lit("")).alias("top_previous"))


def municipality_rows(rows: DataFrame) -> DataFrame:
    """Feed B's municipalities as shown: absent texts empty, turnout as percentages."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("name", "cbs_code", "status", "district", "province", "first_party", "second_party")}
    return rows.withColumns({**text, "published_text": format_datetime_nl("published"), "turnout_now_text": format_permille("turnout_now", "%"), "turnout_before_text": format_permille("turnout_before", "%")})


def drop_empty_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns in which no row has a value. One row of counts goes to the driver."""
    filled = rows.agg(*(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns)).first()
    return rows.drop(*(c for c in columns if not filled[c]))


def first_per_key(rows: DataFrame, key: Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key in the order given; rows without a key drop out."""
    keyed = rows.withColumn("_key", key).where("_key is not null")
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def progress(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of inhabitants in municipalities that have counted, partly or wholly, with the counts: rows need status and population. No row where nobody lives."""
    counted = F.col("status").isin(*COUNTED)
    people = F.coalesce("population", F.lit(0))
    sums = rows.groupBy(*by).agg(F.sum(F.when(counted, people).otherwise(0)).alias("counted"), F.sum(people).alias("eligible"), F.count_if(counted).alias("places_counted"), F.count("*").alias("places"))
    return sums.where("eligible > 0").withColumn("percent", F.col("counted").cast("double") / F.col("eligible").cast("double"))


def index_progress(municipalities: DataFrame) -> DataFrame:
    """progress() of feed B's index, municipalities once each: by code, or by name without one."""
    key = falsy_text("cbs_code", falsy_text("name", None))
    return progress(first_per_key(municipalities, key, ["pos"]), [])


def complete(rows: DataFrame, by: list[str], final: Column) -> DataFrame:
    """complete: rows exist and all are final."""
    return rows.groupBy(*by).agg(F.bool_and(F.coalesce(final, F.lit(False))).alias("complete"))


def max_signature(a: DataFrame, b: DataFrame, ts: str) -> DataFrame:
    """The newest time in each feed in epoch seconds, 0 without, and both as one text."""
    newest = lambda df, name: df.agg(F.coalesce(F.max(F.unix_seconds(F.col(ts).cast("timestamp"))), F.lit(0)).alias(name)).withColumn("_k", F.lit(1))
    return newest(a, "max_a").join(newest(b, "max_b"), "_k").drop("_k").withColumn("signature", F.concat_ws("|", F.col("max_a").cast("string"), F.col("max_b").cast("string")))


def latest_per_key(rows: DataFrame, keys: list[str], ts: str, order: list[str | Column]) -> DataFrame:
    """The newest row of each key, the first in the order given on ties; rows without a time come last."""
    newest = F.struct(F.col(ts).isNull(), -F.unix_micros(F.col(ts).cast("timestamp")), *order)
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(F.struct(*rows.columns), newest).alias("_row")).select("_row.*")


def document_status(results: DataFrame, views: DataFrame) -> DataFrame:
    """What a page says of its sources: the documents' own time as text, and the first municipality in document order with its time."""
    first = first_match(views.withColumn("_k", F.lit(1)), ["_k"], F.col("type") == 0, "pos", "label", "updated")
    one = results.agg(F.max(F.timestamp_seconds("updated")).alias("t")).withColumn("_k", F.lit(1))
    joined = one.join(first, "_k", "left")
    return joined.select(format_datetime_nl("t").alias("document_time"), F.coalesce("label", F.lit("")).alias("municipality"), format_datetime_nl(F.timestamp_seconds("updated")).alias("municipality_time"))


def first_match(rows: DataFrame, by: list[str], where: Column, pos: str, *columns: str) -> DataFrame:
    """The first matching row in document order."""
    return rows.where(where).groupBy(*by).agg(F.min_by(F.struct(*columns), F.col(pos)).alias("m")).select(*by, "m.*")


def eligible_total(index: DataFrame, details: DataFrame, election: str) -> DataFrame:
    """Eligible voters over the municipalities whose detail is there and of the election (TKyy)."""
    joined = index.join(details, "cbs_code").where(F.col("huidige_verkiezing.verkiezing_code") == election)
    return joined.agg(F.coalesce(F.sum("huidige_verkiezing.kiesgerechtigden"), F.lit(0)).alias("eligible"))
