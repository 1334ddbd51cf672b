"""Readers: JSON documents of each layout to flat DataFrames, Parquet tables, and the routing between sources.

Every reader takes paths that Spark can open and gives a lazy DataFrame with a fixed schema. A path
that doesn't exist gives an empty one where the source is optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import election_key, falsy_text, from_epoch, from_iso, json_kind, loose_number, normal_name, parse_decimal_comma, parse_int

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Sources of an election by name: whether a code of a municipality must be given.
CATALOG = {"results": False, "regions": False, "forecast": False, "index": False, "municipality": True, "all": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_document(spark: SparkSession, path: str, schema: str, optional: bool = True) -> DataFrame:
    """JSON documents by an explicit schema. An optional path that isn't there is an empty table."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_elections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a folder for each election, with its key in election."""
    return spark.read.schema(f"{schema}, election string").option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A document that is one map, as rows (key, value) in document order: pos, key, value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("pos", "e")).select("pos", "e.key", "e.value")


def last_good(snapshots: DataFrame, key: str = "source") -> DataFrame:
    """Of snapshots (source, snapshot_ts, body), the newest with a body for each source: stale data rather than none."""
    whole = F.max_by(F.struct(*snapshots.columns), "snapshot_ts")
    return snapshots.where(F.col("body").isNotNull()).groupBy(F.col(key).alias("_of")).agg(whole.alias("_row")).select("_row.*")


def fresh(snapshots: DataFrame, as_of: str, ttl_seconds: int = 10) -> DataFrame:
    """Snapshots that are no older than the time to live at as_of; others must be read anew."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("snapshot_ts")
    return snapshots.where(age.between(0, ttl_seconds * 1_000_000))


def serve(requests: DataFrame, snapshots: DataFrame, as_of: str, ttl_seconds: int = 10) -> DataFrame:
    """How each request (election, version) is answered from the cache of snapshots (election, version, snapshot_ts, body).

    Adds body and origin: cache for a whole snapshot within the time to live, fetch without one. stale is the
    newest whole snapshot of the election in any version, which answers if the fetch fails; null without any.
    """
    keyed = snapshots.where(F.unix_micros("snapshot_ts") <= F.unix_micros(F.lit(as_of).cast("timestamp")))
    newest = last_good(keyed.withColumn("_key", F.struct("election", "version")), "_key").drop("_key")
    hits = fresh(newest, as_of, ttl_seconds).select("election", "version", "body", F.lit("cache").alias("_origin"))
    old = last_good(keyed, "election").select("election", F.col("body").alias("stale"))
    rows = requests.join(hits, ["election", "version"], "left").join(old, "election", "left")
    return rows.select("election", "version", "body", F.coalesce("_origin", F.lit("fetch")).alias("origin"), "stale")


def party_results(documents: DataFrame, election: str | None = None) -> DataFrame:
    """Feed A's documents, one row per party (election: given, or the documents' own column): election, pos, party, {current,previous,diff}_{votes,percentage,seats}, updated, status."""
    key = F.lit(election) if election is not None or "election" not in documents.columns else F.col("election")
    rows = documents.select(key.alias("election"), from_epoch("updated").alias("updated"), "status", F.posexplode("parties").alias("pos", "p"))
    figures = []
    for when in ("current", "previous", "diff"):
        figures += [parse_int(f"p.results.{when}.votes").alias(f"{when}_votes"), parse_decimal_comma(f"p.results.{when}.percentage").cast("decimal(5,1)").alias(f"{when}_percentage"), parse_int(f"p.results.{when}.seats").cast("int").alias(f"{when}_seats")]
    return rows.select("election", "pos", F.col("p.key").alias("party"), *figures, "updated", "status")


def old_party_results(documents: DataFrame, election: str | None = None) -> DataFrame:
    """The older layout in party_results()' columns; differences are computed."""
    rows = documents.select(F.lit(election).alias("election"), from_iso("updated").alias("updated"), "status", F.posexplode("parties").alias("pos", "p"))
    of = lambda when, name: F.col(f"p.{when}.{name}")
    out = {}
    for alias, when in (("current", "now"), ("previous", "last")):
        out |= {f"{alias}_votes": parse_int(of(when, "count")), f"{alias}_percentage": of(when, "perc").try_cast("decimal(5,1)"), f"{alias}_seats": parse_int(of(when, "seats")).cast("int")}
    rows = rows.withColumns(out)
    diff = {f"diff_{n}": F.col(f"current_{n}") - F.col(f"previous_{n}") for n in ("votes", "percentage", "seats")}
    rows = rows.withColumns(diff).withColumn("diff_percentage", F.col("diff_percentage").cast("decimal(5,1)"))
    order = [f"{a}_{n}" for a in ("current", "previous", "diff") for n in ("votes", "percentage", "seats")]
    return rows.select("election", "pos", F.coalesce("p.labelShort", "p.label").alias("party"), *order, "updated", "status")


def labels(maps: DataFrame) -> DataFrame:
    """read_map(LABELS) as rows: election, list_number (place in the list), party, label_long, label_short, code, color.

    Each label falls back on the other. Of repeated keys the last stands.
    """
    rows = maps.select(F.col("key").alias("election"), F.posexplode("value").alias("pos", "p"))
    rows = rows.select("election", (F.col("pos") + 1).alias("list_number"), F.col("p.key").alias("party"), falsy_text("p.labelLong", falsy_text("p.labelShort", "")).alias("label_long"), falsy_text("p.labelShort", falsy_text("p.labelLong", "")).alias("label_short"), F.col("p.labelShortNOS").alias("code"), F.col("p.color").alias("color"))
    return last_per_key(rows, ["election", "party"], "list_number")


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as when a map is written again and again."""
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def official_votes(maps: DataFrame) -> DataFrame:
    """read_map(OFFICIAL) as rows: election, pos, list_number, votes."""
    rows = maps.select(F.col("key").alias("election"), F.posexplode("value").alias("pos", "p"))
    return rows.select("election", "pos", F.col("p.lijstnummer").alias("list_number"), F.col("p.votes").alias("votes"))


def exit_poll(maps: DataFrame) -> DataFrame:
    """read_map(EXIT_POLL) as rows: election, party_pos, name (normalised), pos, time (null in the flat layout), seats.

    The layout follows from the kind of JSON value, and each number from its own, so one odd value costs
    no other. Parties without a name drop out, and so do values that loose_number() can't take; fractions
    of seats are cut. VARIANT objects don't keep the order of their fields, so it comes from maps.
    """
    kind = json_kind(F.try_parse_json("value"))
    one = maps.where(kind == "array").select(F.col("key").alias("election"), F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "p"))
    one = one.select("election", F.col("pos").alias("party_pos"), F.try_variant_get("p", "$.party", "string").alias("name"), "pos", F.lit(None).cast("string").alias("time"), F.try_variant_get("p", "$.seats", "variant").alias("seats"))
    two = maps.where(kind == "object").select(F.col("key").alias("election"), F.posexplode(F.map_entries(F.from_json("value", "map<string, string>"))).alias("party_pos", "p"))
    two = two.select("election", "party_pos", F.col("p.key").alias("name"), F.posexplode(F.map_entries(F.from_json("p.value", "map<string, variant>"))).alias("pos", "e"))
    rows = one.unionByName(two.select("election", "party_pos", "name", "pos", F.col("e.key").alias("time"), F.col("e.value").alias("seats")))
    rows = rows.select("election", "party_pos", normal_name("name").alias("name"), "pos", "time", loose_number("seats").try_cast("int").alias("seats"))
    return rows.where("seats is not null and name <> ''")


def latest_poll(polls: DataFrame) -> DataFrame:
    """The last value in document order for each party, whatever its time."""
    return polls.groupBy("election", "name").agg(F.max_by("seats", "pos").alias("expected"))


def poll_times(polls: DataFrame) -> DataFrame:
    """Different poll times of all parties in order of first occurrence: election, place, time."""
    firsts = polls.where("time is not null").groupBy("election", "time").agg(F.min(F.struct("party_pos", "pos")).alias("at"))
    return firsts.select("election", F.row_number().over(Window.partitionBy("election").orderBy("at")).cast("bigint").alias("place"), "time")


def elections(maps: DataFrame, plain: bool = False) -> DataFrame:
    """Years that a map has, ascending: of keys TKyyyy or yyyy, or with plain of yyyy only."""
    pattern = r"^\d{4}$" if plain else r"^(TK)?\d{4}$"
    return maps.where(F.col("key").rlike(pattern)).select(F.regexp_extract("key", r"\d{4}", 0).cast("int").alias("year")).distinct().orderBy("year")


def latest_election(maps: DataFrame, plain: bool = False) -> DataFrame:
    """The last of elections(), null without any."""
    return elections(maps, plain).agg(F.max("year").alias("year"))


def municipality_detail(details: DataFrame, cbs_code: str | None) -> DataFrame:
    """The detail of one municipality: a filter that reaches a table partitioned by cbs_code. ValueError without a code."""
    if not cbs_code:
        raise ValueError("a source of a municipality needs its code")
    return details.where(F.col("cbs_code") == cbs_code)


def finalized(official: DataFrame) -> DataFrame:
    """Elections that have official rows."""
    return official.groupBy("election").agg(F.count("*").alias("n")).where("n > 0").select("election")


def route(requests: DataFrame, official: DataFrame, mode: str = "auto") -> DataFrame:
    """Add origin to requests (election): local where the election is final or mode says so, else remote."""
    if mode in ("local", "remote"):
        return requests.withColumn("origin", F.lit(mode))
    if mode != "auto":
        raise ValueError(f"mode {mode!r}: auto, local or remote")
    done = finalized(official).withColumn("_final", F.lit(True))
    return requests.join(done, "election", "left").withColumn("origin", F.when(F.col("_final"), "local").otherwise("remote")).drop("_final")


def resolve(requests: DataFrame) -> DataFrame:
    """Requests (election, source, cbs_code) with the election's key and an HTTP status: 400 for a source that doesn't exist or lacks its code."""
    known = F.col("source").isin(*CATALOG)
    coded = F.col("source").isin(*(k for k, v in CATALOG.items() if v)) & (F.coalesce("cbs_code", F.lit("")) == "")
    return requests.withColumn("election", election_key("election")).withColumn("code", F.when(known & ~coded, 200).otherwise(400))


def bundle(results: DataFrame, regions: DataFrame, index: DataFrame) -> DataFrame:
    """Three one-document sources as one row of structs, a missing one null; status 502 only where all are."""
    one = lambda df, name: df.agg(F.first(F.struct(*df.columns)).alias(name)).withColumn("_k", F.lit(1))
    row = one(results, "results").join(one(regions, "regions"), "_k").join(one(index, "index"), "_k").drop("_k")
    return row.withColumn("code", F.when(F.col("results").isNull() & F.col("regions").isNull() & F.col("index").isNull(), 502).otherwise(200))


def region_views(documents: DataFrame) -> DataFrame:
    """Feed A's regions, one row each, pos first."""
    return documents.select(F.posexplode("views").alias("pos", "v")).select("pos", "v.*")


def municipalities(index: DataFrame) -> DataFrame:
    """Feed B's municipalities, nested fields by their paths, absent ones null."""
    rows = index.select(F.posexplode("gemeentes").alias("pos", "g"))
    return rows.select(
        "pos", F.col("g.gemeente.naam").alias("name"), F.col("g.gemeente.cbs_code").alias("cbs_code"), F.col("g.status").alias("status"), F.col("g.publicatie_datum_tijd").alias("published"),
        F.col("g.gemeente.aantal_inwoners").alias("population"), F.col("g.gemeente.kieskring").alias("district"), F.col("g.gemeente.provincie.naam").alias("province"), F.col("g.gemeente.provincie.aantal_inwoners").alias("province_population"),
        F.col("g.eerste_partij.short_name").alias("first_party"), F.col("g.tweede_partij.short_name").alias("second_party"),
        F.col("g.huidige_verkiezing.opkomst_promillage").alias("turnout_now"), F.col("g.vorige_verkiezing.opkomst_promillage").alias("turnout_before"),
    )


def index_votes(index: DataFrame) -> DataFrame:
    """Feed B's national votes: pos, code, votes; votes that aren't numbers count 0."""
    rows = index.select(F.posexplode("landelijke_uitslag.partijen").alias("pos", "p"))
    return rows.select("pos", F.col("p.partij.short_name").alias("code"), F.coalesce("p.huidig.stemmen", F.lit(0)).alias("votes"))


def result_totals(documents: DataFrame) -> DataFrame:
    """Feed A's statistics, texts as they are: {voters,turnout,turnoutCount,invalid,blank}_{current,previous}."""
    names = ("voters", "turnout", "turnoutCount", "invalid", "blank")
    return documents.select(*(F.col(f"{n}.{w}").alias(f"{n}_{w}") for n in names for w in ("current", "previous")))

