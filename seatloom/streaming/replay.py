"""Replay of stored snapshots through the streaming operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import work_path
from . import live


def replay(spark: SparkSession, snapshots: DataFrame, operator: Callable[[DataFrame], DataFrame] = live.changes, schema: str = live.SNAPSHOT, result: str = live.EVENT, until: int | None = None) -> DataFrame:
    """An operator's rows of stored snapshots: written as a landing folder, streamed, read back.

    All that is there is streamed once; with until, the folder is polled each second until a row with
    that seq has come.
    """
    landing, out, state = (work_path(spark, x) for x in ("landing", "events", "state"))
    snapshots.write.parquet(landing)
    names = [x.split()[0] for x in result.split(", ")]
    read = lambda: spark.read.schema(f"{result}, batch int").parquet(out).select(*names)
    stream = operator(live.read_snapshots(spark, landing, schema))
    query = live.start(stream, live.write_batches(out), state, every=None if until is None else "1 second")
    if until is None:
        query.awaitTermination()
    else:
        live.stop_when(query, lambda: bool(query.lastProgress) and not read().where(F.col("seq") >= until).isEmpty(), 1)
    return read()


def daily_snapshots(events: DataFrame) -> DataFrame:
    """Events of each day as a snapshot: votes by type, a seat for every 20."""
    counts = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    days = counts.groupBy("day").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.expr("n div 20").alias("seats"))))).alias("seats"))
    seq = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint")
    return days.select(F.lit("e").alias("election"), seq.alias("seq"), F.concat_ws("|", F.col("total").cast("string"), F.to_json("seats")).alias("signature"), "total", "seats")
