"""Live snapshots by Structured Streaming: polling, repeats suppressed, change events.

State is one small row per election, whatever the number of snapshots. Snapshots come at the pace of
polling, a few a minute, so they are stepped through in Python, one election's at a time.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POLL = "30 seconds"

SNAPSHOT = "election string, seq bigint, signature string, total bigint, seats map<string, bigint>"
EVENT = "election string, seq bigint, signature string, event string"
PAIR = "election string, seq bigint, signature string, updated bigint, now bigint"
SINCE = "election string, seq bigint, signature string, since bigint"
LAST = "signature string, total bigint, seats map<string, bigint>"
STATE = f"seen boolean, {LAST}"
PLACE = "place string, seq bigint, status string, population bigint"
DELTA = "counted bigint, eligible bigint, places_counted bigint, places bigint"
ITEM = "feed int, pos bigint, name string, ts timestamp"


def read_snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOT, files: int | None = None) -> DataFrame:
    """A landing folder of Parquet snapshots as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def _whole(n) -> int | None:
    return None if pd.isna(n) else int(n)


def _walk(election: str, rows: pd.DataFrame, last: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Events of an election's snapshots in order of seq, after the last one (signature, total, seats), and the new last one."""
    out = []
    for row in rows.sort_values("seq", kind="stable").itertuples():
        total, now = _whole(row.total), {p: _whole(n) for p, n in dict(row.seats or {}).items()}
        if last and row.signature == last[0]:
            continue
        if not last:
            event = "first"
        elif any(n != dict(last[2] or {}).get(p, 0) for p, n in now.items()):
            event = "seats"
        else:
            event = "votes" if (total or 0) > (last[1] or 0) else "none"
        out.append((election, row.seq, row.signature, event))
        last = (row.signature, total, now)
    return out, last


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out, last = _walk(key[0], pd.concat(list(batches)), state.get[1:] if state.exists else None)
    state.update((True, *last))
    yield pd.DataFrame(out, columns=["election", "seq", "signature", "event"])


def changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose signature differs from the one before of the same election, with the event: first, seats, votes or none.

    A seat change outranks a growth in votes. The order within a batch is seq; batches come as they arrive.
    """
    return snapshots.groupBy("election").applyInPandasWithState(_step, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


class _ChangesAfter(StatefulProcessor):
    """changes() whose state begins with a stored snapshot of each election."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", LAST)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = next(initialState.itertuples())
        self.last.update((row.signature, _whole(row.total), dict(row.seats or {})))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = _walk(key[0], pd.concat(list(rows)), tuple(self.last.get()) if self.last.exists() else None)
        self.last.update(last)
        yield pd.DataFrame(out, columns=["election", "seq", "signature", "event"])

    def close(self) -> None: ...


def changes_after(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """changes() of a stream that goes on where stored snapshots (SNAPSHOT, of any number) end: the events that the whole sequence has from there on.

    Each election's state begins with its newest stored snapshot; elections without one begin at their
    first. History counts when the stream first starts; a restart goes on from its checkpoint. The stream
    must run with typed_state() set.
    """
    newest = history.groupBy("election").agg(F.max_by(F.struct("signature", "total", "seats"), "seq").alias("x")).select("election", "x.*")
    return snapshots.groupBy("election").transformWithStateInPandas(_ChangesAfter(), EVENT, "Append", "None", initialState=newest.groupBy("election"))


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _since_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    signature, began = state.get if state.exists else (None, None)
    out = []
    for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
        if began is None or row.signature != signature:
            known = pd.notna(row.updated) and 0 < row.updated <= row.now
            signature, began = row.signature, int(row.updated if known else row.now)
        out.append((key[0], row.seq, signature, began))
    state.update((signature, began))
    yield pd.DataFrame(out, columns=["election", "seq", "signature", "since"])


def since(snapshots: DataFrame) -> DataFrame:
    """Snapshots (PAIR, times in microseconds) with the time at which their signature began.

    A new signature begins at the update's time if that lies after the epoch and not after now, else
    now. The state outlives a restart with the stream's checkpoint.
    """
    return snapshots.groupBy("election").applyInPandasWithState(_since_step, SINCE, "signature string, began bigint", "append", GroupStateTimeout.NoTimeout)


def latest_places(rows: DataFrame) -> DataFrame:
    """(place, seq, status, population): the newest row of each place in a stream of PLACE rows, for complete mode. State is a row for each place."""
    newest = F.max_by(F.struct("status", "population"), F.struct("seq", "status", "population")).alias("x")
    return rows.groupBy("place").agg(F.max("seq").alias("seq"), newest).select("place", "seq", "x.status", "x.population")


class StopWhenSettled(StreamingQueryListener):
    """Ends queries whose observed metrics say that nothing more is to come: there are places and all are final, or there are official rows.

    Metrics come from observed(). A query is stopped by a thread of its own, since a listener must return.
    """

    def __init__(self, spark: SparkSession, name: str = "settled"):
        self.spark, self.name = spark, name

    def settled(self, metrics: dict) -> bool:
        row = metrics.get(self.name)
        return row is not None and bool(row["official"] or (row["places"] and row["final"] == row["places"]))

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if self.settled(event.progress.observedMetrics) and (query := self.spark.streams.get(str(event.progress.id))):
            threading.Thread(target=query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def observed(places: DataFrame, official: DataFrame | None = None, name: str = "settled") -> DataFrame:
    """latest_places() with the metrics that StopWhenSettled reads. official: stored official rows, of which one is enough; they are looked for once."""
    exists = official is not None and not official.isEmpty()
    return places.observe(name, F.count("*").alias("places"), F.count_if(F.col("status") == "Eindstand").alias("final"), F.max(F.lit(exists)).alias("official"))


def run_until_settled(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = POLL, official: DataFrame | None = None, seconds: int | None = None) -> bool:
    """Follow PLACE rows, the newest of each place to the sink in each batch, until they are settled. False if that hasn't come after seconds; the query is stopped then, too."""
    spark = stream.sparkSession
    listener = StopWhenSettled(spark)
    spark.streams.addListener(listener)
    try:
        rows = observed(latest_places(stream), official)
        query = rows.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
        ended = query.awaitTermination(seconds) if seconds else query.awaitTermination() or True
        if not ended:
            query.stop()
        return bool(ended)
    finally:
        spark.streams.removeListener(listener)


def _progress_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, counted, people = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(batches))
    last = rows.sort_values(["seq", "status", "population"], na_position="first", kind="stable").iloc[-1]
    if known is None or last.seq >= known:
        now = int(last.population) if pd.notna(last.population) else 0
        done = int(last.status in ("Tussenstand", "Eindstand"))
        yield pd.DataFrame([(done * now - counted * people, now - people, done - counted, int(known is None))], columns=["counted", "eligible", "places_counted", "places"])
        state.update((int(last.seq), done, now))


def progress_changes(rows: DataFrame) -> DataFrame:
    """What each batch of PLACE rows changes in the sums of progress: a place that is new, counted or of another population. State is a place's newest row."""
    return rows.where("place is not null and seq is not null").groupBy("place").applyInPandasWithState(_progress_step, DELTA, "seq bigint, counted bigint, people bigint", "update", GroupStateTimeout.NoTimeout)


def _carried(path: str, n: int, spark: SparkSession, schema: str) -> DataFrame:
    """What the batch before has left in its folder; nothing before the first."""
    return spark.read.schema(schema).parquet(f"{path}/batch={n - 1}") if n else spark.createDataFrame([], schema)


def sum_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of progress_changes(): a folder for each batch with the sums so far. A batch that comes again starts from the same folder."""

    def sink(df: DataFrame, n: int) -> None:
        both = df.unionByName(_carried(path, n, df.sparkSession, DELTA))
        sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in df.columns))
        sums.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return sink


def top_batches(path: str, k: int = 5) -> Callable[[DataFrame, int], None]:
    """A sink of ITEM rows of several feeds: a folder for each batch with the first k rows of each feed so far, the newest first, ties by position.

    The first k of all feeds are among them, whatever comes later, so no more is ever kept. Each feed's
    rows of a batch are cut to k where they are before they meet what the batch before has left.
    """
    order = [F.desc_nulls_last("ts"), F.col("pos")]

    def sink(df: DataFrame, n: int) -> None:
        before = _carried(path, n, df.sparkSession, ITEM)
        df.persist()
        feeds = sorted({x.feed for x in df.select("feed").distinct().collect()} | {x.feed for x in before.select("feed").distinct().collect()})
        kept = df.sparkSession.createDataFrame([], ITEM)
        for feed in feeds:
            kept = kept.unionByName(df.where(F.col("feed") == feed).unionByName(before.where(F.col("feed") == feed)).orderBy(*order).limit(k))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")
        df.unpersist()

    return sink


def top_items(state: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows over all feeds of what top_batches() has left: the newest first, ties to the first feed, then by position."""
    return state.orderBy(F.desc_nulls_last("ts"), "feed", "pos").limit(k)


def last_batch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest batch's folder."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch: a batch that comes again replaces its own rows."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = POLL) -> StreamingQuery:
    """Run a sink on each batch, every 30 seconds by default, or once over what is there (every=None)."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop_when(query: StreamingQuery, done: Callable[[], bool], seconds: int = 30) -> None:
    """Stop a query once done() holds, asked at first and after each wait. An error of the query rises."""
    while query.isActive:
        if done():
            query.stop()
            return
        query.awaitTermination(seconds)
    if query.exception():
        raise query.exception()
