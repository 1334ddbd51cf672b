"""Streams that end by themselves, sums that are corrected, and a bounded ticker, batch by batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seatloom.operators import status
from seatloom.streaming import live


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def snapshots(r, last):
    """Files of status rows; the last one makes every place final."""
    places = [f"p{k}" for k in range(6)]
    files = [[(p, n, r.choice(["Nulstand", "Tussenstand", "Eindstand", None]), r.choice([10, 20, None])) for p in places if n == 0 or r.random() < 0.7] for n in range(4)]
    return [*files, [(p, 9, "Eindstand", 10) for p in places]] if last else [*files, [("p0", 9, "Tussenstand", 5)]]


def test_a_stream_stops_once_all_places_are_final(spark, tmp_path):
    for n, rows in enumerate(snapshots(random.Random(1), True)):
        land(spark, tmp_path / "in", rows, live.PLACE)
    seen = []
    sink = lambda df, n: seen.append(sorted(map(tuple, df.collect()))) if len(seen) == n else None
    assert live.run_until_settled(live.read_snapshots(spark, str(tmp_path / "in"), live.PLACE, files=1), sink, str(tmp_path / "state"), every="0 seconds", seconds=120)
    assert seen[-1] == [(f"p{k}", 9, "Eindstand", 10) for k in range(6)]


def test_an_open_count_goes_on(spark, tmp_path):
    for rows in snapshots(random.Random(2), False):
        land(spark, tmp_path / "in", rows, live.PLACE)
    seen = []
    stream = live.read_snapshots(spark, str(tmp_path / "in"), live.PLACE)
    assert not live.run_until_settled(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "state"), every="0 seconds", seconds=12)
    assert seen and not spark.streams.active


def test_official_rows_end_an_open_count(spark, tmp_path):
    land(spark, tmp_path / "in", snapshots(random.Random(2), False)[0], live.PLACE)
    stream = live.read_snapshots(spark, str(tmp_path / "in"), live.PLACE)
    assert live.run_until_settled(stream, lambda df, n: df.collect(), str(tmp_path / "state"), every="0 seconds", official=spark.range(1), seconds=120)


def test_progress_after_each_batch(spark, tmp_path):
    files = snapshots(random.Random(3), True) + [[("p1", 3, "Nulstand", 99)]]  # an older row that comes late changes nothing
    far = []
    for n, rows in enumerate(files):
        land(spark, tmp_path / "in", rows, live.PLACE)
        far += rows
        stream = live.progress_changes(live.read_snapshots(spark, str(tmp_path / "in"), live.PLACE))
        writer = stream.writeStream.outputMode("update").foreachBatch(live.sum_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        newest = live.latest_places(spark.createDataFrame(far, live.PLACE))
        want = [tuple(x) for x in status.progress(newest, []).select("counted", "eligible", "places_counted", "places").collect()]
        assert [tuple(x) for x in live.last_batch(spark, str(tmp_path / "out"), live.DELTA).collect()] == want


def test_ticker_after_each_batch(spark, tmp_path):
    r = random.Random(4)
    at = lambda m: dt.datetime(2025, 10, 29, 21, m) if m is not None else None
    far = []
    for n in range(4):
        rows = [(r.randint(0, 1), 100 * n + k, f"n{k}", at(r.choice([1, 2, 3, n * 9, None]))) for k in range(12)]
        land(spark, tmp_path / "in", rows, live.ITEM)
        far += rows
        live.start(live.read_snapshots(spark, str(tmp_path / "in"), live.ITEM), live.top_batches(str(tmp_path / "out")), str(tmp_path / "state"), every=None).awaitTermination()
        state = live.last_batch(spark, str(tmp_path / "out"), live.ITEM)
        assert state.groupBy("feed").count().agg(F.max("count")).first()[0] <= 5
        want = sorted(far, key=lambda x: (x[3] is None, -(x[3].timestamp()) if x[3] else 0, x[0], x[1]))[:5]
        assert [tuple(x) for x in live.top_items(state).collect()] == want


def test_a_stream_goes_on_where_history_ends(spark, tmp_path):
    """Cut anywhere, the events are those of the whole sequence; elections without history begin at their first."""
    r = random.Random(5)
    rows = [(e, n, r.choice("abc"), r.choice([None, 10, 20]), r.choice([None, {}, {"p": 1}, {"p": 1, "q": None}, {"p": 2}])) for e in "xyz" for n in range(12)]
    def events(cut):
        path = tmp_path / f"cut{cut}"
        land(spark, path / "in", [x for x in rows if x[1] >= cut or x[0] == "z"], live.SNAPSHOT)
        stored = spark.createDataFrame([x for x in rows if x[1] < cut and x[0] != "z"], live.SNAPSHOT)
        with live.typed_state(spark):
            stream = live.changes_after(live.read_snapshots(spark, str(path / "in")), stored)
            query = live.start(stream, live.write_batches(str(path / "out")), str(path / "state"), every=None)
            assert query.awaitTermination(100)
        return {tuple(x) for x in spark.read.parquet(str(path / "out")).select("election", "seq", "signature", "event").collect()}

    land(spark, tmp_path / "in", rows, live.SNAPSHOT)
    live.start(live.changes(live.read_snapshots(spark, str(tmp_path / "in"))), live.write_batches(str(tmp_path / "out")), str(tmp_path / "state"), every=None).awaitTermination(100)
    whole = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("election", "seq", "signature", "event").collect()}
    for cut in (0, 7):
        assert events(cut) == {x for x in whole if x[1] >= cut or x[0] == "z"}
