"""Status, ticker, changes, scalars and the stream on hand-made edge cases."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from seatloom import functions as fn
from seatloom import schemas
from seatloom.operators import changes, reconcile, sorts, status, ticker
from seatloom.sources import landing, readers
from seatloom.streaming import live, replay


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_scalars(spark):
    t = F.lit("2024-01-02 03:04:00").cast("timestamp")
    now = lambda text: F.lit(text).cast("timestamp")
    assert one(spark, fn.parse_int(F.lit(" 12x")), fn.parse_int(F.lit("x")), fn.number_or_zero(F.lit("1e2")), fn.number_or_zero(F.lit("1x")), fn.parse_decimal_comma(F.lit("15,3"))) == (12, None, 100.0, 0.0, 15.3)
    assert one(spark, fn.format_datetime_nl(t), fn.format_datetime_nl(F.lit(None).cast("timestamp")), fn.parse_nl_datetime(F.lit("02-01-2024 03:04")), fn.parse_nl_datetime(F.lit("x"))) == ("02-01-2024 03:04", "", 1704164640000, 0)
    assert one(spark, fn.relative_time(t, now("2024-01-02 03:04:59")), fn.relative_time(t, now("2024-01-02 05:04:00")), fn.relative_time(t, now("2024-01-01 00:00:00")), fn.relative_time_signed(t, now("2024-01-01 03:04:00"))) == ("59s geleden", "2u geleden", "0s geleden", "over 1d")
    assert one(spark, fn.format_number_nl(F.lit(-1234567)), fn.format_permille(F.lit(801), "%"), fn.format_permille(F.lit(None).cast("int"), "%"), fn.format_change(F.lit(3), F.lit(0)), fn.format_change(F.lit(3), F.lit(4))) == ("-1.234.567", "80,1%", "", "-", "-25,0")
    assert one(spark, fn.falsy_text(F.lit("0"), "b"), fn.falsy_text(F.lit(""), "b"), fn.falsy_number(F.lit(0), 5), fn.nullish(F.lit(0), 5)) == ("0", "b", 5, 0)
    f = one(spark, fn.fraction(F.lit(0.75)), fn.fraction(F.lit(0.9999999)), fn.fraction(F.lit(0.7071067)))
    assert (tuple(f[0]), tuple(f[1]), f[2]) == ((3, 4), (1, 1), None)
    assert one(spark, fn.status_class(F.lit("Tussenstand 2")), fn.status_class(F.lit(None).cast("string")), fn.election_key(F.lit("ps2023")), fn.election_key(F.lit("x 2021")), fn.election_key(F.lit(None).cast("string")), fn.clamp_percent(F.lit(120))) == ("partial", "zero", "PS2023", "TK2021", "TK2025", 100.0)
    assert one(spark, fn.truncate_text(F.lit("x" * 40)), fn.html_quote(F.lit('a"b')), fn.normal_name(F.lit(" a "))) == ("x" * 31 + "…", "a&quot;b", "A")


def test_numbers_as_texts(spark):
    want = {"1d": 0.0, "NaN": 0.0, "0x10": 16.0, "0b101": 5.0, "0o17": 15.0, "-0x10": 0.0, " 12 ": 12.0, "": 0.0, " ": 0.0, ".5": 0.5, "5.": 5.0, "-1e-2": -0.01, "1_0": 0.0, "1,5": 0.0, "1f": 0.0, "+7": 7.0, "Infinity": float("inf"), "-Infinity": float("-inf"), "inf": 0.0, "1e": 0.0, ".": 0.0}
    rows = spark.createDataFrame(list(want.items()), "t string, n double").select("t", fn.number_or_zero("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == want


def test_numbers_have_three_decimals_at_most(spark):
    want = {1234.5678: "1.234,568", 1.235: "1,235", 1234.5: "1.234,5", 1000000.0: "1.000.000", 0.0004: "0", -1234.25: "-1.234,25", 100.0: "100", 0.05: "0,05"}
    rows = spark.createDataFrame([(x,) for x in want], "x double").select("x", fn.format_number_nl("x").alias("t")).collect()
    assert {r.x: r.t for r in rows} == want


def test_changes_are_rounded_once_scaled(spark):
    """Halves that doubles miss by a bit before the scale of ten; the sign of what rounds to 0; nothing before."""
    want = {(316174, 4000): "7804,4", (493227, 14000): "3423,1", (1139, 8000): "-85,8", (8009, 8000): "0,1", (9996, 10000): "-0,0", (10004, 10000): "0,0", (9995, 10000): "-0,1", (5, 5): "0,0", (5, 0): "-", (5, None): "-"}
    rows = spark.createDataFrame(list(want), "a long, b long").select("a", "b", fn.format_change("a", "b").alias("t")).collect()
    assert {(r.a, r.b): r.t for r in rows} == want


def test_locale_order(spark):
    names = ["a1", "a1b9", "a1b10", "A1b10", "B1", "é1", "f1", "f01", "f2", "x", "x12345678901234567890", "x12345678901234567891"]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, pos int").repartition(3)
    assert [r.name for r in sorts.table_order(rows, *sorts.order_keys("name", True)).collect()] == names
    assert [r.name for r in sorts.place(rows, [], *fn.natural_key("name"), F.col("pos")).orderBy("place").collect()] == names


def test_a_party_without_votes_has_the_lowest_change(spark):
    rows = spark.createDataFrame([("up", 120, 100), ("gone", 0, 50), ("down", 90, 100), ("new", 10, None), ("like up", 1200, 1000), ("none", None, 0)], "p string, now long, before long")
    keys = {r.p: r.k for r in rows.select("p", reconcile.sort_change(F.col("now"), F.col("before")).alias("k")).collect()}
    assert keys == {"up": 16.7, "gone": float("-inf"), "down": -11.1, "new": 100.0, "like up": 16.7, "none": float("-inf")}


def test_until_changed_emits_each_change(spark):
    rows = spark.createDataFrame([("e", i, s) for i, s in enumerate(["A", "A", "B", "A", None, None])], "e string, seq int, s string")
    assert [r.seq for r in changes.until_changed(rows, ["e"], ["seq"], F.col("s")).orderBy("seq").collect()] == [0, 2, 3, 4]
    assert [r.island for r in changes.since(rows, ["e"], ["seq"], F.col("s"), "seq").orderBy("seq").collect()] == [1, 1, 2, 3, 4, 4]


def test_stream_suppresses_repeats_and_ranks_events(spark):
    rows = [("e", 1, "A", 10, {"p": 1}), ("e", 2, "A", 10, {"p": 1}), ("e", 3, "B", 12, {"p": 1}), ("e", 4, "A", 14, {"p": 2}), ("e", 5, "C", 9, {"p": 2}), ("f", 1, "A", 1, {})]
    out = replay.replay(spark, spark.createDataFrame(rows, live.SNAPSHOT))
    assert sorted((r.election, r.seq, r.event) for r in out.collect()) == [("e", 1, "first"), ("e", 3, "votes"), ("e", 4, "seats"), ("e", 5, "none"), ("f", 1, "first")]


def test_a_batch_that_comes_again_replaces_its_rows(spark, tmp_path):
    sink = live.write_batches(str(tmp_path / "out"))
    for n, rows in ((0, 3), (1, 2), (1, 2)):
        sink(spark.range(rows), n)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_work_can_be_removed(spark):
    df = landing.once(spark.range(5), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    landing.remove_work(spark)
    assert not os.path.exists(path)


def test_polling_ends_when_the_rule_holds(spark, tmp_path):
    rows = [("e", 1, "A", 10, {"p": 1}), ("e", 2, "B", 12, {"p": 2})]
    spark.createDataFrame(rows, live.SNAPSHOT).write.parquet(str(tmp_path / "in"))
    query = live.start(live.changes(live.read_snapshots(spark, str(tmp_path / "in"))), live.write_batches(str(tmp_path / "out")), str(tmp_path / "state"), every="200 milliseconds")
    asked = []
    live.stop_when(query, lambda: len(asked) > 3 or asked.append(1), 1)
    assert not query.isActive and len(asked) == 4
    live.stop_when(query, lambda: 1 / 0)  # a query that has ended isn't asked about


def test_since_keeps_its_state_between_batches(spark, tmp_path):
    for n, row in enumerate([("e", 1, "a|b|1", 50, 100), ("e", 2, "a|b|1", 150, 200), ("e", 3, "a|c|1", 999, 300), ("e", 4, "a|b|1", None, 400)]):
        spark.createDataFrame([row], live.PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = live.start(live.since(live.read_snapshots(spark, str(tmp_path / "in"), live.PAIR)), live.write_batches(str(tmp_path / "out")), str(tmp_path / "state"), every=None)
        query.awaitTermination()
    got = spark.read.schema(live.SINCE).option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.since) for r in got) == [(1, 50), (2, 50), (3, 300), (4, 400)]


def test_sort_directions_and_sources(spark):
    assert [sorts.toggled(None), sorts.toggled(None, "desc"), sorts.toggled("asc"), sorts.toggled("desc")] == ["asc", "desc", "desc", "asc"]
    rows = spark.createDataFrame([(0, "b10", "1.200", 0), (1, "b9", "", 0), (2, "a", "30", 0), (3, "Totaal", "5", 1)], "pos int, t string, n string, is_total int")
    order = lambda *x: [r.pos for r in sorts.table_order(rows, *sorts.order_keys(*x)).collect()]
    assert (order("n", True, "shown", "is_total"), order("n", False, "shown", "is_total")) == ([1, 2, 0, 3], [0, 2, 1, 3])
    assert (order("t", True, "text", "is_total"), order("t", False, "plain", "is_total")) == ([2, 1, 0, 3], [1, 0, 2, 3])
    with pytest.raises(ValueError):
        readers.municipality_detail(rows, "")


def test_progress_takes_each_municipality_once(spark):
    rows = [(0, "A", "g1", "Eindstand", 10), (1, "A", "g1", "Nulstand", 99), (2, "B", None, "Tussenstand", 5), (3, None, "", "Eindstand", 7), (4, "C", "g2", "Nulstand", None), (5, "D", "g3", "Nulstand", 15)]
    df = spark.createDataFrame(rows, "pos int, name string, cbs_code string, status string, population bigint")
    got = status.index_progress(df).first()
    assert (got.counted, got.eligible, got.places_counted, got.places, got.percent) == (15, 30, 2, 4, 0.5)
    assert status.index_progress(df.limit(0)).count() == 0


def test_regions_and_ticker(spark):
    view = lambda k, t, st, up, parent: (k, t, None, f"L{k}", 3, st, up, parent, ["p1", "zz"], None)
    docs = spark.createDataFrame([([view("1", 0, 4, 100, "9"), view("9", 2, 7, 50, ""), view("2", 0, 7, 100, "8")],)], schemas.REGIONS)
    views = readers.region_views(docs)
    labels = spark.createDataFrame([("p1", "Een")], "party string, label_short string")
    rows = {r.label: r for r in status.region_rows(views, labels).collect()}
    assert (rows["L1"].parent_label, rows["L9"].parent_label, rows["L2"].parent_label) == ("L9", "", "8")
    assert (rows["L1"].status, rows["L2"].status, rows["L1"].type, rows["L1"].top_current, rows["L1"].top_previous) == ("Eindstand", "7", "Gemeente", "Een, zz", "")
    index = spark.createDataFrame([(0, "B1", None, dt.datetime(1970, 1, 1, 0, 1, 40)), (1, "B2", "x", None)], "pos int, name string, status string, published timestamp")
    got = ticker.latest(ticker.items_from_index(index), ticker.items_from_regions(views), 3).collect()
    assert [(r.name, r.source, r.status) for r in got] == [("B1", "B", ""), ("L1", "A", "Eindstand"), ("L2", "A", "Nulstand")]
    assert status.drop_empty_columns(views, ["cbsCode", "label"]).columns.count("cbsCode") == 0


def test_bundle_and_index(spark):
    empty = spark.createDataFrame([], schemas.RESULTS)
    row = readers.bundle(empty, spark.createDataFrame([], schemas.REGIONS), spark.createDataFrame([], schemas.INDEX)).first()
    assert row.code == 502
    index = spark.createDataFrame([({"partijen": [{"partij": {"short_name": "A"}, "huidig": {"stemmen": 5}}, {"partij": None, "huidig": None}]}, [{"gemeente": {"naam": "X"}}])], schemas.INDEX)
    assert readers.bundle(empty, spark.createDataFrame([], schemas.REGIONS), index).first().code == 200
    assert [(r.code, r.votes) for r in readers.index_votes(index).orderBy("pos").collect()] == [("A", 5), (None, 0)]
    assert status.municipality_rows(readers.municipalities(index)).first().cbs_code == ""
