"""Tags of whole tables and folders that are written once."""

import random

from pyspark.sql import functions as F

from seatloom.sources.landing import land_tagged, merge_tags, table_tag

SCHEMA = "`a.b` bigint, text string, list array<int>"


def tag(df):
    return tuple(table_tag(df).first())


def test_tags_tell_multisets(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, "", "x", 'é"']), r.choice([None, [], [1, None]])) for _ in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA).repartition(7).select("list", "`a.b`", "text")
    assert tag(df) == tag(mixed) and tag(df)[0] == 200
    assert tag(df) != tag(df.unionByName(df.limit(1))) and tag(df.distinct()) != tag(df)
    assert tag(spark.createDataFrame([], SCHEMA)) == (0, 0, 0)
    distinct = {repr(row): row for row in rows}.values()
    assert len({tag(spark.createDataFrame([row], SCHEMA)) for row in distinct}) == len(distinct)


def test_tags_of_unions_add_up(spark):
    df = spark.range(1000).withColumn("part", F.col("id") % 7)
    parts = table_tag(df, "part")
    assert tuple(merge_tags(parts).first()) == tag(df) and parts.count() == 7
    left, right = df.where("id < 300"), df.where("id >= 300")
    assert tuple(merge_tags(table_tag(left).unionByName(table_tag(right))).first()) == tag(df)


def test_an_unchanged_snapshot_is_not_written_again(spark, tmp_path):
    df = spark.range(50).withColumn("votes", F.col("id") * 3)
    folder, written = land_tagged(df, str(tmp_path / "t"))
    assert written and spark.read.parquet(folder).count() == 50
    assert land_tagged(df.repartition(5).orderBy(F.desc("id")), str(tmp_path / "t")) == (folder, False)
    (tmp_path / "t" / folder.rpartition("/")[2] / "_SUCCESS").unlink()  # as an interrupted job leaves it
    assert land_tagged(df, str(tmp_path / "t")) == (folder, True) and spark.read.parquet(folder).count() == 50
    other, written = land_tagged(df.withColumn("votes", F.col("votes") + 1), str(tmp_path / "t"))
    assert written and other != folder
