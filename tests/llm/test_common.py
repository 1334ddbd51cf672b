import gc
import os
import weakref
import zlib
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from seatloom.llm import common, packing, quality
from seatloom.llm.queries import WORD_VOCABULARY


def test_tables_go_to_the_shared_folder_and_can_be_removed(spark):
    df = common.materialize(spark.range(10), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in path and df.count() == 10
    common.remove_work(spark)
    assert not os.path.exists(path)
    common.remove_work(spark)


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (1 << 20)] * 40 + ["y"] * 2000})
    parts = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert sum(p.num_rows for p in parts) == 2040 and max(p.num_rows for p in parts) <= common.SLICE_ROWS


def test_remainder(spark):
    rows = spark.range(20).select("id", common.id_remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_crowded_groups_join_as_others_do(spark):
    rows = spark.createDataFrame([(k, k if k < 500 else 7) for k in range(5000)] + [(1, None)], "id long, g long")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).withColumnRenamed("g", "key").where("key is null or key <> 3")
    got = common.join_crowded(rows, sizes, [("g", "key")], "n", rows.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(sizes, F.col("g") == F.col("key")).collect()))
    assert got.columns == ["id", "g", "key", "n"]


def test_what_one_operator_keeps_goes_when_another_begins(spark):
    ref = weakref.ref(packing.load(WORD_VOCABULARY))
    assert packing.load(WORD_VOCABULARY) is ref()
    quality.features("a b")
    gc.collect()
    assert ref() is None
    ref = weakref.ref(packing.load(WORD_VOCABULARY))
    table = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    make = lambda: lambda part: {"n": part.column(0)}
    assert [x.num_rows for x in common.map_arrow(table, make, "n long")(iter([pa.RecordBatch.from_pydict({"n": [1, 2]})]))] == [2]
    gc.collect()
    assert ref() is None


def test_local_rows(spark):
    got = common.local_rows(spark, [(1, "a", None), (None, "b", 2)], "x long, y string, z int")
    assert [tuple(r) for r in got.collect()] == [(1, "a", None), (None, "b", 2)]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "int"]
    assert common.local_rows(spark, [], "x long, y string").collect() == []
