"""Helpers that several operators share: durable intermediate tables, id remainders, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a Python worker turns into Python objects at once.
SLICE_ROWS = 512
#: Bytes of Arrow data that a Python worker turns into Python objects at once.
SLICE_BYTES = 8 << 20

#: A group of more than one in so many rows is joined without a shuffle of its rows.
CROWDED = 1000

_own_dir: str | None = None
_written: list[str] = []
#: What tasks in this process keep for those after them, by their module and a name.
_kept: dict[tuple[str, str], Any] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, one of our own, but in a local session only: executors elsewhere couldn't read it."""
    global _own_dir
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="seatloom-")
    return _own_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below work_dir()."""
    path = f"{work_dir(spark)}/seatloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def work_mark() -> int:
    """A point in the sequence of written tables, for remove_work()."""
    return len(_written)


def remove_work(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables that this process has written since work_mark(), but for the one that keep reads.

    Call it once no lazy result reads them any more.
    """
    files = keep.inputFiles() if keep is not None else []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _written[since:]:
        if not any(name.rpartition("/")[2] in x for x in files):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
            _written.remove(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a DataFrame that reads it.

    This cuts lineage without a second computation (checkpoint() computes a plan twice), and what
    is written outlives any executor.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_crowded(rows: DataFrame, groups: DataFrame, on: list[tuple[str, str]], size: str, total: int) -> DataFrame:
    """Inner join of rows with groups, one row a group of size rows of total: (rows' column, groups' column) in on.

    Groups of over total / CROWDED rows, of which there are fewer than CROWDED, are broadcast, and their
    rows stay where they are. The rows of the others are dealt out, so no task gets a large share of
    them all.
    """
    crowded = materialize(groups.where(F.col(size) * CROWDED > total), "crowded")
    rest = groups.where(F.col(size) * CROWDED <= total)
    same = lambda table: reduce(lambda a, b: a & b, (F.col(x) == table[y] for x, y in on))
    here = rows.join(F.broadcast(crowded), same(crowded))
    there = rows.join(F.broadcast(crowded), same(crowded), "left_anti")
    return here.unionByName(there.join(rest, same(rest)))


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that neither many rows nor a few very long texts are held as objects at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(SLICE_ROWS, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Return memory that this process has freed to the system. Python workers live on between tasks, and what they keep is an executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def keep(owner: str, name: str, make: Callable[[], Any]) -> Any:
    """make(), kept in this process for further tasks of a module, its owner. What tasks of other modules keep goes first."""
    forget(owner)
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]


def forget(owner: str) -> None:
    """Drop what tasks of modules other than owner keep in this process: a worker that has packed would hold its tokenizer through every stage after."""
    for key in [k for k in _kept if k[0] != owner]:
        del _kept[key]


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows in the driver, which the JVM holds. One made of a Python list is computed by further Python workers on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow), struct)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow over bounded slices. make() runs once per task and returns the function of a slice."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow, owner = to_arrow_schema(struct), make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = out = None
        forget(owner)
        for part in slices(batches):
            f = f or make()
            out = f(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name].cast(x.type) for x in arrow], schema=arrow)
        f = out = None
        give_back()

    return df.mapInArrow(run, struct)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(df: DataFrame, name: str, alias: str, kind: str) -> Column:
    """df's own column under a fixed inner name and type; extra columns with clashing names stay outside."""
    return df[name].cast(kind).alias(alias)
