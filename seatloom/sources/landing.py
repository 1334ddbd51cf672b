"""Landing folders: documents as files, remote sources fetched into them, small tables written once, the published bundle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists

_own_dir: str | None = None
_written: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, or in one of our own where a local session leaves that unset."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir = _own_dir or tempfile.mkdtemp(prefix="seatloom-")
    path = f"{base.rstrip('/')}/seatloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_work(spark: SparkSession) -> None:
    """Delete what this process has written below work_path(). Call it once no lazy result reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def once(df: DataFrame, name: str) -> DataFrame:
    """df computed now, written, and read from there: for the few rows that a plan joins with itself."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land(documents: DataFrame, path: str) -> str:
    """Write JSON documents (value) as files below path, one a file: of one source, or with a column election in a folder for each."""
    if "election" in documents.columns:
        documents.repartition("election").write.mode("overwrite").partitionBy("election").text(path)
    else:
        documents.coalesce(1).write.mode("overwrite").text(path)
    return path


def ingest(spark: SparkSession, fetch: Callable[[str], str | None], sources: Mapping[str, str], path: str) -> dict[str, str]:
    """Fetch remote documents into folders below path: {source: folder} of those that came.

    fetch(name) gives a text or None, or raises OSError. One request for "all", which answers a JSON map of
    the sources, comes first; only where it gives nothing a request for each. sources: name and the
    schema that its document must have at least one field of.
    """

    def ask(name: str) -> str | None:
        try:
            return fetch(name)
        except OSError:
            return None

    rows = spark.createDataFrame([("all", ask("all"))], "name string, value string")
    whole = rows.select(F.from_json("value", "map<string, string>").alias("m")).first().m or {}
    found = {name: whole.get(name) for name in sources} if whole else {name: ask(name) for name in sources}
    usable = {}
    for name, text in found.items():
        document = spark.createDataFrame([(text,)], "value string")
        fields = document.select(F.from_json("value", sources[name]).alias("d")).where("d is not null").select("d.*")
        if text is not None and fields.where(" or ".join(f"`{c}` is not null" for c in fields.columns)).count():
            usable[name] = land(document, f"{path}/{name}")
    return usable


def publish(rows: DataFrame, path: str, version: int) -> None:
    """Make rows the version of a shared table. Writing a version again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version:020d}")


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version, with its number: what every reader of the table sees, whoever wrote it."""
    rows = spark.read.schema(f"{schema}, version bigint").parquet(path)
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0])


#: Tags are sums modulo this.
TAG = 1 << 60


def table_tag(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, a, b): a fingerprint of the multiset of rows of each group of keys, or of the whole table without keys.

    n counts rows; a and b are sums, modulo 2^60, of the first and second 15 hexadecimal digits of the
    MD5 of each row's JSON text, its columns by name. So the order of rows and columns and the
    partitioning don't matter, repeated rows do, and tags add up (merge_tags). Sums are partial before
    the shuffle: a group of any size costs a row a task. Entries of maps count in their order. An empty
    table without keys has the tag 0, 0, 0. Keys take part in the text like other columns.
    """
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))))
    digest = F.md5(F.coalesce(text, F.lit("")))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)")
    each = rows.select(*keys, F.lit(1).cast("bigint").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return merge_tags(each, *keys)


def merge_tags(tags: DataFrame, *keys: str) -> DataFrame:
    """The tags of unions of tables from their own: (keys, n, a, b)."""
    total = lambda c: F.pmod(F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(TAG).cast("decimal(38,0)")).cast("bigint").alias(c)
    return tags.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), total("a"), total("b"))


def land_tagged(rows: DataFrame, path: str) -> tuple[str, bool]:
    """Write rows as Parquet into a folder below path that is named by their tag, unless it is there: (folder, whether it was written).

    A folder counts once its job has committed, and isn't written again after that, so readers never
    see half of one. What an interrupted job has left is replaced. rows are computed twice: for the tag, then to be written.
    """
    tag = table_tag(rows).first()
    folder = f"{path}/{tag.n}-{tag.a:015x}-{tag.b:015x}"
    if exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        return folder, False
    rows.write.mode("overwrite").parquet(folder)
    return folder, True
