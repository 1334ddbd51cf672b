"""Orders of tables. Each ends in the input position, so that ties are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, natural_key, strip_separators
from ..sources.landing import once
from .allocate import per


def order_keys(column: Column | str, ascending: bool, kind: str = "text", total: str | None = None, pos: str = "pos") -> list[Column]:
    """Sort keys of one column, total rows last whatever the direction.

    kind: number (nulls last), shown (a number as it is shown, with separators; what isn't one is 0),
    text (natural order), plain (texts by their characters).
    """
    if kind == "number":
        keys = [col(column).try_cast("double")]
    elif kind == "shown":
        keys = [F.coalesce(strip_separators(col(column).cast("string")), F.lit(0))]
    else:
        keys = natural_key(F.coalesce(col(column).cast("string"), F.lit(""))) if kind == "text" else [col(column)]
    turn = [k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys]
    return [*([F.col(total)] if total else []), *turn, F.col(pos)]


def table_order(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows sorted by order_keys()."""
    return rows.orderBy(*keys)


def place(rows: DataFrame, by: list[str], *keys: Column, name: str = "place") -> DataFrame:
    """An explicit rank column, for results whose order must survive. Without by the whole table is ranked, by numbered()."""
    if not by:
        return numbered(rows, *keys, name=name)
    return rows.withColumn(name, F.row_number().over(per(by).orderBy(*keys)).cast("bigint"))


def numbered(rows: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """Rows with their places in the order of keys, from 1, without gathering them in one task.

    Rows are sorted over ranges of the keys and written once, each with its part and its place there. A
    part's offset is the number of rows in the parts before; those are as few as partitions, and only
    their counts come to the driver. Rows with equal keys lie in one part, in any order.
    """
    spot = f"_{name}_at"
    sorted_rows = once(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(spot, F.monotonically_increasing_id()), "sorted")
    # monotonically_increasing_id has the partition above 33 bits of the row's place in it.
    part, local = F.shiftright(spot, 33), F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))
    offsets, before = [], 0
    for row in sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((row.part, before))
        before += row.n
    parts = rows.sparkSession.createDataFrame(offsets, f"{spot}_part long, {spot}_before long")
    joined = sorted_rows.join(F.broadcast(parts), part == F.col(f"{spot}_part"))
    return joined.withColumn(name, F.col(f"{spot}_before") + local + 1).drop(spot, f"{spot}_part", f"{spot}_before")


def toggled(state: str | None, default: str = "asc") -> str:
    """The direction after a click on a column: its default at first, then the other one."""
    return default if state is None else "desc" if state == "asc" else "asc"
