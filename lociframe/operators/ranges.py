"""Orders that no single task holds: ranks and neighbours by sorted ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of a row's number within its task.
_PLACE = 33


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted by ranges and written, with ``__range`` and the row's place in it, ``__at``."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = written(rows)
    return rows.select(*df.columns, F.shiftright("__id", _PLACE).alias("__range"), F.col("__id").bitwiseAND((1 << _PLACE) - 1).alias("__at"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def ranked(df: DataFrame, keys: list[str], *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's number (from 1) within its keys, in this order.

    Rows are sorted by ranges of keys and order, so keys of any size are spread;
    one count per range and key gives where its rows begin. Null keys are a key.
    """
    rows = in_ranges(df, *keys, *order)
    per = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = written(per.select(*keys, "__range", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    both = rows.join(per, _same(rows, per, [*keys, "__range"]))
    return both.select(*(rows[c] for c in df.columns), (per["__before"] + rows["__at"] - per["__low"] + 1).alias(name))


def filled(df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """``df`` with the last value that isn't null of each of ``before`` up to a row, and the first of each of ``after`` from it on.

    Within a range that is a window over the range and key; what a range ends
    and begins with is carried over the others, one row per range and key.
    Ranges are those of ``in_ranges`` over keys and order.
    """
    rows = in_ranges(df, *keys, *order)
    # Both ways from the frame's beginning: a frame that only shrinks is worked out anew for each row.
    up, down = (Window.partitionBy(*keys, "__range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0) for at in ("__at", F.desc("__at")))
    near = {n: F.last(c, ignorenulls=True).over(up) for n, c in before.items()} | {n: F.last(c, ignorenulls=True).over(down) for n, c in after.items()}
    rows = rows.withColumns({f"__{n}": c for n, c in near.items()})
    ends = [F.max_by(f"__{n}", "__at").alias(f"__{n}") for n in before] + [F.min_by(f"__{n}", "__at").alias(f"__{n}") for n in after]
    per = rows.groupBy(*keys, "__range").agg(*ends)
    past, coming = (Window.partitionBy(*keys).orderBy(r).rowsBetween(Window.unboundedPreceding, -1) for r in ("__range", F.desc("__range")))
    carried = {n: F.last(f"__{n}", ignorenulls=True).over(past) for n in before} | {n: F.last(f"__{n}", ignorenulls=True).over(coming) for n in after}
    per = written(per.select(*keys, "__range", *(c.alias(n) for n, c in carried.items())))
    both = rows.join(per, _same(rows, per, [*keys, "__range"]))
    return both.select(*(rows[c] for c in df.columns), *(F.coalesce(rows[f"__{n}"], per[n]).alias(n) for n in carried))
