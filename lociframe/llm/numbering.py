"""Places in a global order, without a window over all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise


def numbered(df: DataFrame, group: str, order: list[str], weight: Column | None = None, tag: str = "numbered") -> DataFrame:
    """``df`` with ``place``, the weight (1 by default) of the rows before it in its group, and ``total``, its group's.

    Rows are sorted by ranges, so a group may lie in any number of tasks; each
    sums its own rows, and only one number per task and group meets others. The
    group must not be null; nulls in ``order`` come first. The rows are written.
    """
    rows = df.withColumn("__weight", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    schema = StructType([*rows.schema.fields, StructField("__part", LongType()), StructField("__before", LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, w = b.column(names.index(group)), b.column(names.index("__weight")).to_numpy()
            new = np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1
            done = np.cumsum(w) - w
            base = np.zeros(len(w), np.int64)
            base[new] = np.diff(np.concatenate(([0], done[new])))
            before = done - np.cumsum(base)
            if last is not None and g[0].as_py() == last:
                before[: new[0] if len(new) else len(w)] += carry
            last, carry = g[-1].as_py(), int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), part, np.int64)), pa.array(before)], [*names, "__part", "__before"])

    names = rows.columns
    rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema)
    rows = materialise(rows, tag)
    sums = rows.groupBy(group, "__part").agg(F.sum("__weight").alias("__sum"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"), F.sum("__sum").over(whole).alias("total"))
    # Written, so that Spark knows its size before it chooses a join.
    rows = rows.join(materialise(sums, "offsets"), [group, "__part"])
    return rows.select(*df.columns, (F.col("__offset") + F.col("__before")).alias("place"), "total")
