"""The record explorer: a filter language, and views over a DataFrame's active rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import sequence as S
from ..functions.alleles import why_filtered

_TEST = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(==|!=|>=|<=|>|<|contains)\s*(.+?)\s*$")


class FilterError(ValueError):
    pass


def parse_filter(text: str, df: DataFrame) -> Column:
    """A Column of an expression like ``vaf >= 0.01 AND filter == Pass OR target_id contains chr1``.

    AND binds before OR, there are no parentheses, values are unquoted. Only
    the frame's own columns can be named, and values never become SQL.
    """
    either = None
    for group in re.split(r"\s+OR\s+", text.strip()):
        both = None
        for part in re.split(r"\s+AND\s+", group):
            test = _test(part, df)
            both = test if both is None else both & test
        either = both if either is None else either | both
    return either


def _test(text: str, df: DataFrame) -> Column:
    m = _TEST.match(text)
    if not m:
        raise FilterError(f"cannot read {text.strip()!r}")
    name, op, value = m.groups()
    if name not in df.columns:
        raise FilterError(f"no column {name!r}")
    column = df[name]
    if op == "contains":
        return F.contains(column.cast("string"), F.lit(value))
    if isinstance(df.schema[name].dataType, NumericType):
        try:
            right = F.lit(float(value))
        except ValueError:
            raise FilterError(f"{name} is a number, {value!r} is not") from None
        column = column.cast("double")
    else:
        right, column = F.lit(value), column.cast("string")
    return {"==": column == right, "!=": column != right, ">": column > right, ">=": column >= right, "<": column < right, "<=": column <= right}[op]


class Explorer:
    """Commands over records; ``filter`` sets the active rows that the others see."""

    def __init__(self, records: DataFrame, id_column: str = "target_id"):
        self.records, self.id_column, self.condition = records, id_column, None

    @property
    def active(self) -> DataFrame:
        return self.records if self.condition is None else self.records.where(self.condition)

    def filter(self, text: str) -> DataFrame:
        self.condition = None if text.strip() == "clear" else parse_filter(text, self.records)
        return self.active

    def fields(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.records.schema]

    def head(self, n: int = 10) -> DataFrame:
        return self.active.orderBy(self.id_column).limit(n)

    def tail(self, n: int = 10) -> DataFrame:
        return self.active.orderBy(F.desc(self.id_column)).limit(n)

    def top(self, n: int, field: str) -> DataFrame:
        return self.active.orderBy(F.desc(field), self.id_column).limit(n)

    def show(self, key) -> DataFrame:
        return self.active.where(F.col(self.id_column) == F.lit(key))

    def search(self, field: str, value: str) -> DataFrame:
        return self.active.where(F.contains(F.col(field).cast("string"), F.lit(value)))

    def lookup(self, kmer: str) -> DataFrame:
        return self.records.where(F.col("kmer") == S.canonical(F.lit(kmer)))

    def summary(self, by: str, value: str) -> DataFrame:
        """Rows and share of each class with a value's mean and median."""
        n = self.active.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))
        return n.crossJoin(self.active.agg(F.count("*").alias("total"))).withColumn("share", F.col("n") / F.col("total"))  # one row

    def stats(self, field: str) -> DataFrame:
        p = lambda q: F.percentile(field, F.lit(q))
        return self.active.agg(
            F.count(field).alias("count"), F.avg(field).alias("mean"), p(0.5).alias("median"), F.stddev(field).alias("std"),
            F.min(field).alias("min"), F.max(field).alias("max"), p(0.05).alias("p5"), p(0.95).alias("p95"),
        )

    def histogram(self, field: str, bins: int = 5) -> DataFrame:
        """Equal bins from the least to the greatest value, with their share."""
        edge = self.active.agg(F.min(field).cast("double").alias("lo"), F.max(field).cast("double").alias("hi"), F.count(field).alias("total"))
        rows = self.active.where(F.col(field).isNotNull()).crossJoin(F.broadcast(edge))  # one row
        width = (F.col("hi") - F.col("lo")) / bins
        at = F.when(width <= 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(field) - F.col("lo")) / width))).cast("int")
        out = rows.groupBy(at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
        width = (F.col("hi") - F.col("lo")) / bins
        return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n", (100 * F.col("n") / F.col("total")).alias("percent"))

    def why(self) -> DataFrame:
        return self.active.withColumn("why", why_filtered(*(F.col(c) for c in ("filter", "confidence", "strand_bias_p", "n_molecules_alt", "n_duplex_alt", "vaf"))))

    def export(self, path: str, form: str = "tsv") -> None:
        from ..sources.writers import write_table

        write_table(self.active, path, form)
