"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Within a source, documents lie in the order of a hash of their id. That order
is cut into ranges of the hash, in proportion to the source's rows; sums over
ranges and then within each range give every document the number of words
before it, so no task sees a whole source. A source's budget takes whole
epochs, then the documents before the cut, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, n_words, table

#: Fixed values of the query: weights in turn, and epochs at most.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Rows in a range, and ranges in a source at most (the sums over them are one task's work).
RANGE_ROWS, RANGES = 64, 1 << 16
#: Sources up to which their few figures are sent to every task.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"
UNIT = 1 << 28


def budgets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_rows, source_size, target) of (source, size) rows.

    Sources in the order of code points, null last, have the weights in turn
    and share the total; a target stops at ``epochs`` times its source, and
    the rest is shared anew. That ends where all sources below a common level
    (cap over weight) are at their caps.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    sums = sums.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    sums = sums.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    capped = F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")
    sums = sums.withColumn("full", F.max(F.when(~capped, 1).otherwise(0)).over(level.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    free = F.max(F.when(~F.col("full"), F.col("left"))).over(every), F.max(F.when(~F.col("full"), F.col("w_left"))).over(every)
    share = free[0].cast("double") * F.col("w").cast("double") / free[1].cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return sums.select("source", "source_rows", "source_size", target.alias("target"))


def _key(seed: str):
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary"))


def _known(sums: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(sums) if few else sums


def _placed(sized: DataFrame, weights, epochs: int, seed: str) -> tuple[DataFrame, bool]:
    """``sized`` rows with their source's figures and the words before them; and whether there are few sources."""
    sized = materialise(sized.select("doc_id", "source", "size", _key(seed).alias("key")), "sizes")
    sums = materialise(budgets(sized, weights, epochs), "budgets")
    few = sums.count() <= BROADCAST_SOURCES
    ranges = F.greatest(F.lit(1), F.least(F.lit(RANGES), F.ceil(F.col("source_rows") / RANGE_ROWS))).cast("long")
    sums = sums.withColumn("budget", F.round("target").cast("long")).withColumn("ranges", ranges).withColumnRenamed("source", "s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    sums = sums.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    docs = sized.join(_known(sums, few), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("ranges")
    docs = docs.withColumn("range", F.floor(at / F.lit(UNIT)).cast("long"))
    part = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "range")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = docs.groupBy("source", "range").agg(F.sum("size").alias("n"))
    whole = whole.select(part.alias("part"), "source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    same = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("range") == F.col("r"))
    docs = docs.withColumn("part", part).join(whole.toDF("part", "s", "r", "earlier"), "part").where(same)
    within = Window.partitionBy("part", "source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("before", F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0))), few


def mix(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size) rows -> (doc_id, size, source_size, target, taken), one for each row.

    ``size`` is not null. A null source is a source of its own. Rows that are
    equal in id and source stand next to each other in the order, and if they
    are equal in size as well, which of them is cut is of no consequence.
    An empty table gives no rows.
    """
    docs, _ = _placed(sized, weights, epochs, seed)
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return docs.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (``doc_id``, ``source``, ``text`` among them).

    A document comes once for each epoch that takes all of it, and once more,
    cut after the words taken, for the epoch that takes a part. ``n_chars``
    (where it is a column) is set anew for cut texts. All that documents need
    is their source's cut, the first document that the last epoch doesn't take
    whole, so texts stay where they lie. Rows equal to the cut one in id,
    source and size share its words evenly. Documents of sources without any
    word are not taken.
    """
    names = {n: free_name(docs, n) for n in ("size", "s", "passes", "cut", "over", "rows", "copy", "words")}
    col = lambda n: F.col(names[n])
    placed, few = _placed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), weights, epochs, seed)
    order = F.struct("key", "doc_id", "size")
    missed = F.when(F.col("before") + F.col("size") > F.col("rest"), F.struct(order.alias("cut"), (F.col("rest") - F.col("before")).alias("over")))
    cuts = placed.groupBy("source").agg(F.first("passes").alias("passes"), F.min(missed).alias("x"))
    cuts = materialise(cuts.select("source", "passes", "x.cut", "x.over"), "cuts")
    s = _known(cuts.toDF("s", "passes", "cut", "over"), few)
    ties = placed.select("source", order.alias("o")).join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("o") == F.col("cut")))
    ties = ties.groupBy("source").agg(F.count("*").alias("rows"))
    cuts = materialise(s.join(ties, F.col("s").eqNullSafe(F.col("source")), "left").select("s", "passes", "cut", "over", "rows"), "cuts")
    cuts = _known(cuts.toDF(*(names[n] for n in ("s", "passes", "cut", "over", "rows"))), few)
    out = docs.withColumn(names["size"], n_words(F.col("text"))).join(cuts, F.col("source").eqNullSafe(col("s")))
    own = F.struct(_key(seed).alias("key"), F.col("doc_id"), col("size").alias("size"))
    whole = col("passes") + F.when(col("cut").isNull() | (own < col("cut")), 1).otherwise(0)
    words = F.when(own == col("cut"), F.floor(F.greatest(col("over"), F.lit(0)) / col("rows"))).otherwise(0).cast("long")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(words > 0, F.array(words)).otherwise(F.array().cast("array<long>")))
    out = out.withColumn(names["copy"], F.explode(copies))
    first = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), col("copy").cast("string"), F.lit("}+"))
    out = out.withColumn("text", F.when(col("copy") >= 0, F.call_function("regexp_extract", F.col("text"), first, F.lit(0))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(col("copy") >= 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), 'mix-1')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM sums),
level AS (
  SELECT min(cap / w) AS l, arg_min(rest, cap / w) AS rest, arg_min(w_rest, cap / w) AS w_rest
  FROM levels WHERE cap * w_rest > rest * w),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.l IS NULL OR s.cap / s.w < l.l THEN CAST(s.cap AS DOUBLE)
              ELSE CAST(l.rest AS DOUBLE) * CAST(s.w AS DOUBLE) / CAST(l.w_rest AS DOUBLE) END AS target
  FROM sums s CROSS JOIN level l),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM placed
"""
