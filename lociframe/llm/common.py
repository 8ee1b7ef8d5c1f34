"""What the operators of this folder share: tables, the shared folder, words."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Spark's setting for deleting a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: driver
    and executors are one process there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"/tmp/checkpoints/lociframe-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lociframe/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The folder goes when the driver ends; ``released`` frees it earlier. Shuffle
    files of the write go as soon as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociframe_path = path
    return out


def released(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for a frame that no later plan reads."""
    if df is not None and getattr(df, "_lociframe_path", None):
        remove(df.sparkSession, df._lociframe_path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
                remove(spark, path)
        except Exception:  # the JVM may have ended first; the shared folder's owner cleans up then
            return


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """What tells texts apart in joins; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame doesn't have yet, whatever columns callers bring."""
    taken = {c.lower() for c in df.columns}
    name = f"__lf_{wish}"
    while name.lower() in taken:
        name += "_"
    return name


def stand_ins(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component in ``found`` (doc_id, t, component_id), row by row.

    That is one row with the component's id, any of them if they differ only
    in further columns. Of components without any id, all rows stay. A row of
    the same id in another component is judged by its own one.
    """
    found = materialise(found.groupBy("doc_id", "t", "component_id").agg(F.count("*").alias("n")), "near")
    own = found.where("doc_id = component_id")
    least = own.groupBy("component_id").agg(F.min("t").alias("least")).withColumnRenamed("component_id", "c")
    own = own.join(least, F.col("component_id") == F.col("c")).select("doc_id", "t", (F.col("t") != F.col("least")).alias("gone"), (F.col("n") > 1).alias("twice"))
    # The others of a component, which may be a third of all rows, meet in no join.
    others = found.where("component_id is not null and (doc_id is null or doc_id <> component_id)")
    judged = materialise(own.where("gone or twice").union(others.select("doc_id", "t", F.lit(True), F.lit(False))), "judged")
    names = {c: free_name(docs, c) for c in ("id", "t", "u", "gone", "twice")}
    judged = judged.select(*(F.col(c).alias(names[n]) for c, n in (("doc_id", "id"), ("t", "u"), ("gone", "gone"), ("twice", "twice"))))
    keyed = docs.withColumn(names["t"], text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["id"])) & (F.col(names["t"]) == F.col(names["u"]))
    # Merged at every size: what is judged grows with the documents.
    both = keyed.join(judged.hint("merge"), same, "left")
    kept = both.where(F.col(names["gone"]).isNull()).select(*docs.columns)
    if judged.where(F.col(names["twice"]) & ~F.col(names["gone"])).isEmpty():
        return kept
    again = both.where(F.col(names["twice"]) & ~F.col(names["gone"])).dropDuplicates([names["id"], names["u"]])
    return kept.unionByName(again.select(*docs.columns))
