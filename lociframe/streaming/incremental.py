"""Structured Streaming: an index and UMI families that grow by batches.

Records have no event time, so there is no watermark: state ends with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import kmers

FAMILY = "sample_id string, umi_a string, umi_b string, fwd_reads long, rev_reads long, first_ord long"


class IncrementalIndex:
    """A k-mer index as Parquet parts, one per batch; counts and error sums add up when it is read.

    A batch replaces its own part, so one that is run again counts once.
    ``compact`` merges parts. K-mers are kept as their codes.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = 31, keys: list[str] | None = None):
        self.spark, self.path, self.k, self.keys = spark, path, k, keys if keys is not None else ["sample_id"]

    def add(self, reads: DataFrame, batch: int) -> None:
        part = kmers.index_of(reads, self.k, self.keys, coded=True)
        part.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        return kmers.spelled(self._merged(), self.k)

    def _merged(self) -> DataFrame:
        return kmers.merge(self.spark.read.parquet(self.path).drop("batch"), keys=self.keys)

    def compact(self, path: str) -> None:
        self._merged().write.mode("overwrite").parquet(f"{path}/batch=0")


def stream_families(stream: DataFrame) -> DataFrame:
    """Running strand counts of UMI families (umi_a, umi_b, strand, read_ord, and sample_id, else null), as updates.

    State is kept per family in Spark's state store, so a batch reads and
    writes those of its own reads only.
    """
    sample = F.col("sample_id") if "sample_id" in stream.columns else F.lit(None).cast("string").alias("sample_id")
    rows = stream.select(sample, "umi_a", "umi_b", "strand", F.col("read_ord").cast("long").alias("read_ord"))
    of = lambda s: F.count_if(s)
    return rows.groupBy("sample_id", "umi_a", "umi_b").agg(
        of(F.col("strand") == "Forward").alias("fwd_reads"), of(F.col("strand") != "Forward").alias("rev_reads"), F.min("read_ord").alias("first_ord")
    )


class RunningFamilies:
    """Families that grow with a stream: each batch writes those that it changed, the last one of a family counts.

    Started again from its checkpoint, a stream goes on where it ended; a batch
    that is run again replaces its own part.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def start(self, stream: DataFrame, checkpoint: str):
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        return stream_families(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        parts = self.spark.read.schema(FAMILY + ", batch long").parquet(self.path)
        names = [f.split()[0] for f in FAMILY.split(", ")]
        last = parts.groupBy(*names[:3]).agg(F.max_by(F.struct(*names[3:]), "batch").alias("last"))
        families = last.select(*names[:3], "last.*")
        return families.withColumn("family_type", S.family_type(F.col("fwd_reads"), F.col("rev_reads")))
