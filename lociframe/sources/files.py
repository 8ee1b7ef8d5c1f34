"""Scans: paired FASTQ, FASTA, VCF, call tables, BED, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import sequence as S
from .shared import written

READS = "sample_id string, read_ord bigint, r1_seq string, r1_qual string, r2_seq string, r2_qual string"


#: Bits of ``read_ord`` for the place in a pair of files; above them is the number of the pair within its sample.
LANE_BITS = 40
#: Bits of a row's number within its task.
_PLACE = 33


def _file_uri(path: Column) -> Column:
    """A file's address in one spelling: engines write local ones with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value) of text files, plain or compressed, wherever Spark can read; ``line`` counts from 0 in each file.

    A file's splits are read by tasks of their own. Each split's lines are
    counted first, one row a split, and the counts before it are added to a
    line's place within it.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(_file_uri(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    per = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = written(per.select("file", "split", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "splits")
    return lines.join(per, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("low")).alias("line"), "value")


def read_fastq_pairs(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(sample, r1, r2) paths, plain or compressed -> reads; ``read_ord`` is the place in the files.

    Both files' lines meet by sample, pair and record in one shuffle, so a pair
    of files may be read by any number of tasks (a gzip file by one, since it
    cannot be split). Records that aren't FASTQ and files of differing lengths
    raise. A sample may have several pairs of files.
    """
    if not pairs:
        return spark.createDataFrame([], READS)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def address(path):
        p = hadoop(path)
        return p.getFileSystem(conf).makeQualified(p).toUri().toString()

    lanes: dict[str, int] = {}
    rows = []
    for sample, *paths in pairs:
        lane = lanes[sample] = lanes.get(sample, -1) + 1
        rows += [(sample, lane, side, address(p)) for side, p in enumerate(paths, 1)]
    where = spark.createDataFrame(rows, "sample_id string, lane long, side int, address string").select("sample_id", "lane", "side", _file_uri(F.col("address")).alias("file"))
    lines = numbered_lines(spark, list(dict.fromkeys(p for _, *two in pairs for p in two))).join(where, "file")
    part = lambda side, i: F.max(F.when((F.col("side") == side) & (F.col("line") % 4 == i), F.col("value")))
    names = ("head", "seq", "plus", "qual")
    records = lines.groupBy("sample_id", "lane", F.floor(F.col("line") / 4).alias("record")).agg(*(part(side, i).alias(f"{n}{side}") for side in (1, 2) for i, n in enumerate(names)))
    good = [F.col(f"head{s}").startswith("@") & F.col(f"plus{s}").startswith("+") & (F.length(f"seq{s}") == F.length(f"qual{s}")) for s in (1, 2)]
    # Blank lines at a file's end are no record.
    empty = F.concat(*(F.coalesce(f"{n}{s}", F.lit("")) for s in (1, 2) for n in names)) == ""
    bad = F.raise_error(F.concat(F.lit("not a FASTQ record in both files of a pair: "), F.coalesce(F.substring("head1", 1, 80), F.substring("head2", 1, 80), F.lit(""))))
    ok = F.coalesce(good[0] & good[1], F.lit(False))
    records = records.where(~empty).where(F.when(ok, F.lit(True)).otherwise(bad.cast("boolean")))
    place = F.shiftleft("lane", LANE_BITS) + F.col("record")
    return records.select("sample_id", place.alias("read_ord"), F.col("seq1").alias("r1_seq"), F.col("qual1").alias("r1_qual"), F.col("seq2").alias("r2_seq"), F.col("qual2").alias("r2_qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, target_id, seq): the id ends at the first space; sequences are upper-cased and joined."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    head = F.get(lines, F.lit(0))
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", ""))
    return rows.select(head.alias("header"), F.regexp_extract(head, r"^(\S*)", 1).alias("target_id"), seq.alias("seq"))


def read_targets(spark: SparkSession, path: str, kind: str = "panel") -> DataFrame:
    """Targets with their region and path limit."""
    fa = read_fasta(spark, path)
    region = S.target_region(F.col("target_id"), suffix=True)
    return fa.select("target_id", "seq", F.lit(kind).alias("kind"), region["chrom"].alias("chrom"), region["start"].alias("start"), region["end"].alias("end"), S.path_limit(F.col("target_id")).alias("max_path"))


def read_alternatives(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, ref, alt, alt_seq) of a FASTA whose headers have REF= and ALT=; others are left out."""
    fa = read_fasta(spark, path).withColumn("x", S.alt_header(F.col("header"))).where("x is not null")
    return fa.select("x.target_id", "x.ref", "x.alt", F.col("seq").alias("alt_seq"))


VCF_COLUMNS = "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string"


def read_vcf(spark: SparkSession, path: str, only_passing: bool = False) -> DataFrame:
    """Variants, one row per alternative allele, plain or gz."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=VCF_COLUMNS, quote="", enforceSchema=True)
    rows = rows.withColumn("alt", F.explode(F.split("alt", ",")))
    return rows.where(F.coalesce("filter", F.lit("")).isin("PASS", ".", "")) if only_passing else rows


def read_calls(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A call table by header names; columns that a file lacks are null."""
    have = spark.read.csv(path, sep=sep, header=True)
    out = []
    for f in StructType.fromDDL(schema):
        column = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have.columns else F.lit(None).cast(f.dataType)
        out.append(column.alias(f.name))
    return have.select(*out)


def run_label(path: Column) -> Column:
    """struct<ng, vaf> of a result file's name such as ``…_15ng_0p5pc….tsv``."""
    ng = F.regexp_extract(path, r"([0-9]+)ng", 1).try_cast("int")
    vaf = F.regexp_extract(path, r"_([0-9]+(?:[.p][0-9]+)?)(?:pc|%)", 1)
    return F.struct(ng.alias("ng"), S.vaf_label(vaf).alias("vaf"))


def read_result_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema).withColumn("__file", F.col("_metadata.file_path"))
    return rows.withColumn("__l", run_label(F.col("__file"))).select("*", "__l.ng", "__l.vaf").drop("__l", "__file")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start bigint, end bigint, name string", enforceSchema=True)


# --- stage tables


def write_stage(df: DataFrame, path: str, stage: str, **properties) -> None:
    """A stage's Parquet table with what it is, and k and the like, in every column's metadata."""
    meta = {"stage": stage, "version": 1, **properties}
    df.select(*(F.col(f"`{c}`").alias(c, metadata=meta) for c in df.columns)).write.mode("overwrite").parquet(path)


def stage_header(spark: SparkSession, path: str) -> dict:
    """What a stage table says of itself; read from a footer."""
    meta = spark.read.parquet(path).schema[0].metadata
    if "stage" not in meta:
        raise ValueError(f"{path} is no stage table")
    return meta


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    found = stage_header(spark, path)["stage"]
    if found != stage:
        raise ValueError(f"{path} holds {found}, not {stage}")
    return spark.read.parquet(path)
