"""Sinks: call tables, VCF, structural and breakend records, QC, annotated FASTQ."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.stats import collision_probability
from .shared import written

#: Columns of a call table in their order, and forms of output.
CALL_COLUMNS = (
    "target_id", "variant_type", "ref_seq", "alt_seq", "vaf", "vaf_ci_low", "vaf_ci_high", "n_molecules_ref", "n_molecules_alt",
    "n_duplex_alt", "n_simplex_alt", "strand_bias_p", "confidence", "filter",
)
FORMATS = {"tsv": ".tsv", "csv": ".csv", "json": ".json", "vcf": ".vcf"}
VCF_HEAD = ["##fileformat=VCFv4.3", "##source=lociframe"] + [
    f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">'
    for i, n, t, d in (
        ("VAF", 1, "Float", "Share of molecules"), ("VAF_LO", 1, "Float", "Lower end of its interval"), ("VAF_HI", 1, "Float", "Upper end of its interval"), ("NREF", 1, "Integer", "Reference molecules"),
        ("NALT", 1, "Integer", "Alternative molecules"), ("NDUPALT", 1, "Integer", "Alternative duplexes"), ("NSIMALT", 1, "Integer", "Alternative simplexes"), ("SBP", 1, "Float", "Strand bias p"),
        ("CONF", 1, "Float", "Confidence"), ("SVTYPE", 1, "String", "Type"), ("SVLEN", 1, "Integer", "Length"), ("MATEID", 1, "String", "Mate"), ("EVENT", 1, "String", "Event"), ("NOVEL", 1, "Integer", "1 for a novel insertion"),
    )
] + [
    f'##FILTER=<ID={i},Description="{d}">'
    for i, d in (
        ("PASS", "Passed every filter"), ("StrandBias", "Strands disagree"), ("LowConfidence", "Too few molecules or too low a confidence"), ("LowDuplex", "Too few duplexes"),
        ("CollisionRisk", "UMIs may collide"), ("HighVaf", "Share above the largest allowed"), ("NotTargeted", "Not on the list of variants"),
    )
] + ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
SYMBOLS = {"LargeDeletion": "DEL", "TandemDuplication": "DUP", "Inversion": "INV", "NovelInsertion": "INS", "InvDel": "INVDEL"}


def parse_formats(text: str | None) -> list[str]:
    """Output forms of a comma list; tsv without one."""
    out = [f.strip().lower() for f in (text or "tsv").split(",") if f.strip()]
    for f in out:
        if f not in FORMATS:
            raise ValueError(f"unknown output format {f!r}")
    return out or ["tsv"]


def output_paths(path: str, formats: list[str]) -> dict[str, str]:
    """One form: the path as given; several: its stem with each form's ending."""
    return {formats[0]: path} if len(formats) == 1 else {f: os.path.splitext(path)[0] + FORMATS[f] for f in formats}


#: Columns of a call table that have six places.
SIX_PLACES = ("vaf", "vaf_ci_low", "vaf_ci_high", "strand_bias_p", "confidence")


def call_table(calls: DataFrame) -> DataFrame:
    """The fixed columns, then scores and rescue figures; a passed filter reads PASS."""
    extra = [c for c in calls.columns if c.startswith(("ml_", "rescue_")) or c == "call_source"]
    label = F.when(F.col("filter") == "Pass", "PASS").otherwise(F.col("filter")).alias("filter")
    return calls.select(*(label if c == "filter" else F.round(c, 6).alias(c) if c in SIX_PLACES else F.col(c) for c in CALL_COLUMNS), *extra)


def write_table(df: DataFrame, path: str, form: str = "tsv") -> None:
    """TSV and CSV with a header, their ``SIX_PLACES`` columns written so; JSON as one array, ``[`` and ``]`` without rows."""
    if form == "json":
        return write_json(df, path)
    text = lambda c, t: F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else _number(c).alias(c) if c in SIX_PLACES else F.col(c)
    flat = df.select(*(text(c, t) for c, t in df.dtypes))
    flat.write.mode("overwrite").csv(path, sep="\t" if form == "tsv" else ",", header=True, quote="" if form == "tsv" else '"')


def write_ordered(lines: DataFrame, path: str, *order: Column | str) -> None:
    """The ``value`` of ``lines`` as text, sorted by ranges: its part files, one after the other by name, are the file.

    A table that fits one partition makes one part.
    """
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array, a row a line: all but the first row begin with a comma."""
    rows = df.select(F.monotonically_increasing_id().alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("v"))
    rows = written(rows, "json")
    first = rows.agg(F.min("k")).first()[0]
    rows = rows.select(F.lit(1).alias("n"), "k", F.concat(F.when(F.col("k") > F.lit(first), ",").otherwise(""), "v").alias("value"))
    ends = df.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "n int, k long, value string")
    write_ordered(ends.unionByName(rows), path, "n", "k")


def _number(c: str) -> Column:
    return F.format_string("%.6f", F.col(c).cast("double"))


def info(calls: DataFrame) -> Column:
    """The nine figures of a call as INFO."""
    parts = [("VAF", _number("vaf")), ("VAF_LO", _number("vaf_ci_low")), ("VAF_HI", _number("vaf_ci_high")), ("NREF", F.col("n_molecules_ref")), ("NALT", F.col("n_molecules_alt")), ("NDUPALT", F.col("n_duplex_alt")), ("NSIMALT", F.col("n_simplex_alt")), ("SBP", _number("strand_bias_p")), ("CONF", _number("confidence"))]
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts))


def vcf_records(calls: DataFrame) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info of calls with an ``allele``; without one the target's id at 1.

    Structural classes become symbols with type and length: negative for
    deletions, 0 for inversions.
    """
    a = F.col("allele")
    kind = F.create_map(*(F.lit(x) for kv in SYMBOLS.items() for x in kv))[F.col("variant_type")]
    change = F.length("alt_seq") - F.length("ref_seq")
    length = F.when(kind == "INV", 0).otherwise(change)
    sv = F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN="), length.cast("string"), F.when(kind == "INS", ";NOVEL=1").otherwise(""))
    ref = F.coalesce(a["ref"], F.col("ref_seq"))
    return calls.select(
        F.coalesce(a["chrom"], F.col("target_id")).alias("chrom"), F.coalesce(a["pos"], F.lit(1)).alias("pos"), F.lit(".").alias("id"),
        F.when(kind.isNotNull(), F.substring(ref, 1, 1)).otherwise(ref).alias("ref"), F.when(kind.isNotNull(), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(F.coalesce(a["alt"], F.col("alt_seq"))).alias("alt"),
        F.lit(".").alias("qual"), F.when(F.col("filter") == "Pass", "PASS").otherwise(F.col("filter")).alias("filter"), F.concat_ws(";", info(calls), sv).alias("info"),
    )


#: How both ends of a fusion are written, by which of the partners is reversed (F or R); t is the base, p the mate's place.
BREAKENDS = {"FF": ("t[p[", "]p]t"), "FR": ("t]p]", "t]p]"), "RF": ("]p]t", "t[p["), "RR": ("[p[t", "[p[t")}


def breakend_pair(fusions: DataFrame, standard: bool = False) -> DataFrame:
    """Two mated records per fusion (event, chrom_a, pos_a, base_a, turned_a, and so for b).

    ``BREAKENDS`` says how. The VCF standard's own reading of a reversed first
    partner has RF and RR the other way round: ``standard`` writes that.
    """
    which = lambda s: F.when(F.col(f"turned_{s}"), "R").otherwise("F")
    turn = F.concat(which("a"), which("b"))
    forms = {k: BREAKENDS[{"RF": "RR", "RR": "RF"}.get(k, k) if standard else k] for k in BREAKENDS}

    def alt(me: str, other: str) -> Column:
        place = F.concat(F.col(f"chrom_{other}"), F.lit(":"), F.col(f"pos_{other}").cast("string"))
        form = F.create_map(*(F.lit(x) for k, v in forms.items() for x in (k, v[me == "b"])))[turn]
        return F.replace(F.replace(form, F.lit("t"), F.col(f"base_{me}")), F.lit("p"), place)

    def end(me: str, other: str) -> Column:
        return F.struct(
            F.col(f"chrom_{me}").alias("chrom"), F.col(f"pos_{me}").alias("pos"), F.concat("event", F.lit(f"_{me}")).alias("id"), F.col(f"base_{me}").alias("ref"), alt(me, other).alias("alt"),
            F.concat(F.lit("SVTYPE=BND;MATEID="), "event", F.lit(f"_{other};EVENT="), "event").alias("info"),
        )

    return fusions.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.*")


def _natural() -> list[Column]:
    """Chromosomes by number, then by name; then places."""
    number = F.regexp_replace("chrom", "^chr", "").try_cast("int")
    return [number.asc_nulls_last(), *(F.col(c).asc() for c in ("chrom", "pos", "ref", "alt"))]


def natural_order(records: DataFrame) -> DataFrame:
    """Chromosomes by number, then by name; then places."""
    return records.orderBy(*_natural())


def vcf_line() -> Column:
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info").alias("value")


def write_vcf(records: DataFrame, path: str) -> None:
    """Calls in natural order, sorted by ranges, after the header."""
    head = records.sparkSession.createDataFrame([(i, line) for i, line in enumerate(VCF_HEAD)], "n int, value string")
    body = records.select(F.lit(len(VCF_HEAD)).alias("n"), vcf_line(), "chrom", "pos", "ref", "alt")
    write_ordered(head.unionByName(body, allowMissingColumns=True), path, "n", *_natural())


def write_calls(calls: DataFrame, path: str, formats: str | None = None) -> dict[str, str]:
    """Calls in one form or several; returns where each went."""
    paths = output_paths(path, parse_formats(formats))
    for form, p in paths.items():
        if form == "vcf":
            write_vcf(vcf_records(calls), p)
        else:
            write_table(call_table(calls), p, form)
    return paths


#: A QC record's stage and its figures, by the names of records and of this library's counters.
QC_STAGES = {
    "assembly": ("molecule_assembly", {
        "n_input_read_pairs": "n_processed", "n_molecules": "n_molecules", "n_duplex": "n_duplex", "n_simplex_fwd": "n_simplex_fwd", "n_simplex_rev": "n_simplex_rev", "n_singletons": "n_singletons",
        "duplex_fraction": "duplex_fraction", "mean_family_size": "mean_family_size", "n_dropped_reads": "n_dropped_reads",
    }),
    "index": ("kmer_indexing", {"n_target_kmers": "n_target_kmers", "n_kmers_observed": "n_observed", "mean_molecule_depth": "mean_depth"}),
    "pathfind": ("graph_walking", {
        "n_targets_queried": "n_targets", "n_targets_with_variants": "n_with_variants", "n_anchors_non_unique": "n_non_unique_anchors", "n_targets_walk_budget_exceeded": "n_budget_hit",
    }),
    "call": ("variant_calling", {"n_variants_called": "n_calls", "n_pass": "n_pass", "n_filtered": "n_filtered"}),
}
VERSION = "0.1.0"


def qc_record(stats: DataFrame, stage: str) -> DataFrame:
    """A stage's counters (of each sample, where they have one) as its QC record: stage, version, figures (0 for none), passed."""
    name, figures = QC_STAGES[stage]
    if stage == "assembly":
        stats = stats.withColumn("n_dropped_reads", F.col("n_processed") - F.col("n_passed"))
    keys = [c for c in ("sample_id",) if c in stats.columns]
    return stats.select(*keys, F.lit(name).alias("stage"), F.lit(VERSION).alias("version"), *(F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in figures.items()), F.lit(True).alias("passed"))


def write_qc(record: DataFrame, path: str) -> None:
    """QC records as pretty JSON, one after another in one file (a record for a sample); written by a task to any file system."""
    record.coalesce(1).select(F.to_json(F.struct(*record.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


class Metrics:
    """Elapsed and CPU time of stages, and the driver's peak memory."""

    def __init__(self):
        self.stages: list[dict] = []

    def run(self, name: str, work):
        wall, cpu = time.time(), time.process_time()
        out = work()
        peak = next((int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmPeak")), 0)
        self.stages.append({"stage": name, "elapsed_s": time.time() - wall, "cpu_s": time.process_time() - cpu, "peak_kb": peak})
        return out

    def json(self) -> str:
        return json.dumps({"stages": self.stages, "total_s": sum(s["elapsed_s"] for s in self.stages)}, indent=2)

    def table(self) -> str:
        return "\n".join(f"{s['stage']:<12}{s['elapsed_s']:>10.2f}{s['cpu_s']:>10.2f}{s['peak_kb'] / 1024:>10.0f}" for s in self.stages)


#: Family types as a read's tag has them.
FAMILY_TAGS = {"Duplex": "DUPLEX", "SimplexFwd": "SIMPLEX_FWD", "SimplexRev": "SIMPLEX_REV", "Singleton": "SINGLETON"}


def annotated_fastq(molecules: DataFrame) -> DataFrame:
    """FASTQ text of consensus reads with SAM-like tags.

    DS counts the reads of families seen on both strands, 0 for others. CP is
    the chance that two of the sample's molecules share a UMI pair. SK are the
    first read's skipped bases, left out where the layout has none.
    """
    best = F.coalesce("duplex_consensus", "consensus_fwd", "consensus_rev")
    quality = F.array_join(F.transform(best["err"], lambda e: F.char(33 + F.round(S.prob_to_phred(e)).cast("int"))), "")
    mean = F.aggregate(best["err"], F.lit(0.0), lambda a, x: a + x) / F.size(best["err"])
    tag = lambda t, v: F.concat(F.lit(t), v.cast("string"))
    of_sample = molecules.groupBy("sample_id").agg(F.count("*").alias("__m"))
    molecules = molecules.join(of_sample, "sample_id")
    size, both = F.col("fwd_reads") + F.col("rev_reads"), F.col("family_type") == "Duplex"
    family = F.create_map(*(F.lit(x) for kv in FAMILY_TAGS.items() for x in kv))[F.col("family_type")]
    skip = [F.when(F.col("skip") != "", tag("SK:Z:", F.col("skip")))] if "skip" in molecules.columns else []
    tags = F.concat_ws(
        "\t", tag("MI:Z:", F.hex("molecule_id")), tag("RX:Z:", F.concat("seed_a", F.lit("-"), "seed_b")), tag("FS:i:", size), tag("DS:i:", F.when(both, size).otherwise(0)), tag("SF:i:", F.col("fwd_reads")),
        tag("SR:i:", F.col("rev_reads")), tag("FT:Z:", family), tag("CQ:f:", F.format_string("%.6f", mean)), tag("CP:f:", F.format_string("%.6f", collision_probability(F.col("__m")))), *skip,
    )
    return molecules.where(best.isNotNull()).select(F.concat_ws("\n", F.concat(F.lit("@"), F.hex("molecule_id"), F.lit("\t"), tags), best["seq"], F.lit("+"), quality).alias("value"))
