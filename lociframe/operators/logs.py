"""Decision logs: why reads, families, k-mers, anchors and calls went the way they did. Each is a frame, worked out only if asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles, stats
from . import reads as R

reads_dropped = R.dropped


def umi_merges(clusters: DataFrame) -> DataFrame:
    """UMI pairs that went into another one's cluster, with the seed they joined."""
    merged = (F.col("umi_a") != F.col("seed_a")) | (F.col("umi_b") != F.col("seed_b"))
    return clusters.where(merged).select("sample_id", "umi_a", "umi_b", "n", "seed_a", "seed_b")


def family_log(families: DataFrame) -> DataFrame:
    """Size, strands, type and part of each family, and the chance of a UMI collision in its sample."""
    of_sample = families.groupBy("sample_id").agg(F.count("*").alias("__m"))
    return families.join(of_sample, "sample_id").select(
        "sample_id", "molecule_id", "seed_a", "seed_b", "part", (F.col("fwd_reads") + F.col("rev_reads")).alias("size"), "fwd_reads", "rev_reads", "family_type",
        stats.collision_probability(F.col("__m")).alias("collision_probability"),
    )


def consensus_conflicts(molecules: DataFrame, limit: float = 0.1) -> DataFrame:
    """Places where a strand's consensus base has an error above ``limit``: its reads disagree, or all are masked (N)."""

    def side(strand: str, column: str) -> DataFrame:
        at = F.explode(F.filter(F.transform(f"{column}.err", lambda e, i: F.struct(i.alias("pos"), e.alias("err"))), lambda p: p.err > limit)).alias("p")
        rows = molecules.select("sample_id", "molecule_id", F.lit(strand).alias("strand"), F.col(f"{column}.seq").alias("seq"), at)
        return rows.select("sample_id", "molecule_id", "strand", "p.pos", F.substring(F.col("seq"), F.col("p.pos") + 1, F.lit(1)).alias("base"), "p.err")

    return side("Forward", "consensus_fwd").unionByName(side("Reverse", "consensus_rev"))


def kmers_skipped(consensus: DataFrame, k: int = 31) -> DataFrame:
    """Consensus reads without a single k-mer, being too short or having an N in every window."""
    too_short = F.length("seq") < k
    return consensus.where(too_short | ~F.col("seq").rlike(f"[ACGTacgt]{{{k}}}")).select(
        "sample_id", "molecule_id", F.length("seq").alias("length"), F.when(too_short, "shorter than k").otherwise("no window without N").alias("reason")
    )


def anchors_flagged(anchors: DataFrame) -> DataFrame:
    return anchors.where("warning is not null")


def variants_filtered(calls: DataFrame, config: alleles.CallConfig = alleles.CallConfig()) -> DataFrame:
    """Calls that failed a filter, with the statistic and the threshold that decided it."""
    why: Column = alleles.why_filtered(
        F.col("filter"), F.col("confidence"), F.col("strand_bias_p"), F.col("n_molecules_alt"), F.col("n_duplex_alt"), F.col("vaf"), F.col("variant_type"), config
    )
    keys = [c for c in ("sample_id", "target_id", "call_id") if c in calls.columns]
    return calls.where("filter is not null and filter <> 'Pass'").select(*keys, "variant_type", "filter", why.alias("reason"))


def full_trace(**logs: DataFrame) -> DataFrame:
    """All of the given logs as (log, record), a record being one JSON object."""
    out = None
    for name, df in logs.items():
        rows = df.select(F.lit(name).alias("log"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(**logs: DataFrame) -> DataFrame:
    """Rows of each log."""
    return full_trace(**logs).groupBy("log").agg(F.count("*").alias("n"))


def write_logs(folder: str, **logs: DataFrame) -> None:
    """``folder/summary`` and a TSV for each log, or JSON lines for ``full_trace``."""
    for name, df in logs.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True, quote="")
    summary(**logs).write.mode("overwrite").json(f"{folder}/summary")
    full_trace(**logs).select("record").write.mode("overwrite").text(f"{folder}/full_trace")
