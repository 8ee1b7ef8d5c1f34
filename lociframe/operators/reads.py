"""From read pairs to UMI families: parsing, grouping, clustering. ``assembly`` splits and calls families."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import ranges, umis


@dataclass(frozen=True)
class ReadStructure:
    """Bases at a read's start that are not template."""

    umi: int = 5
    skip: int = 2

    @property
    def template(self) -> int:
        return self.umi + self.skip


#: The two layouts in use.
DUPLEX, SIMPLEX = ReadStructure(5, 2), ReadStructure(12, 0)


def low_quality(quality: Column, n: int, least: int) -> Column:
    """Whether any of the first n Phred+33 qualities is below ``least``; 0 switches the test off."""
    if least <= 0:
        return F.lit(False)
    first = F.substring(quality, 1, n)
    return (first == "") | first.rlike(rf"[\x00-\x{{{32 + least:x}}}]")


def parse_reads(reads: DataFrame, layout: ReadStructure = DUPLEX, min_umi_quality: int = 20, min_template: int | None = None) -> DataFrame:
    """``reads`` with their parts, canonical UMI pair, strand, fingerprint and ``drop_reason`` (null: passed).

    The first failing test names the reason: length, template length, UMI quality.
    """
    u, t = layout.umi, layout.template
    out = reads
    for r in ("r1", "r2"):
        out = out.withColumns({
            f"umi_{r}": F.substring(f"{r}_seq", 1, u), f"skip_{r}": F.substring(f"{r}_seq", u + 1, layout.skip),
            f"template_{r}": F.substring(F.col(f"{r}_seq"), F.lit(t + 1), F.length(f"{r}_seq")), f"qual_{r}": F.substring(F.col(f"{r}_qual"), F.lit(t + 1), F.length(f"{r}_qual")),
        })
    short = F.least(F.length("r1_seq"), F.length("r2_seq")) < t
    reason = F.when(short, "ReadTooShort")
    if min_template:
        reason = reason.when(F.least(F.length("template_r1"), F.length("template_r2")) < min_template, "TemplateTooShort")
    reason = reason.when(low_quality(F.col("r1_qual"), u, min_umi_quality) | low_quality(F.col("r2_qual"), u, min_umi_quality), "LowUmiQuality")
    pair = S.umi_pair(F.col("umi_r1"), F.col("umi_r2"))
    return out.withColumns({
        "umi_a": pair["umi_a"], "umi_b": pair["umi_b"], "strand": S.umi_strand(F.col("umi_r1"), F.col("umi_r2")),
        "fingerprint": S.endpoint_fingerprint(F.col("template_r1"), F.col("template_r2")), "drop_reason": reason,
    })


def passed(parsed: DataFrame) -> DataFrame:
    return parsed.where("drop_reason is null")


def dropped(parsed: DataFrame) -> DataFrame:
    """The decision log of dropped reads."""
    return parsed.where("drop_reason is not null").select("sample_id", "read_ord", "drop_reason")


def parse_stats(parsed: DataFrame) -> DataFrame:
    of = lambda r: F.count_if(F.col("drop_reason") == r)
    return parsed.groupBy("sample_id").agg(
        F.count("*").alias("n_processed"), F.count_if(F.col("drop_reason").isNull()).alias("n_passed"), of("ReadTooShort").alias("n_too_short"),
        of("TemplateTooShort").alias("n_template_too_short"), of("LowUmiQuality").alias("n_low_umi_quality"),
    )


def umi_counts(parsed: DataFrame) -> DataFrame:
    """Reads per sample and UMI pair, with the first read's place."""
    return parsed.groupBy("sample_id", "umi_a", "umi_b").agg(F.count("*").alias("n"), F.min("read_ord").alias("first_ord"))


#: Bases of a bucket.
BUCKET_BASES = 3


def umi_neighbours(counts: DataFrame, distance: int = 1, bucketed: bool = True) -> DataFrame:
    """Pairs of UMI pairs within a Hamming distance, the smaller first: all of a sample's, or ``bucketed`` only those that agree in umi_a's first bases."""
    if not bucketed:
        return umis.neighbours(counts, distance, by_text=True)
    bucket = F.substring("umi_a", 1, BUCKET_BASES)
    # Two words hold the UMIs of both; longer ones are compared letter by letter at once.
    lengths, words = F.struct(F.length("umi_a"), F.length("umi_b")), S.text_words(F.concat("umi_a", "umi_b"), 2)
    side = lambda n: counts.select("sample_id", bucket.alias("bucket"), F.col("umi_a").alias(f"umi_a_{n}"), F.col("umi_b").alias(f"umi_b_{n}"), F.col("n").alias(f"n_{n}"), words.alias(f"words_{n}"), lengths.alias(f"lengths_{n}"))
    differing = F.when(F.col("lengths_1") == F.col("lengths_2"), S.differing_bytes(F.col("words_1"), F.col("words_2"), 2)).cast("int")
    near = F.coalesce(differing <= distance, F.lit(True))
    d = S.umi_distance(F.col("umi_a_1"), F.col("umi_b_1"), F.col("umi_a_2"), F.col("umi_b_2"))
    order = F.struct("umi_a_1", "umi_b_1") < F.struct("umi_a_2", "umi_b_2")
    return side(1).join(side(2), ["sample_id", "bucket"]).where(F.when(order, near)).withColumn("distance", F.coalesce(differing, d)).where(F.col("distance") <= distance).drop("words_1", "words_2", "lengths_1", "lengths_2")


def greedy_clusters(pairs: list[tuple[str, str]], distance: int) -> list[int]:
    """Seed of each UMI pair, taken most frequent first: the first seed within the distance, else itself."""
    import numpy as np

    if not pairs:
        return []
    letters = np.array([list((a + b).encode()) for a, b in pairs], np.uint8) if len({len(a + b) for a, b in pairs}) == 1 else None
    seeds: list[int] = []
    out = []
    for i, (a, b) in enumerate(pairs):
        hit = None
        if distance > 0 and seeds:
            if letters is not None:
                near = np.flatnonzero((letters[seeds] != letters[i]).sum(axis=1) <= distance)
                hit = seeds[near[0]] if len(near) else None
            else:
                hit = next((s for s in seeds if sum(x != y for k in (0, 1) for x, y in zip(pairs[s][k], (a, b)[k])) <= distance), None)
        if hit is None:
            seeds.append(i)
            hit = i
        out.append(hit)
    return out


def cluster_umis(counts: DataFrame, distance: int = 1, bucketed: bool = True) -> DataFrame:
    """``counts`` with the seed's UMI pair (``seed_a``, ``seed_b``).

    Greedy clustering depends on its order, so a group is worked through in one
    piece: most reads first, then first come. Buckets keep groups small; their
    size is bounded by the number of possible UMI pairs, whatever the depth.
    """
    keys = ["sample_id", F.substring("umi_a", 1, BUCKET_BASES).alias("bucket")] if bucketed else ["sample_id"]
    schema = "sample_id string, umi_a string, umi_b string, n long, first_ord long, seed_a string, seed_b string"

    def group(pdf):
        pdf = pdf.sort_values(["n", "first_ord"], ascending=[False, True], kind="stable").reset_index(drop=True)
        seeds = greedy_clusters(list(zip(pdf.umi_a, pdf.umi_b)), distance)
        pdf["seed_a"], pdf["seed_b"] = pdf.umi_a.to_numpy()[seeds], pdf.umi_b.to_numpy()[seeds]
        return pdf

    rows = counts.select("sample_id", "umi_a", "umi_b", "n", "first_ord")
    return rows.groupBy(*keys).applyInPandas(group if not bucketed else (lambda key, pdf: group(pdf)), schema)


def families(reads: DataFrame) -> DataFrame:
    """One row per family: strand counts, type, a stable id and, where reads have them, the first read's skipped bases."""
    keys = ["sample_id", "seed_a", "seed_b", "part"]
    of = lambda s: F.count_if(F.col("strand") == s)
    skip = [F.min_by("skip_r1", "read_ord").alias("skip")] if "skip_r1" in reads.columns else []
    out = reads.groupBy(*keys).agg(of("Forward").alias("fwd_reads"), of("Reverse").alias("rev_reads"), F.min("read_ord").alias("first_ord"), *skip)
    return out.withColumns({"family_type": S.family_type(F.col("fwd_reads"), F.col("rev_reads")), "molecule_id": S.stable_hash(*map(F.col, keys))})


def large_enough(families: DataFrame, least: int = 1) -> DataFrame:
    return families.where(F.col("fwd_reads") + F.col("rev_reads") >= least)


def assembly_stats(parsed: DataFrame, families: DataFrame, kept: DataFrame) -> DataFrame:
    """Counters of one run per sample."""
    of = lambda t: F.count_if(F.col("family_type") == t)
    mol = kept.groupBy("sample_id").agg(
        F.count("*").alias("n_molecules"), of("Duplex").alias("n_duplex"), of("SimplexFwd").alias("n_simplex_fwd"), of("SimplexRev").alias("n_simplex_rev"),
        of("Singleton").alias("n_singletons"), F.sum(F.when(F.col("part") > 0, 1).otherwise(0)).alias("n_umi_collisions"),
    )
    all_ = families.groupBy("sample_id").agg(F.count("*").alias("n_families"))
    out = parse_stats(parsed).join(all_, "sample_id", "left").join(mol, "sample_id", "left")
    return out.withColumns({
        "duplex_fraction": F.coalesce(F.try_divide("n_duplex", "n_molecules"), F.lit(0.0)), "mean_family_size": F.coalesce(F.try_divide("n_passed", "n_molecules"), F.lit(0.0)),
        "n_families_below_min_size": F.coalesce("n_families", F.lit(0)) - F.coalesce("n_molecules", F.lit(0)),
    })


# --- consensus

MIN_BASE_QUALITY, MAX_QUALITY = 10, 60


def duplex_consensus(fwd: Column, fwd_err: Column, rev: Column, rev_err: Column, mask: bool = False) -> Column:
    """struct<seq, err>, as far as both strands go: agreement multiplies errors; else the better base, or N with ``mask``."""
    n = F.least(F.length(fwd), F.length(rev))
    one = lambda s, e: F.slice(F.zip_with(F.split(s, "(?!$)"), e, lambda b, x: F.struct(b.alias("b"), x.alias("e"))), 1, F.greatest(n, F.lit(1)))

    def pair(x: Column, y: Column) -> Column:
        better = F.when(x.e <= y.e, x).otherwise(y)
        known = (x.b != "N") & (y.b != "N")
        same = F.struct(x.b.alias("b"), (x.e * y.e).alias("e"))
        other = F.struct(F.lit("N").alias("b"), F.lit(1.0).alias("e")) if mask else F.struct(better.b.alias("b"), better.e.alias("e"))
        return F.when(known & (x.b == y.b), same).when(~known, F.struct(better.b.alias("b"), better.e.alias("e"))).otherwise(other)

    both = F.zip_with(one(fwd, fwd_err), one(rev, rev_err), pair)
    return F.when(n > 0, F.struct(F.array_join(F.transform(both, lambda p: p.b), "").alias("seq"), F.transform(both, lambda p: p.e).alias("err")))


def consensus_reads(molecules: DataFrame) -> DataFrame:
    """(sample_id, molecule_id, family_type, seq, err): the best consensus of each molecule, both strands' first."""
    best = F.coalesce("duplex_consensus", "consensus_fwd", "consensus_rev")
    return molecules.select("sample_id", "molecule_id", "family_type", best["seq"].alias("seq"), best["err"].alias("err")).where("seq is not null")


def molecule_dump(molecules: DataFrame) -> DataFrame:
    """Thirteen text columns per molecule; a dot where there is no value, means at six places."""
    mean = lambda c: F.coalesce(F.format_string("%.6f", F.aggregate(F.col(f"{c}.err"), F.lit(0.0), lambda a, x: a + x) / F.size(f"{c}.err")), F.lit("."))
    count = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(F.lit(0)).cast("string")
    seq = lambda c: F.coalesce(F.col(f"{c}.seq"), F.lit("."))
    return molecules.select(
        F.hex("molecule_id").alias("molecule_id"), F.col("seed_a").alias("umi_fwd"), F.col("seed_b").alias("umi_rev"), F.col("duplex_consensus").isNotNull().cast("string").alias("has_duplex"),
        count("consensus_fwd", F.col("fwd_reads")).alias("fwd_n_reads"), count("consensus_rev", F.col("rev_reads")).alias("rev_n_reads"), count("duplex_consensus", F.col("fwd_reads") + F.col("rev_reads")).alias("duplex_n_reads"),
        seq("consensus_fwd").alias("fwd_seq"), seq("consensus_rev").alias("rev_seq"), seq("duplex_consensus").alias("duplex_seq"),
        mean("consensus_fwd").alias("fwd_mean_error"), mean("consensus_rev").alias("rev_mean_error"), mean("duplex_consensus").alias("duplex_mean_error"),
    )


def ranked_by_count(counts: DataFrame) -> DataFrame:
    """Places of UMI pairs, most reads first, then first come."""
    return ranges.ranked(counts, ["sample_id"], F.desc("n"), "first_ord").withColumn("rank", F.col("rank").cast("int"))
