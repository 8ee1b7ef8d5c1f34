"""Variant calls from scored paths, tumour-informed filtering, rescue, fusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats
from ..functions.alleles import STRUCTURAL, CallConfig, call_filter, classify, minimal_allele
from ..functions.codes import kmer_codes
from ..sources.shared import written
from . import ranges

#: Fixed value: rows of ids and places that may be sent to every task.
FEW = 100_000


def pair_with_reference(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each alternative path beside its target's first reference path; targets without one have no rows."""
    keys = [*(keys if keys is not None else ["sample_id"]), "target_id"]
    first = Window.partitionBy(*keys).orderBy(F.desc("min_molecules"), "path_seq")
    figures = [c for c in scored.columns if c not in (*keys, "is_reference")]
    ref = scored.where("is_reference").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    ref = ref.select(*keys, *(F.col(c).alias(f"ref_{c}") for c in figures))
    return scored.where("not is_reference").join(ref.hint("merge"), keys)


def figures(pairs: DataFrame, kind: Column) -> DataFrame:
    """Molecule counts of both sides: least along the path, or for structural classes the rounded own and mean figures."""
    pairs = pairs.withColumn("variant_type", kind)
    sv = F.col("variant_type").isin(*STRUCTURAL)
    alt = F.when(sv, F.round("mean_variant_specific_molecules").cast("bigint")).otherwise(F.col("min_molecules"))
    ref = F.when(sv, F.round("ref_mean_molecules").cast("bigint")).otherwise(F.col("ref_min_molecules"))
    out = pairs.withColumn("n_molecules_alt", alt).withColumn("n_molecules_ref", ref)
    out = out.withColumn("n_duplex_alt", F.col("min_variant_specific_duplex"))
    return out.withColumn("n_simplex_alt", F.greatest(F.lit(0), F.col("n_molecules_alt") - F.col("n_duplex_alt")))


def call_variants(scored: DataFrame, config: CallConfig = CallConfig(), keys: list[str] | None = None) -> DataFrame:
    """Calls: class, share with interval, strand bias, confidence and filter of each alternative path."""
    pairs = pair_with_reference(scored, keys)
    kind = classify(F.col("ref_path_seq"), F.col("path_seq"), F.col("target_id"))
    out = figures(pairs, kind)
    n = F.col("n_molecules_alt") + F.col("n_molecules_ref")
    out = out.withColumn("interval", stats.vaf_interval(F.col("n_molecules_alt"), n))
    out = stats.with_fisher(out, "min_simplex_fwd", "min_simplex_rev", "ref_min_simplex_fwd", "ref_min_simplex_rev", "bias")
    same = F.col("path_seq") == F.col("ref_path_seq")
    out = out.withColumns({
        "vaf": F.when(same, 0.0).otherwise(F.col("interval.vaf")), "vaf_ci_low": F.when(same, 0.0).otherwise(F.col("interval.low")), "vaf_ci_high": F.when(same, 0.0).otherwise(F.col("interval.high")),
        "strand_bias_p": F.when(same, 1.0).otherwise(F.col("bias")), "confidence": F.when(same, 0.0).otherwise(stats.confidence(F.col("n_molecules_alt"), n, config.background)),
    })
    label = call_filter(F.col("confidence"), F.col("strand_bias_p"), F.col("n_molecules_alt"), F.col("n_duplex_alt"), F.col("vaf"), F.col("variant_type"), config)
    out = out.withColumn("filter", F.when(same, "LowConfidence").otherwise(label))
    head = keys if keys is not None else ["sample_id"]
    duplex_ref = F.col("ref_min_duplex" if "ref_min_duplex" in out.columns else "ref_min_variant_specific_duplex")
    error = F.col("mean_error_prob") if "mean_error_prob" in out.columns else F.lit(None).cast("double")
    more = (duplex_ref.alias("n_duplex_ref"), F.greatest(F.lit(0), F.col("n_molecules_ref") - duplex_ref).alias("n_simplex_ref"), error.alias("mean_alt_error_prob"))
    return out.select(
        *head, "target_id", "variant_type", F.col("ref_path_seq").alias("ref_seq"), F.col("path_seq").alias("alt_seq"), "vaf", "vaf_ci_low", "vaf_ci_high", "n_molecules_ref", "n_molecules_alt",
        "n_duplex_alt", "n_simplex_alt", *more, F.col("min_simplex_fwd").alias("n_simplex_fwd_alt"), F.col("min_simplex_rev").alias("n_simplex_rev_alt"), "mean_variant_specific_molecules",
        "min_variant_specific_duplex", "strand_bias_p", "confidence", "filter", F.lit("CALLED").alias("call_source"),
    )


def with_alleles(calls: DataFrame) -> DataFrame:
    return calls.withColumn("allele", minimal_allele(F.col("target_id"), F.col("ref_seq"), F.col("alt_seq")))


def call_stats(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("n_calls"), F.count_if(F.col("filter") == "Pass").alias("n_pass"), F.count_if(F.col("filter") != "Pass").alias("n_filtered"))


# --- tumour-informed filtering


def exact_matches(variants: DataFrame, listed: DataFrame) -> DataFrame:
    """``variants`` (chrom, pos, ref, alt) that are on the list."""
    return variants.join(listed.select("chrom", "pos", "ref", "alt").distinct(), ["chrom", "pos", "ref", "alt"], "left_semi")


def near_matches(left: DataFrame, right: DataFrame, tolerance: int, how: str = "left_semi", keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """A join within ``tolerance`` of ``pos``, on equal keys: semi, anti, or inner (right's place as ``right_pos``).

    Places are dealt to bins of the tolerance plus one, each left row looks at
    its own and the two next to it; the distance is checked after. So the join
    is an equality join and never compares all with all.
    """
    width = tolerance + 1
    b = right.withColumn("__bin", F.floor(F.col("pos") / width)).withColumnRenamed("pos", "right_pos")
    b = b.select(*keys, "__bin", *(c for c in b.columns if c not in (*keys, "__bin"))) if how == "inner" else b.select(*keys, "__bin", "right_pos").distinct()
    bins = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("pos") / width) + d))
    a = (left if how == "inner" else left.select(*keys, "pos").distinct()).withColumn("__bin", bins)
    hit = a.join(b, [*keys, "__bin"]).where(F.abs(F.col("pos") - F.col("right_pos")) <= tolerance).drop("__bin")
    return hit if how == "inner" else left.join(hit.select(*keys, "pos").distinct(), [*keys, "pos"], how)


def containing(sequences: DataFrame, targets: DataFrame, key: str, k: int = 31) -> DataFrame:
    """(key, target_id, pos): every place of a sequence (key, seq) at which a target (target_id, seq) of k letters or more lies whole.

    Sequences meet targets by the code of the targets' first k-mer, at all of
    its places; only then are the letters compared. Few hits are sent to the
    sequences, so that no text is shuffled for them.
    """
    t = targets.select("target_id", F.upper("seq").alias("__target")).where(F.length("__target") >= k)
    first = t.select("target_id", F.get(kmer_codes(F.substring("__target", 1, k), k), F.lit(0)).alias("__code")).where("__code is not null")
    rows = sequences.select(key, F.posexplode(kmer_codes(F.col("seq"), k)).alias("pos", "__code")).where("__code is not null")
    hits = written(rows.join(first, "__code").select(key, "pos", "target_id"))
    few = hits.count() <= FEW
    both = sequences.select(key, F.upper("seq").alias("__seq")).join(F.broadcast(hits) if few else hits.hint("merge"), key).join(t, "target_id")
    return both.where(F.substring(F.col("__seq"), F.col("pos") + 1, F.length("__target")) == F.col("__target")).select(key, "target_id", "pos")


def targeted(calls: DataFrame, listed: DataFrame, tolerance: int = 0, alternatives: DataFrame | None = None) -> DataFrame:
    """Calls that passed everything else become NotTargeted unless the list has them.

    A call matches by its minimal allele, else within ``tolerance`` on its
    chromosome whatever the alleles, else by its whole sequence among the
    target's ``alternatives`` (target_id, alt_seq).
    """
    calls = with_alleles(calls).withColumns({c: F.col(f"allele.{c}") for c in ("chrom", "pos", "ref", "alt")})
    exact = listed.select("chrom", "pos", "ref", "alt").distinct().withColumn("__exact", F.lit(True))
    calls = calls.join(exact, ["chrom", "pos", "ref", "alt"], "left")
    hit = F.coalesce("__exact", F.lit(False))
    if tolerance > 0:
        near = near_matches(calls.select("chrom", "pos").distinct(), listed, tolerance).withColumn("__near", F.lit(True))
        calls = calls.join(near, ["chrom", "pos"], "left")
        hit = hit | F.coalesce("__near", F.lit(False))
    if alternatives is not None:
        seqs = alternatives.select(F.col("target_id").alias("__target"), F.upper("alt_seq").alias("__seq")).distinct().withColumn("__alt", F.lit(True))
        calls = calls.join(seqs, (F.col("target_id") == F.col("__target")) & (F.upper("alt_seq") == F.col("__seq")), "left").drop("__target", "__seq")
        hit = hit | F.coalesce("__alt", F.lit(False))
    out = calls.withColumn("filter", F.when((F.col("filter") == "Pass") & ~hit, "NotTargeted").otherwise(F.col("filter")))
    return out.drop("__exact", "__near", "__alt")


def nearest(left: DataFrame, right: DataFrame, value: str, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``left`` with the value of the row of ``right`` whose ``mid`` is nearest to its own, the smaller one of two; null without any.

    One sort of both sides together, by ranges: the last row before and the
    first after, whichever range they are in.
    """
    a = left.select(*keys, "mid", F.struct(*(c for c in left.columns)).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    b = right.groupBy(*keys, "mid").agg(F.min(value).alias("v")).select(*keys, "mid", F.lit(None).cast(a.schema["row"].dataType).alias("row"), "v", F.lit(0).alias("side"))
    place = F.when(F.col("side") == 0, F.struct(F.col("mid").alias("at"), F.col("v").alias("v")))
    both = ranges.filled(a.unionByName(b), list(keys), ["mid", "side"], {"p": place}, {"n": place}).where("side = 1")
    pick = F.when(F.col("n").isNull() | (F.col("mid") - F.col("p.at") <= F.col("n.at") - F.col("mid")), F.col("p")).otherwise(F.col("n"))
    return both.select("row.*", pick["v"].alias(value))


# --- rescue


def rescue_probe(targets: DataFrame, index: DataFrame, k: int = 31) -> DataFrame:
    """Evidence for a listed variant by its own k-mers alone: targets with ref_seq and alt_seq; by sample if the index has ``sample_id``.

    The least count is over the k-mers found (0 if none), duplex counts add up,
    the reference mean is over all its own k-mers with absent ones as 0.
    Targets whose reference is shorter than k or without own k-mers have no row.
    """
    targets = targets.where(F.length("ref_seq") >= k)
    keys = ["sample_id"] if "sample_id" in index.columns else []
    side = lambda c: S.explode_kmers(targets.select("target_id", c), c, k).select("target_id", "kmer").distinct()
    alt, ref = side("alt_seq"), side("ref_seq")
    own_alt, own_ref = alt.join(ref, ["target_id", "kmer"], "left_anti"), ref.join(alt, ["target_id", "kmer"], "left_anti")
    every = own_alt.groupBy("target_id").agg(F.count("*").alias("kmers_total"))
    every = every.join(own_ref.groupBy("target_id").agg(F.count("*").alias("__ref")), "target_id", "left")
    if keys:  # a row for each sample and target is what is asked for
        every = every.crossJoin(index.select(*keys).distinct())
    seen = index.select(*keys, "kmer", "n_molecules", "n_duplex")
    by = [*keys, "target_id"]
    a = own_alt.join(seen, "kmer").groupBy(*by).agg(F.min("n_molecules").alias("min_alt_molecules"), F.sum("n_duplex").alias("sum_alt_duplex"), F.count("*").alias("kmers_found"))
    r = own_ref.join(seen, "kmer").groupBy(*by).agg(F.sum("n_molecules").alias("__sum"))
    out = every.join(a, by, "left").join(r, by, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("min_alt_molecules", "sum_alt_duplex", "kmers_found")})
    out = out.withColumn("mean_ref_molecules", F.coalesce(F.col("__sum") / F.col("__ref"), F.lit(0.0)))
    out = out.select(*by, "min_alt_molecules", "sum_alt_duplex", "kmers_found", "kmers_total", "mean_ref_molecules")
    return out.withColumn("approx_vaf", stats.approx_vaf(F.col("min_alt_molecules"), F.col("mean_ref_molecules")))


def rescued(calls: DataFrame, probes: DataFrame) -> DataFrame:
    """``calls`` with a row for each probed target (of each sample) that has no passing call: seen below threshold, by probe only, or not at all."""
    by = [c for c in ("sample_id", "target_id") if c in probes.columns and c in calls.columns]
    passing = calls.where(F.col("filter") == "Pass").select(*by).distinct()
    seen = calls.select(*by).distinct().withColumn("__called", F.lit(True))
    rows = probes.join(passing, by, "left_anti").join(seen, by, "left")
    source = F.when(F.col("__called"), "SUBTHRESHOLD").when(F.col("kmers_found") > 0, "RESCUED").otherwise("NO_EVIDENCE")
    rows = rows.withColumn("call_source", source).drop("__called").withColumnRenamed("min_alt_molecules", "rescue_min_alt_molecules").withColumnRenamed("sum_alt_duplex", "rescue_alt_duplex")
    rows = rows.withColumnRenamed("kmers_found", "rescue_kmers_found").withColumnRenamed("kmers_total", "rescue_kmers_total").withColumnRenamed("approx_vaf", "rescue_approx_vaf")
    return calls.unionByName(rows.drop("mean_ref_molecules"), allowMissingColumns=True)


def windows_of(targets: DataFrame, listed: DataFrame, width: int = 1000) -> DataFrame:
    """Targets (target_id, seq, chrom, start) with the listed variants (pos, ref, alt) that begin in them.

    Targets are dealt to every bin of ``width`` they touch, a variant looks at its own.
    """
    last = F.col("start") + F.length("seq") - 1
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(last, F.col("start")) / width)))
    t = targets.select("target_id", "seq", "chrom", "start", last.alias("__last"), bins.alias("__bin"))
    v = listed.select("chrom", "pos", "ref", "alt").withColumn("__bin", F.floor(F.col("pos") / width))
    return t.join(v, ["chrom", "__bin"]).where(F.col("pos").between(F.col("start"), F.col("__last"))).drop("__bin", "__last")


def alternatives_of(entries: DataFrame) -> DataFrame:
    """(target_id, ref_seq, alt_seq) of targets and listed variants: the first target whose window holds a variant.

    ``entries`` has targets (target_id, seq, chrom, start) with the variants (pos, ref, alt) in them.
    """
    alt = S.build_alt(F.col("seq"), F.col("start"), F.col("pos"), F.col("ref"), F.col("alt"))
    rows = entries.withColumn("alt_seq", alt).where("alt_seq is not null")
    first = Window.partitionBy("chrom", "pos", "ref", "alt").orderBy("start", "target_id")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("target_id", F.col("seq").alias("ref_seq"), "alt_seq", "chrom", "pos", "ref", "alt")


# --- fusions


def fusion_vaf(junction: DataFrame, partners: DataFrame) -> DataFrame:
    """Junction molecules over the mean depth of both partners, each taken from the nearest ordinary target.

    ``junction`` has target_id, n_molecules, chrom_a, mid_a, chrom_b, mid_b; ``partners`` chrom, mid and depth.
    """
    out = junction
    for s in ("a", "b"):
        out = nearest(out.withColumnRenamed(f"chrom_{s}", "chrom").withColumnRenamed(f"mid_{s}", "mid"), partners, "depth")
        out = out.withColumnRenamed("chrom", f"chrom_{s}").withColumnRenamed("mid", f"mid_{s}").withColumnRenamed("depth", f"depth_{s}")
    depth = (F.coalesce("depth_a", F.lit(0)) + F.coalesce("depth_b", F.lit(0))) / 2
    return out.withColumn("partner_depth", depth).withColumn("vaf", F.coalesce(F.try_divide(F.col("n_molecules").cast("double"), F.col("partner_depth")), F.lit(0.0)))


def library_depth(junctions: DataFrame, molecules: DataFrame) -> DataFrame:
    """Junction calls with all molecules of their sample's library as their denominator."""
    if "sample_id" in molecules.columns and "sample_id" in junctions.columns:
        return junctions.join(molecules.groupBy("sample_id").agg(F.count("*").alias("library_molecules")), "sample_id", "left")
    return junctions.crossJoin(molecules.agg(F.count("*").alias("library_molecules")))  # a single row
