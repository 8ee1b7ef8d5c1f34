"""Scoring calls against truth: exact sets, tolerances, sweeps, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calls import near_matches

ALLELE = ["chrom", "pos", "ref", "alt"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def set_metrics(truth: DataFrame, calls: DataFrame, negatives: DataFrame | None = None, keys: list[str] = ALLELE, by: str | None = None) -> DataFrame:
    """TP, FP, FN, TN and their ratios over distinct keys, in all or by a column that both sides have."""
    by_ = [by] if by else []
    side = lambda df, n: df.select(*by_, *keys).distinct().withColumn(n, F.lit(1))
    both = side(truth, "t").join(side(calls, "c"), [*by_, *keys], "full")
    if negatives is not None:
        both = both.join(side(negatives, "n"), [*by_, *keys], "full")
    has = lambda c: F.col(c).isNotNull()
    tn = F.count_if(has("n") & ~has("c") & ~has("t")) if negatives is not None else F.lit(0).cast("bigint")
    out = both.groupBy(*by_).agg(F.count_if(has("t") & has("c")).alias("tp"), F.count_if(has("c") & ~has("t")).alias("fp"), F.count_if(has("t") & ~has("c")).alias("fn"), tn.alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(F.col("tn"), F.col("tn") + fp), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def tolerance_scores(truth: DataFrame, calls: DataFrame, tolerance: int = 10, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """TP: truth with any call near it; FN: truth without; FP: distinct places of calls with no truth near."""
    hit = near_matches(truth, calls, tolerance, keys=keys).agg(F.count("*").alias("tp"))
    miss = near_matches(truth, calls, tolerance, "left_anti", keys).agg(F.count("*").alias("fn"))
    wrong = near_matches(calls.select(*keys, "pos").distinct(), truth, tolerance, "left_anti", keys).agg(F.count("*").alias("fp"))
    return hit.crossJoin(miss).crossJoin(wrong).withColumn("sensitivity", ratio(F.col("tp"), F.col("tp") + F.col("fn")))  # one row each


def sensitivity(scores: DataFrame, *by: str) -> DataFrame:
    """Mean sensitivity over replicates, and their number."""
    return scores.groupBy(*by).agg(F.avg("sensitivity").alias("sensitivity"), F.count("*").alias("n"))


def sweep_pivot(scores: DataFrame, parameter: str, column: str, values: list) -> DataFrame:
    """Parameter by column: mean sensitivities."""
    return scores.groupBy(parameter).pivot(column, values).agg(F.avg("sensitivity"))


def best_parameter(scores: DataFrame, by: str, parameter: str) -> DataFrame:
    """The parameter value of the greatest mean sensitivity, the smaller one of equals."""
    means = scores.groupBy(by, parameter).agg(F.avg("sensitivity").alias("mean"))
    return means.groupBy(by).agg(F.max_by(parameter, F.struct("mean", (-F.col(parameter)).alias("x"))).alias("best"), F.max("mean").alias("mean"))


#: Labels of shares in their order.
VAF_LEVELS = ("0pc", "0p001pc", "0p01pc", "0p1pc", "0p25pc", "0p5pc", "1pc", "2pc")
#: Fixed values of the reasons for disagreement: labels of low shares, classes that methods differ on, small input in ng.
LOW_VAF, ODD_TYPES, LOW_INPUT = ("0p001pc", "0p01pc", "0p1pc", "0p25pc"), ("INDEL", "INS", "DEL", "SV", "INVDEL"), (5,)


def concordance(truth: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Each variant of the truth with its call, the last one of several (by ``ord``), and which methods found it.

    ``truth`` says by ``alignment_detected`` whether alignment did; null is no.
    """
    last = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    calls = calls.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "ord").withColumn("__hit", F.lit(True))
    out = truth.join(calls, keys, "left")
    aligned, called = F.coalesce("alignment_detected", F.lit(False)), F.coalesce("__hit", F.lit(False))
    which = F.when(aligned & called, "both_detected").when(aligned, "alignment_only").when(called, "call_only").otherwise("neither")
    return out.withColumn("call_detected", called).withColumn("concordance", which).drop("__hit")


def _level(label: str = "vaf_level") -> Column:
    """A share label's place; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, VAF_LEVELS)), F.col(label))
    return F.when(at > 0, at)


def concordance_summary(rows: DataFrame) -> DataFrame:
    """Counts and rates by vaf_level and variant_type, in the order of shares."""
    of = lambda c: F.count_if(F.col("concordance") == c)
    kinds = ("both_detected", "alignment_only", "call_only", "neither")
    out = rows.groupBy("vaf_level", "variant_type").agg(F.count("*").alias("total_calls"), *(of(k).alias(k) for k in kinds))
    both, n = F.col("both_detected"), F.col("total_calls")
    aligned = both + F.col("alignment_only")
    rates = {"alignment_sensitivity": aligned / n, "call_sensitivity": (both + F.col("call_only")) / n, "concordance_rate": F.when(aligned > 0, both / aligned)}
    return out.withColumns(rates).orderBy(_level().asc_nulls_last(), "variant_type")


def discordance(rows: DataFrame, depth_threshold: int = 100) -> DataFrame:
    """Variants that one method alone found, with direction and the likeliest reason.

    ``rows`` has concordance, alignment_depth (a number or null), vaf_level,
    variant_type and input_ng. In this order: no depth or one below the
    threshold, a share near the limit, a class that methods differ on, small input.
    """
    depth = F.col("alignment_depth")
    reason = (
        F.when(depth.isNull() | (depth < depth_threshold), "low_depth").when(F.col("vaf_level").isin(*LOW_VAF), "low_vaf")
        .when(F.col("variant_type").isin(*ODD_TYPES), "variant_type").when(F.col("input_ng").isin(*LOW_INPUT), "input_amount").otherwise("unknown")
    )
    odd = rows.where(F.col("concordance").isin("alignment_only", "call_only"))
    return odd.withColumn("reason", reason).withColumnRenamed("concordance", "direction")


def discordance_summary(details: DataFrame) -> DataFrame:
    keys = ("reason", "direction", "variant_type")
    return details.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(*keys)


def label_by_interval(variants: DataFrame, targets: DataFrame, width: int = 1000) -> DataFrame:
    """``variants`` with the first target (by start, id) whose interval holds them; null without any.

    Intervals are dealt to every bin of ``width`` they touch; each variant looks at its own.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    t = targets.select("chrom", "target_id", "start", "end").withColumn("__bin", bins)
    places = variants.select("chrom", "pos").distinct().withColumn("__bin", F.floor(F.col("pos") / width))
    hit = places.join(t, ["chrom", "__bin"]).where(F.col("pos").between(F.col("start"), F.col("end")))
    first = hit.groupBy("chrom", "pos").agg(F.min(F.struct("start", "target_id")).alias("x")).select("chrom", "pos", F.col("x.target_id").alias("target_id"))
    return variants.join(first, ["chrom", "pos"], "left")


def fusion_scores(expected: DataFrame, calls: DataFrame) -> DataFrame:
    """Per sample: as many true positives as there are both events and passing breakends; the excess on either side is wrong or missed."""
    n = calls.where("filter = 'PASS' and svtype = 'BND'").groupBy("sample_id").agg(F.count("*").alias("calls"))
    out = expected.join(n, "sample_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    e, c = F.col("events"), F.col("calls")
    return out.withColumns({"tp": F.least(e, c), "fp": F.greatest(c - e, F.lit(0)), "fn": F.greatest(e - c, F.lit(0))})


def ml_metrics(scored: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """AUROC, AUPRC and the figures at a threshold of (label, prob) rows, by ``keys`` if there are any.

    Rows of one probability count together; the curves are sums over distinct
    probabilities, which partial sums by a thousandth keep from one task.
    """
    keys = keys or []
    per = scored.groupBy(*keys, "prob").agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    per = per.withColumn("band", F.floor(F.col("prob") * 1000))
    bands = per.groupBy(*keys, "band").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a thousand rows
    bands = bands.select(*keys, "band", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    within = Window.partitionBy(*keys, "band").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(bands, [*keys, "band"]).withColumns({"tp": F.col("ap") + F.sum("p").over(within), "fp": F.col("an") + F.sum("n").over(within)})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    hit = F.col("prob") >= threshold
    s = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = per.groupBy(*keys).agg(area.alias("area"), ap.alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("neg"), s("p", hit).alias("tp"), s("n", hit).alias("fp"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    counts = [F.col("pos").alias("n_pos"), (F.col("pos") + F.col("neg")).alias("n_total")] if keys else []
    return out.select(
        *keys, ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("auroc"), ratio(F.col("ap"), F.col("pos")).alias("auprc"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"), *counts,
    )


def group_fold(sample: Column, n: int = 5) -> Column:
    """Fold of a sample, by its MD5: all its rows are in one, and any engine gives it the same."""
    return (F.conv(F.substring(F.md5(sample.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")
