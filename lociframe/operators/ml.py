"""Features of calls and their re-scoring by a user's model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.shared import written
from .scoring import group_fold, ml_metrics

#: Added to divisors and logarithms; a fixed value.
TINY = 1e-9
#: Substitutions by number; other changes are 12.
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G", "G>T", "G>C", "G>A", "A>T", "A>G", "A>C")
#: The features' names, by which a model's file asks for them.
CALL_FEATURES = (
    "vaf", "nref", "nalt", "ndupalt", "nsimalt", "sbp", "conf", "ref_len", "alt_len", "duplex_frac", "has_duplex", "ci_width", "alt_depth", "log_nalt", "log_nref", "log_alt_depth", "log_vaf",
    "vaf_times_conf", "vaf_times_nalt", "nalt_over_conf", "ci_width_rel", "snr", "conf_sq", "nalt_sq", "vaf_sq", "ref_alt_len_ratio", "indel_size", "duplex_enrichment", "simplex_only_frac",
    "conf_above_99", "conf_above_999", "sbp_above_05", "variant_class_enc",
)
CONTEXT_FEATURES = (
    "subst_type", "trinuc_context", "is_cpg", "gc_content_ref", "homopolymer_run", "n_simplex_fwd_alt", "n_simplex_rev_alt", "n_duplex_ref", "n_simplex_ref", "mean_alt_error_prob",
    "min_variant_specific_duplex", "mean_variant_specific_molecules", "strand_asymmetry_alt", "duplex_vaf", "simplex_vaf", "duplex_simplex_vaf_delta",
)
LOCUS_FEATURES = ("dust_score", "repeat_fraction")


def _columns(calls: DataFrame, *names: str) -> list[Column]:
    """Columns as doubles; one that the calls lack counts as 0."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in calls.columns else F.lit(0.0) for n in names]


def call_features(calls: DataFrame, classes: dict[str, int] | None = None) -> DataFrame:
    """The 33 features of each call from its own figures, beside its columns; ``classes`` are a model's numbers of variant classes, 0 if unknown."""
    vaf, low, high, nref, nalt, dup, simple, bias, conf = _columns(calls, "vaf", "vaf_ci_low", "vaf_ci_high", "n_molecules_ref", "n_molecules_alt", "n_duplex_alt", "n_simplex_alt", "strand_bias_p", "confidence")
    ref_len, alt_len = (F.length(c).cast("double") for c in ("ref_seq", "alt_seq"))
    flag = lambda x: x.cast("double")
    depth, width = nref + nalt, high - low
    number = F.lit(0.0)
    if classes:
        number = F.coalesce(F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[F.col("variant_type")].cast("double"), F.lit(0.0))
    values = (
        vaf, nref, nalt, dup, simple, bias, conf, ref_len, alt_len, dup / (nalt + TINY), flag(dup > 0), width, depth, F.log1p(nalt), F.log1p(nref), F.log1p(depth), F.log(vaf + 1e-6),
        vaf * conf, vaf * nalt, nalt / (conf + TINY), width / (vaf + TINY), nalt / (nref + 1), conf * conf, nalt * nalt, vaf * vaf, ref_len / (alt_len + 1), F.abs(ref_len - alt_len),
        dup / (vaf * depth + TINY), simple / (nalt + TINY), flag(conf > 0.99), flag(conf > 0.999), flag(bias > 0.05), number,
    )
    return calls.withColumns(dict(zip(CALL_FEATURES, values)))


def context_features(calls: DataFrame) -> DataFrame:
    """The 16 features of sequence context and strands, and the two of local difficulty, beside the calls' columns.

    Substitution, context and CpG are those of single-base changes; others have
    12, 64 and 0. Figures that the calls lack count as 0.
    """
    ref, alt = F.upper("ref_seq"), F.upper("alt_seq")
    calls = calls.withColumn("__at", S.common_prefix(ref, alt)).withColumn("__end", S.common_suffix(ref, alt))
    at, n = F.col("__at"), F.length(ref)
    snv = (n == F.length(alt)) & (at + F.col("__end") == n - 1)
    base = lambda seq, i: F.substring(seq, i + 1, F.lit(1))
    change = F.concat(base(ref, at), F.lit(">"), base(alt, at))
    number = F.array_position(F.array(*map(F.lit, SUBSTITUTIONS)), change).cast("int") - 1
    code = lambda c: F.instr(F.lit("ACGT"), c) - 1
    three = F.when(at > 0, F.substring(ref, at, F.lit(3)))
    tri = F.when(snv & three.rlike("^[ACGT]{3}$"), code(base(three, F.lit(0))) * 16 + code(base(three, F.lit(1))) * 4 + code(base(three, F.lit(2))))
    before = F.when(at > 0, base(ref, at - 1))
    cpg = ((change == "C>T") & (base(ref, at + 1) == "G")) | ((change == "G>A") & (before == "C"))
    stop = F.greatest(n - F.least(F.col("__end"), F.least(n, F.length(alt)) - at), at)  # where the change ends in the reference
    run = F.greatest(F.length(F.regexp_extract(F.substring(ref, F.lit(1), at), r"(.)\1*$", 0)), F.length(F.regexp_extract(F.substring(ref, stop + 1, n), r"^(.)\1*", 0)))
    raw = CONTEXT_FEATURES[5:12]
    fwd, rev, dup_ref, simple_ref, *_ = figures = _columns(calls, *raw)
    dup, simple = _columns(calls, "n_duplex_alt", "n_simplex_alt")
    duplex, simplex = dup / (dup + dup_ref + TINY), simple / (simple + simple_ref + TINY)
    values = (
        F.coalesce(F.when(snv & (number >= 0), number), F.lit(12)), F.coalesce(tri, F.lit(64)), F.coalesce(F.when(snv, cpg), F.lit(False)).cast("int"), S.gc_fraction(ref), run, *figures,
        (fwd - rev) / (fwd + rev + TINY), duplex, simplex, duplex - simplex,
    )
    out = calls.withColumns(dict(zip(CONTEXT_FEATURES, values)))
    return out.withColumns({"dust_score": S.dust_score(ref, at), "repeat_fraction": S.repeat_fraction(ref)}).drop("__at", "__end")


def script_features(calls: DataFrame) -> DataFrame:
    """The separately named set of the training scripts: other formulas for some names, so not for models of ``call_features``.

    Adds shares by duplex and simplex, logarithms, products and classes by length; a depth quintile is ``quintile``'s.
    """
    vaf, low, high, nref, nalt, dup, simple, conf, fwd, rev, dup_ref, simple_ref, err, own_dup = _columns(
        calls, "vaf", "vaf_ci_low", "vaf_ci_high", "n_molecules_ref", "n_molecules_alt", "n_duplex_alt", "n_simplex_alt", "confidence", "n_simplex_fwd_alt", "n_simplex_rev_alt",
        "n_duplex_ref", "n_simplex_ref", "mean_alt_error_prob", "min_variant_specific_duplex",
    )
    bias = F.coalesce(F.col("strand_bias_p").cast("double"), F.lit(1.0))
    ref_len, alt_len = (F.length(F.coalesce(c, F.lit(""))) for c in ("ref_seq", "alt_seq"))
    over = lambda a, b: a / (b + TINY)
    flag = lambda x: x.cast("int")
    longest = F.greatest(ref_len, alt_len)
    shares = {"duplex_vaf": over(dup, dup + dup_ref), "simplex_vaf": over(simple, simple + simple_ref)}
    depths = {"duplex_depth": dup + dup_ref, "simplex_depth": simple + simple_ref}
    logs = {"log_nalt": nalt, "log_nref": nref, "log_nduplex_alt": dup, "log_nsimplex_alt": simple, "log_alt_depth": nalt + nref, "log_duplex_depth": depths["duplex_depth"], "log_simplex_depth": depths["simplex_depth"]}
    return calls.withColumns({
        "ref_len": ref_len, "alt_len": alt_len, **shares, "duplex_simplex_vaf_delta": shares["duplex_vaf"] - shares["simplex_vaf"], "vaf_duplex_agreement": F.abs(vaf - shares["duplex_vaf"]),
        "duplex_enrichment": over(dup, nalt), "duplex_frac": over(dup, nalt), "simplex_frac": over(simple, nalt), "simplex_only_frac": over(simple, nalt), "strand_balance": over(F.least(fwd, rev), fwd + rev),
        "strand_asymmetry": over(fwd - rev, fwd + rev), **depths, "duplex_ref_frac": over(dup_ref, dup_ref + dup), "variant_specific_duplex_frac": over(own_dup, dup), "qual_confidence_interaction": (1 - err) * conf,
        "qual_vaf_interaction": (1 - err) * vaf, "has_duplex": flag(dup > 0), "log_vaf": F.log(vaf + 1e-6), **{k: F.log1p(v) for k, v in logs.items()}, "ci_width": high - low, "ci_width_rel": over(high - low, vaf),
        "vaf_times_conf": vaf * conf, "vaf_times_nalt": vaf * nalt, "nalt_over_conf": over(nalt, conf), "conf_sq": conf * conf, "nalt_sq": nalt * nalt, "vaf_sq": vaf * vaf, "snr": nalt / (nref + 1),
        "ref_alt_len_ratio": over(ref_len, alt_len), "indel_size": F.abs(ref_len - alt_len),
        "variant_class": F.when((ref_len == 1) & (alt_len == 1), "SNV").when(longest <= 5, "short_indel").when(longest <= 20, "medium_indel").otherwise("SV"),
        "sbp_cat": F.when(bias < 0.01, "low").when(bias < 0.05, "medium").otherwise("high"), "conf_above_99": flag(conf >= 0.99), "conf_above_999": flag(conf >= 0.999), "sbp_above_05": flag(bias >= 0.05),
    })


def quintile(df: DataFrame, column: str, out: str = "quintile", q: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the quantile bucket of a column, from 0; equal edges merge."""
    cuts = F.percentile(column, F.array(*(F.lit(i / q) for i in range(1, q)))).alias("__cuts")
    edges = df.groupBy(*keys).agg(cuts) if keys else df.agg(cuts)
    joined = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))  # one row
    return joined.withColumn(out, F.size(F.filter(F.array_distinct("__cuts"), lambda e: F.col(column) > e))).drop("__cuts")


@dataclass(frozen=True)
class ModelMeta:
    """What a model's sibling file says: feature columns, threshold, class numbers."""

    feature_names: list[str]
    threshold: float = 0.5
    classes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> ModelMeta:
        with open(path) as f:
            raw = json.load(f)
        return cls(raw["feature_names"], float(raw.get("threshold", 0.5)), raw.get("variant_class_map", raw.get("classes", {})))


#: Names under which models can be registered: name to (model bytes' path, metadata path).
REGISTRY: dict[str, tuple[str, str]] = {}


def register_model(name: str, model: str, meta: str) -> None:
    REGISTRY[name] = (model, meta)


def models() -> list[str]:
    return sorted(REGISTRY)


def score_onnx(features: DataFrame, model: bytes, meta: ModelMeta) -> DataFrame:
    """``features`` with ``ml_prob``, the chance of class 1, and ``ml_filter``; the model travels with the task.

    A feature of the model that ``features`` lacks counts as 0.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(features.schema.jsonValue()).add("ml_prob", "float")

    def batch(batches):
        import numpy as np
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        session = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            out = session.run(None, {name: pdf.reindex(columns=meta.feature_names, fill_value=0.0).to_numpy(np.float32)})[-1]
            yield pdf.assign(ml_prob=np.asarray([r[1] for r in out], np.float32) if len(pdf) else np.zeros(0, np.float32))

    return with_ml_filter(features.mapInPandas(batch, schema), meta.threshold)


def with_ml_filter(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("ml_filter", F.when(F.col("ml_prob") >= threshold, "PASS").otherwise("ML_FILTER"))


def score_calls(calls: DataFrame, model: str, meta: str) -> DataFrame:
    """``calls`` scored by an ONNX file and its JSON; with null ``ml_prob`` and ``ml_filter`` and a warning if they cannot be loaded."""
    import warnings

    try:
        about = ModelMeta.load(meta)
        with open(model, "rb") as f:
            raw = f.read()
        import onnxruntime as ort

        ort.InferenceSession(raw, providers=["CPUExecutionProvider"])
    except Exception as e:  # whatever is wrong with the files, calling goes on without scores
        warnings.warn(f"no scores, the model cannot be loaded: {e}", stacklevel=2)
        return calls.withColumns({"ml_prob": F.lit(None).cast("float"), "ml_filter": F.lit(None).cast("string")})
    features = context_features(call_features(calls, about.classes))
    return score_onnx(features, raw, about).select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in calls.schema), "ml_prob", "ml_filter")


def train_classifier(features: DataFrame, names: list[str], label: str = "label", rounds: int = 20):
    """A boosted-tree model of this session's own, for calls with known labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep"), GBTClassifier(featuresCol="__features", labelCol=label, maxIter=rounds, seed=7)]
    return Pipeline(stages=stages).fit(features)


def out_of_fold(features: DataFrame, names: list[str], group: str, label: str = "label", folds: int = 5, rounds: int = 20) -> DataFrame:
    """``features`` with ``fold`` and ``prob``, the chance of class 1 by a model that saw no row of the row's group.

    One model per fold, fitted on the other folds and kept to score its own. A
    fold whose others have one class only, or no rows, takes that class's share.
    ``features`` is read once per fold and should be written.
    """
    from functools import reduce

    from pyspark.ml.functions import vector_to_array

    rows = features.withColumn("fold", group_fold(F.col(group), folds))
    sides = {r.fold: (r.p, r.n) for r in rows.groupBy("fold").agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n")).collect()}  # a row per fold
    scored = []
    for fold in sorted(sides):
        pos, all_ = (sum(v[i] for f, v in sides.items() if f != fold) for i in (0, 1))
        own = rows.where(F.col("fold") == fold)
        if 0 < pos < all_:
            model = train_classifier(rows.where(F.col("fold") != fold), names, label, rounds)
            scored.append(model.transform(own).withColumn("prob", vector_to_array("probability")[1]).select(*rows.columns, "prob"))
        else:
            scored.append(own.withColumn("prob", F.lit(float(pos) / all_ if all_ else 0.0)))
    return reduce(DataFrame.unionByName, scored) if scored else rows.withColumn("prob", F.lit(0.0))


def cross_validate(features: DataFrame, names: list[str], group: str, label: str = "label", folds: int = 5, rounds: int = 20, threshold: float = 0.5, keep=written) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold rows and their figures by fold; groups are never split."""
    scored = keep(out_of_fold(keep(features), names, group, label, folds, rounds))
    return scored, ml_metrics(scored.withColumnRenamed(label, "label") if label != "label" else scored, threshold, ["fold"])


def rank_within(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
