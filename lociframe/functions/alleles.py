"""Minimal alleles, variant classes and call filters as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import common_prefix, common_suffix, let, reverse_complement, target_region

#: The classes, those treated as structural, and the length at which they begin.
STRUCTURAL = ("LargeDeletion", "TandemDuplication", "Inversion", "Fusion", "InvDel", "NovelInsertion")
SV_LENGTH = 50


def minimal_allele(target_id: Column, ref: Column, alt: Column) -> Column:
    """struct<chrom, pos, ref, alt>: the smallest change between two sequences of a target, shifted left.

    Positions are the target's start plus the index in it. Substitutions stand
    alone; insertions and deletions keep one base before them, or, at the
    target's first base, one after. Null for equal sequences and ids without a
    region. While the last base of the differing stretch equals the base before
    it, the stretch moves left: it does so as often as the reversed prefix
    continues the stretch's own cycle, which is one comparison of strings.
    """
    given = F.struct(F.upper(ref).alias("r"), F.upper(alt).alias("a"), target_region(target_id).alias("at"))

    def ends(x: Column) -> Column:
        p = common_prefix(x.r, x.a)
        return F.struct(x.r.alias("r"), x.a.alias("a"), x.at.alias("at"), p.alias("p"), common_suffix(x.r, x.a).alias("s"))

    def cores(x: Column) -> Column:
        s = F.least(x.s, F.least(F.length(x.r), F.length(x.a)) - x.p)
        core = lambda seq: F.substring(seq, x.p + 1, F.length(seq) - x.p - s)
        return F.struct(x.r.alias("r"), x.at.alias("at"), x.p.alias("p"), core(x.r).alias("cr"), core(x.a).alias("ca"), F.concat(core(x.r), core(x.a)).alias("gap"))

    def shift(x: Column) -> Column:
        """How far a stretch that only one side has can move left."""
        cycle = F.substring(F.repeat(F.reverse(x.gap), F.ceil(x.p / F.length(x.gap)).cast("int") + 1), F.lit(1), x.p)
        moves = F.when((x.cr != "") & (x.ca != ""), 0).otherwise(common_prefix(F.reverse(F.substring(x.r, F.lit(1), x.p)), cycle))
        return F.struct(*(x[c].alias(c) for c in ("r", "at", "p", "cr", "ca", "gap")), moves.alias("moves"))

    def placed(x: Column) -> Column:
        turn = x.moves % F.length(x.gap)
        moved = F.concat(F.right(x.gap, turn), F.substring(x.gap, F.lit(1), F.length(x.gap) - turn))
        at = x.p - x.moves
        new_ref, new_alt = F.when(x.cr != "", moved).otherwise(""), F.when(x.ca != "", moved).otherwise("")
        before, after = F.substring(x.r, at, F.lit(1)), F.substring(x.r, at + F.length(new_ref) + 1, F.lit(1))
        out = lambda pos, r, a: F.struct(x.at["chrom"].alias("chrom"), (x.at["start"] + pos).alias("pos"), r.alias("ref"), a.alias("alt"))
        return (
            F.when((x.cr != "") & (x.ca != ""), out(x.p, x.cr, x.ca)).when(at > 0, out(at - 1, F.concat(before, new_ref), F.concat(before, new_alt)))
            .otherwise(out(F.lit(0), F.concat(new_ref, after), F.concat(new_alt, after)))
        )

    found = let(let(let(let(given, ends), cores), shift), placed)
    return F.when(target_region(target_id).isNotNull() & (F.upper(ref) != F.upper(alt)), found)


def trimmed(ref: Column, alt: Column) -> Column:
    """struct<ref, alt> without their common suffix; of a side that is all suffix its first base stays."""
    left = lambda x, s: F.when(F.length(x) > s, F.substring(x, F.lit(1), F.length(x) - s)).otherwise(F.substring(x, 1, 1))
    return let(common_suffix(ref, alt), lambda s: F.struct(left(ref, s).alias("ref"), left(alt, s).alias("alt")))


def mostly_copied(inserted: Column, reference: Column) -> Column:
    """Whether an insertion is a stretch of the doubled reference, or 80 % of it in one piece is."""

    def test(x: Column) -> Column:
        need = F.ceil(F.length(x.ins) * 0.8).cast("int")
        return F.exists(F.sequence(F.lit(1), F.length(x.ins) - need + 1), lambda i: F.contains(x.ref, F.substring(x.ins, i, need)))

    return F.when(F.length(inserted) > 0, let(F.struct(inserted.alias("ins"), F.concat(reference, reference).alias("ref")), test)).otherwise(False)


def classify(ref: Column, alt: Column, target_id: Column | None = None) -> Column:
    """The variant class of a pair of target sequences.

    Equal lengths: inversions (whole, or of a central stretch of 50 bases or
    more), then SNV or MNV by the number of differing bases. Unequal lengths:
    first a deletion with an inverted rest, both central stretches 50 or more,
    then deletions and insertions by length, long insertions by whether they
    repeat the reference.
    """
    given = F.struct(F.upper(ref).alias("r"), F.upper(alt).alias("a"))

    def middle(x: Column) -> Column:
        def cut(y: Column) -> Column:
            s = F.least(y.s, F.least(F.length(y.r), F.length(y.a)) - y.p)
            core = lambda seq: F.substring(seq, y.p + 1, F.length(seq) - y.p - s)
            return F.struct(y.r.alias("r"), y.a.alias("a"), core(y.r).alias("mr"), core(y.a).alias("ma"))

        return let(F.struct(x.r.alias("r"), x.a.alias("a"), common_prefix(x.r, x.a).alias("p"), common_suffix(x.r, x.a).alias("s")), cut)

    def kind(x: Column) -> Column:
        long = F.length(x.mr) >= SV_LENGTH
        inverted = (reverse_complement(x.r) == x.a) | (long & (reverse_complement(x.mr) == x.ma))
        differing = F.size(F.filter(F.zip_with(F.split(x.mr, "(?!$)"), F.split(x.ma, "(?!$)"), lambda a, b: a != b), lambda d: d))
        change = F.length(x.a) - F.length(x.r)
        turned = long & (F.length(x.ma) >= SV_LENGTH) & F.contains(reverse_complement(x.mr), x.ma)
        return (
            F.when(x.r == x.a, "SNV").when((change == 0) & inverted, "Inversion").when((change == 0) & (differing == 1), "SNV").when(change == 0, "MNV").when(turned & (change < 0), "InvDel")
            .when(change <= -SV_LENGTH, "LargeDeletion").when(change < 0, "Deletion").when(change < SV_LENGTH, "Insertion").otherwise("Longer")
        )

    def named(y: Column) -> Column:
        copied = mostly_copied(F.when(y.plain == "Longer", y.stretch), y.r)
        return F.when(y.plain != "Longer", y.plain).when(copied, "TandemDuplication").otherwise("NovelInsertion")

    seen = let(let(given, middle), lambda x: F.struct(kind(x).alias("plain"), x.ma.alias("stretch"), x.r.alias("r")))
    out = let(seen, named)
    return out if target_id is None else F.when(target_id.contains("__fusion"), "Fusion").otherwise(out)


def simple_class(ref: Column, alt: Column) -> Column:
    """SNV or INDEL, by length."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").otherwise("INDEL")


def size_class(ref: Column, alt: Column) -> Column:
    """SNV, short (to 5), medium (to 20) or SV, by the change in length."""
    n = F.abs(F.length(ref) - F.length(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").when(n <= 5, "short_indel").when(n <= 20, "medium_indel").otherwise("SV")


@dataclass(frozen=True)
class CallConfig:
    """Thresholds of calls; fixed default values."""

    min_confidence: float = 0.99
    strand_bias_threshold: float = 0.01
    min_alt_molecules: int = 2
    min_alt_duplex: int = 0
    duplex_for_single: int = 1
    max_vaf: float | None = None
    sv_min_confidence: float = 0.95
    sv_min_alt_molecules: int = 1
    sv_strand_bias_threshold: float = 1.0
    background: float = 1e-4

    def merged(self, **given) -> CallConfig:
        """With the arguments that are given, None meaning the default."""
        from dataclasses import replace

        return replace(self, **{k: v for k, v in given.items() if v is not None})


def call_filter(conf: Column, bias_p: Column, n_alt: Column, n_duplex: Column, vaf: Column, kind: Column, config: CallConfig = CallConfig()) -> Column:
    """The first filter that a call fails, or Pass."""
    sv = kind.isin(*STRUCTURAL)
    pick = lambda a, b: F.when(sv, F.lit(a)).otherwise(F.lit(b))
    few = (n_alt < pick(config.sv_min_alt_molecules, config.min_alt_molecules)) & ~((n_alt == 1) & (n_duplex >= config.duplex_for_single))
    threshold = pick(config.sv_strand_bias_threshold, config.strand_bias_threshold)
    biased = (bias_p < threshold) & (threshold < 1.0) & (n_duplex < 2)
    out = (
        F.when(few, "LowConfidence").when(n_duplex < config.min_alt_duplex, "LowDuplex").when(biased, "StrandBias")
        .when(conf < pick(config.sv_min_confidence, config.min_confidence), "LowConfidence")
    )
    if config.max_vaf is not None:
        out = out.when(vaf > config.max_vaf, "HighVaf")
    return out.otherwise("Pass")


def why_filtered(label: Column, conf: Column, bias_p: Column, n_alt: Column, n_duplex: Column, vaf: Column, kind: Column | None = None, config: CallConfig = CallConfig()) -> Column:
    """A sentence on a call's filter: the statistic, its threshold and the option that moves it; structural classes (``kind``) have their own."""
    say = lambda name, value, limit, flag: F.concat_ws("", F.lit(f"{name} "), value.cast("string"), F.lit(f" against {limit}; see {flag}"))
    sv = F.lit(False) if kind is None else kind.isin(*STRUCTURAL)

    def by_kind(name: str, value: Column, option: str) -> Column:
        return F.when(sv, say(name, value, getattr(config, f"sv_{option}"), f"sv_{option}")).otherwise(say(name, value, getattr(config, option), option))

    least = F.when(sv, F.lit(config.sv_min_alt_molecules)).otherwise(F.lit(config.min_alt_molecules))
    return (
        F.when(label == "Pass", F.lit("passed every filter")).when(label == "StrandBias", by_kind("strand bias p", bias_p, "strand_bias_threshold"))
        .when(label == "LowDuplex", say("duplex molecules", n_duplex, config.min_alt_duplex, "min_alt_duplex")).when((label == "LowConfidence") & (n_alt < least), by_kind("alt molecules", n_alt, "min_alt_molecules"))
        .when(label == "LowConfidence", by_kind("confidence", conf, "min_confidence")).when(label == "HighVaf", say("VAF", vaf, config.max_vaf, "max_vaf"))
        .when(label == "NotTargeted", F.lit("no listed variant matches; see ti_position_tolerance")).otherwise(label)
    )
