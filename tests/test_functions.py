"""Sequence, statistics and allele expressions against their known cases."""

import math

import pytest
from pyspark.sql import functions as F

from lociframe.functions import alleles, stats
from lociframe.functions import sequence as S


def value(spark, column, **given):
    frame = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("seq", "code"), [("ACGT", 27), ("AAAA", 0), ("TTTT", 255), ("acgta", 108), ("T" * 31, 4611686018427387903), ("ACNGT", None), ("NAAAA", None), ("A" * 32, None)])
def test_codes(spark, seq, code):
    assert value(spark, S.encode_kmer(F.col("s")), s=seq) == code
    if code is not None:
        assert value(spark, S.decode_kmer(S.encode_kmer(F.col("s")), len(seq)), s=seq) == seq.upper()


def test_canonical_forms(spark):
    assert value(spark, S.canonical(F.col("s")), s="T" * 31) == "A" * 31
    assert value(spark, S.reverse_complement(F.col("s")), s="ACGTA") == "TACGT"
    assert value(spark, S.canonical_strand(F.col("s")), s="ACGT") == "Forward"
    assert value(spark, S.encode_base(F.col("s")), s="g") == 2 and value(spark, S.encode_base(F.col("s")), s="N") is None


def test_kmers_skip_unknown_letters(spark):
    df = spark.createDataFrame([(1, "acgNACGT"), (2, "AC"), (3, "TTTT")], "id int, seq string")
    got = sorted(tuple(r) for r in S.explode_kmers(df, "seq", 3, raw="raw").select("id", "pos", "kmer", "raw").collect())
    assert got == [(1, 0, "ACG", "ACG"), (1, 4, "ACG", "ACG"), (1, 5, "ACG", "CGT"), (3, 0, "AAA", "TTT"), (3, 1, "AAA", "TTT")]
    with pytest.raises(ValueError):
        S.explode_kmers(df, "seq", 32)


def test_umis(spark):
    pair = value(spark, S.umi_pair(F.lit("TGCAT"), F.lit("ACGTA")))
    assert tuple(pair) == ("ACGTA", "TGCAT")
    assert value(spark, S.umi_strand(F.lit("TGCAT"), F.lit("ACGTA"))) == "Reverse" and value(spark, S.umi_strand(F.lit("AA"), F.lit("AA"))) == "Forward"
    for (f, r), want in {(1, 0): "Singleton", (0, 1): "Singleton", (3, 0): "SimplexFwd", (0, 2): "SimplexRev", (2, 3): "Duplex"}.items():
        assert value(spark, S.family_type(F.lit(f), F.lit(r))) == want
    d = lambda *x: value(spark, S.umi_distance(*map(F.lit, x)))
    assert d("ACGTA", "TGCAT", "ACGTT", "TGCAT") == 1 and d("ACGTA", "TGCAT", "ACGTT", "TGCAG") == 2 and d("ACG", "T", "ACGTT", "") == 0


def test_fingerprints(spark):
    fp = lambda a, b: value(spark, S.endpoint_fingerprint(F.lit(a), F.lit(b))) & ((1 << 64) - 1)
    a = fp("ACGTACGTTTTTTTTTACGT", "TTTTTTTTACGTACGTTTTT")
    assert a == 0x1B1BFF1BFFFF1BFF and fp("CCGTACGTTTTTTTTTACGT", "TTTTTTTTACGTACGTTTTT") == 0x5B1BFF1BFFFF1BFF
    assert fp("A" * 24, "A" * 24) == fp("N" * 24, "N" * 24)
    t, u = "ACGTACGTAGCTAGCTAGCT", "TTTTTTTTGGGGGGGGCCCC"
    x, y = S.endpoint_fingerprint(F.lit(t), F.lit(u)), S.endpoint_fingerprint(F.lit(u), F.lit(t))
    assert not value(spark, S.compatible(x, y)) and value(spark, S.duplex_compatible(x, y))
    assert fp("", "") == 0 and fp("ACGT", "A") is not None


def test_ids(spark):
    limit = lambda s: value(spark, S.path_limit(F.lit(s)))
    assert (limit("chr17:100-300_DEL_maxpath200"), limit("chr1:0-100_MAXPATH150"), limit("TP53_exon7")) == (200, 150, None)
    for bad in ("no_colon", "chr1:abc-100", "chr1:100", "chr1:1-2_x"):
        assert value(spark, S.target_region(F.lit(bad))) is None
    assert tuple(value(spark, S.labelled_region(F.lit("chr1:49-250_SNV_1bp")))) == ("chr1", 49, 250)
    alt = lambda *x: value(spark, S.build_alt(*map(F.lit, x)))
    assert alt("ACGTACGT", 100, 103, "T", "G") == "ACGGACGT" and alt("ACGTACGT", 100, 99, "A", "G") is None and alt("ACGTACGT", 100, 103, "A", "G") is None
    assert tuple(value(spark, S.alt_header(F.lit("chr1:100-200 REF=g ALT=T")))) == ("chr1:100-200", "G", "T") and value(spark, S.alt_header(F.lit("x REF=G"))) is None
    f = value(spark, S.fusion_header(F.lit("BCR_ABL1__chr1:150-200__chr2:900-950__fusion")))
    assert (f.name, f.chrom_b, f.start_b, f.breakpoint) == ("BCR_ABL1", "chr2", 900, 50)
    assert value(spark, S.reconstruct(F.array(*map(F.lit, ("ACG", "CGT", "GTT"))))) == "ACGTT"


@pytest.mark.parametrize(("k", "n", "want"), [(5, 1000, (0.005, 0.00220278, 0.01161789)), (0, 1000, (0, 2.529e-05, 0.00367841)), (10, 1000, (0.01, 0.00549808, 0.01829503)), (20, 1000, (0.02, 0.01303211, 0.03068951)), (50, 100, (0.5, 0.40364307, 0.59635693)), (5, 3, (1.0, 0.39763536, 0.99369054)), (0, 0, (0, 0, 0))])
def test_intervals(spark, k, n, want):
    got = value(spark, stats.vaf_interval(F.col("k"), F.col("n")), k=k, n=n)
    assert all(abs(a - b) < 5e-8 for a, b in zip(got, want))


@pytest.mark.parametrize(("table", "p"), [((10, 10, 100, 100), 1.0), ((20, 0, 100, 100), 3.8544245e-06), ((10, 0, 495, 495), 0.0018749321), ((5, 0, 10, 15), 0.0421455939), ((0, 0, 0, 0), 1.0)])
def test_fisher(spark, table, p):
    assert value(spark, stats.fisher_exact(*map(F.lit, table))) == pytest.approx(p, rel=1e-7)
    df = spark.createDataFrame([table] * 2, "a int, b int, c int, d int")
    assert [r.p for r in stats.with_fisher(df, "a", "b", "c", "d", "p").collect()] == pytest.approx([p] * 2, rel=1e-7)


@pytest.mark.parametrize(("k", "n", "c"), [(0, 1000, 0), (0, 0, 0), (10, 1000, 1.0), (2, 1000, 0.983589235), (1, 1000, 0.802657968), (1, 14, 0.996349302), (2, 500, 0.995642834), (900, 1000, 1.0)])
def test_confidence(spark, k, n, c):
    assert value(spark, stats.confidence(F.lit(k), F.lit(n))) == pytest.approx(c, abs=1e-9)


def test_log_factorial(spark):
    for n in (0, 1, 2, 10, 170, 5000):
        assert value(spark, stats.log_factorial(F.lit(n))) == pytest.approx(math.lgamma(n + 1), abs=1e-9 * max(1, math.lgamma(n + 1)))


def edit(seq, at, old, new):
    assert seq[at : at + len(old)] == old
    return seq[:at] + new + seq[at + len(old) :]


SNV = "A" * 50 + "C" + "A" * 50
ALLELES = [
    ("chr1:1000-1100", SNV, edit(SNV, 50, "C", "T"), (1050, "C", "T")), ("chr1:500-509", "CAAAAAAAAA", "TAAAAAAAAA", (500, "C", "T")), ("chr1:100-109", "AAAAAAAAAC", "AAAAAAAAAT", (109, "C", "T")),
    ("chr2:1000-1100", "A" * 50 + "TGGT" + "A" * 47, "A" * 50 + "TGT" + "A" * 47, (1050, "TG", "T")), ("chr3:500-599", "A" * 100, "A" * 51 + "G" + "A" * 49, (550, "A", "AG")),
    ("chr5:500-602", "A" * 39 + "C" + "GCT" + "T" * 60, "A" * 39 + "C" + "T" * 60, (539, "CGCT", "C")), ("chr7:1000-1099", "A" * 50 + "TT" + "A" * 48, "A" * 50 + "TTT" + "A" * 48, (1049, "A", "AT")),
    ("chr2:200-206", "TAAAAAG", "TAAAAG", (200, "TA", "T")), ("chr3:50-54", "GAAAT", "GAAAAT", (50, "G", "GA")), ("chrX:100-109", "AAACGAAAAA", "AAATTAAAAA", (103, "CG", "TT")), ("chrM:1-3", "ACG", "ATG", (2, "C", "T")),
    ("chr1:10-14", "AAAC", "AAC", (10, "AA", "A")),
]


@pytest.mark.parametrize(("target", "ref", "alt", "want"), ALLELES)
def test_minimal_alleles(spark, target, ref, alt, want):
    got = value(spark, alleles.minimal_allele(F.col("t"), F.col("r"), F.col("a")), t=target, r=ref, a=alt)
    assert tuple(got) == (target.split(":")[0], *want)


def test_no_allele(spark):
    assert value(spark, alleles.minimal_allele(F.lit("notvalid"), F.lit("A"), F.lit("C"))) is None
    assert value(spark, alleles.minimal_allele(F.lit("chr1:1-2"), F.lit("AC"), F.lit("ac"))) is None


REF = "A" * 10 + "T" * 50 + "AAACCC" * 10 + "G" * 40
CLASSES = [
    ("ACGTACGT", "ACGAACGT", "SNV"), ("ACGTACGT", "ACCAACGT", "MNV"), ("AAACCC", "GGGTTT", "Inversion"), ("ACGT" * 40, "ACGT" * 25, "LargeDeletion"), ("ACGT" * 20, "ACGT" * 15, "Deletion"),
    ("ACGT" * 25, "ACGT" * 40, "TandemDuplication"), ("ACGT" * 20, "ACGT" * 10 + "C" * 60 + "ACGT" * 10, "NovelInsertion"), ("ACG" * 20, "ACG" * 10 + "T" * 50 + "ACG" * 10, "NovelInsertion"),
    ("ACGT" * 5, "ACGT" * 2 + "CC" + "ACGT" * 3, "Insertion"), (REF, "A" * 10 + "GGGTTT" * 10 + "G" * 40, "InvDel"),
]


@pytest.mark.parametrize(("ref", "alt", "kind"), CLASSES)
def test_classes(spark, ref, alt, kind):
    assert value(spark, alleles.classify(F.col("r"), F.col("a")), r=ref, a=alt) == kind


def test_fusion_class(spark):
    assert value(spark, alleles.classify(F.lit("ACGT"), F.lit("ACGA"), F.lit("x__chr1:1-2__chr2:1-2__fusion"))) == "Fusion"


@pytest.mark.parametrize(
    ("given", "config", "want"),
    [
        ((1.0, 1.0, 10, 5, 0.01, "SNV"), {}, "Pass"), ((1.0, 0.0018, 10, 0, 0.01, "SNV"), {}, "StrandBias"), ((0.8, 1.0, 1, 0, 0.001, "SNV"), {}, "LowConfidence"), ((1.0, 1.0, 10, 0, 0.01, "SNV"), {"min_alt_duplex": 1}, "LowDuplex"),
        ((0.996, 1.0, 1, 1, 0.07, "SNV"), {}, "Pass"), ((1.0, 1.0, 500, 50, 0.5, "SNV"), {"max_vaf": 0.35}, "HighVaf"), ((0.95, 0.005, 12, 2, 0.03, "Deletion"), {"min_confidence": 0.8}, "Pass"),
        ((0.95, 0.005, 12, 1, 0.03, "Deletion"), {"min_confidence": 0.8}, "StrandBias"), ((0.98, 0.5, 2, 0, 0.002, "Fusion"), {}, "Pass"), ((0.98, 0.5, 2, 0, 0.002, "InvDel"), {}, "Pass"), ((0.98, 0.5, 2, 0, 0.002, "SNV"), {}, "LowConfidence"),
    ],
)
def test_filters(spark, given, config, want):
    assert value(spark, alleles.call_filter(*map(F.lit, given), alleles.CallConfig().merged(**config))) == want


def test_one_molecule_with_a_duplex_passes_two_do_not(spark):
    config = alleles.CallConfig(min_alt_molecules=3)
    label = lambda n: value(spark, alleles.call_filter(*map(F.lit, (1.0, 1.0, n, 1, 0.01, "SNV")), config))
    assert [label(n) for n in (0, 1, 2, 3)] == ["LowConfidence", "Pass", "LowConfidence", "Pass"]
    say = lambda kind: value(spark, alleles.why_filtered(*map(F.lit, ("LowConfidence", 0.9, 1.0, 5, 1, 0.01, kind))))
    assert "0.95; see sv_min_confidence" in say("Fusion") and "0.99; see min_confidence" in say("SNV")


def test_difficulty(spark):
    share = lambda x: value(spark, S.repeat_fraction(F.lit(x)))
    assert share("ACGACGAC" + "ATATAT" + "GCGATC") == 0.3 and share("AAAAACGTCAGTCAGTCAGC") == 0.25 and share("ATATATTTGC") == 0.8 and share("ATAT") == 0 and share("") == 0
    dust = lambda x: value(spark, S.dust_score(F.lit(x)))
    assert dust("A" * 64) == 62 * 61 / 2 / 62 and dust("ACGT") == 0 and dust("AC") == 0 and dust("AAAA") == 0.5


def test_windows(spark):
    err = F.array(*(F.lit(x) for x in (0.1, 0.2, 0.3)))
    assert value(spark, S.window_error(err, F.lit(0), 2)) == pytest.approx(0.15) and value(spark, S.window_error(err, F.lit(2), 2)) == pytest.approx(0.15)
    assert value(spark, S.longest_homopolymer(F.lit("ACCCGG"))) == 3 and value(spark, S.repeat_fraction(F.lit("ACCCGG"))) == 0.5 and value(spark, S.longest_homopolymer(F.lit(""))) == 0
    assert value(spark, S.common_prefix(F.lit("ACG"), F.lit("ACT"))) == 2 and value(spark, S.common_suffix(F.lit("ACG"), F.lit("G"))) == 1 and value(spark, S.common_prefix(F.lit(""), F.lit("A"))) == 0
    assert value(spark, S.junction(F.lit("AACC"), F.lit("GGTT"), F.lit("INV"), 2)) == "CCAA"
