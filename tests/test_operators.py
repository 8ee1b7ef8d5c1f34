"""Operators, sources, sinks, streams and the whole run."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions.alleles import CallConfig
from lociframe.operators import calls, explore, graph, kmers, ml, reads, scoring
from lociframe.plans import config, inputs, pipeline, queries
from lociframe.plans import column_queries, file_queries  # noqa: F401
from lociframe.sources import files, writers
from lociframe.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("counts", "d", "groups"),
    [
        ({"ACGTA+TGCAT": 10, "ACGTT+TGCAT": 5, "AAAAA+TTTTT": 3}, 0, [[0], [1], [2]]), ({"ACGTA+TGCAT": 20, "ACGTT+TGCAT": 3, "AAAAA+CCCCC": 1}, 1, [[0, 1], [2]]),
        ({"AAAAA+TTTTT": 100, "AAAAC+TTTTT": 10, "AAACC+TTTTT": 5}, 1, [[0, 1], [2]]),
    ],
)
def test_clusters(spark, counts, d, groups):
    rows = [("s", *k.split("+"), n, i) for i, (k, n) in enumerate(counts.items())]
    df = spark.createDataFrame(rows, "sample_id string, umi_a string, umi_b string, n long, first_ord long")
    for bucketed in (True, False):
        found = {}
        for r in reads.cluster_umis(df, d, bucketed).collect():
            found.setdefault((r.seed_a, r.seed_b), []).append(r.first_ord)
        assert sorted(map(sorted, found.values())) == groups


def test_buckets_keep_neighbours_apart(spark):
    df = spark.createDataFrame([("s", "AACGT", "T", 5, 0), ("s", "ACCGT", "T", 2, 1)], "sample_id string, umi_a string, umi_b string, n long, first_ord long")
    assert reads.cluster_umis(df, 1).select("seed_a").distinct().count() == 2 and reads.cluster_umis(df, 1, bucketed=False).select("seed_a").distinct().count() == 1


def test_drop_reasons(spark):
    q = lambda n, c="I": c * n
    rows = [("s", 0, "ACG", q(3), "ACGTTTT", q(7)), ("s", 1, "A" * 10, q(10), "A" * 8, q(8)), ("s", 2, "A" * 10, "#" + q(9), "A" * 10, q(10)), ("s", 3, "A" * 10, q(10), "A" * 10, q(10))]
    df = spark.createDataFrame(rows, files.READS)
    got = [r.drop_reason for r in reads.parse_reads(df, min_template=3).orderBy("read_ord").collect()]
    assert got == ["ReadTooShort", "TemplateTooShort", "LowUmiQuality", None]
    assert reads.dropped(reads.parse_reads(df, min_umi_quality=0)).count() == 1


def test_duplex_consensus(spark):
    d = lambda a, e, b, f, mask=False: spark.range(1).select(reads.duplex_consensus(F.lit(a), F.array(*map(F.lit, e)), F.lit(b), F.array(*map(F.lit, f)), mask).alias("d")).first().d
    both = d("AC", [0.1, 0.2], "AG", [0.1, 0.1])
    assert both.seq == "AG" and both.err == pytest.approx([0.01, 0.1])
    assert d("AC", [0.1, 0.2], "AG", [0.1, 0.1], True).seq == "AN"


def test_evidence(spark):
    df = spark.createDataFrame([(1, "ACGT", "SimplexFwd", [0.01] * 4), (2, "ACGT", "SimplexRev", [0.02] * 4)], "molecule_id long, seq string, family_type string, err array<double>")
    r = kmers.evidence(kmers.read_kmers(df, 4), []).first()
    assert (r.n_molecules, r.n_simplex_fwd, r.n_simplex_rev, r.min_err) == (2, 1, 1, 0.01) and r.mean_err == pytest.approx(0.015)
    twice = spark.createDataFrame([(1, "ACGACG", "Singleton")], "molecule_id long, seq string, family_type string")
    each = {r.kmer: r.n_molecules for r in kmers.evidence(kmers.read_kmers(twice, 3), []).collect()}
    assert each["ACG"] == 2 and kmers.evidence(kmers.read_kmers(twice, 3), [], distinct=True).where("kmer = 'ACG'").first().n_molecules == 1
    a = kmers.evidence(kmers.read_kmers(df.where("molecule_id = 1"), 4), [])
    b = kmers.evidence(kmers.read_kmers(df.where("molecule_id = 2"), 4), [])
    assert kmers.merge(a, b, keys=[]).first().mean_err == pytest.approx(0.015)


@pytest.mark.parametrize(("n", "threshold", "start", "end"), [((1, 2), 100, True, True), ((200, 5), 100, False, True), ((5, 150), 100, True, False), ((100, 1), 101, True, True), ((100, 1), 100, False, True)])
def test_anchors(spark, n, threshold, start, end):
    t = spark.createDataFrame([("t", "ACGGTA"), ("short", "AC")], "target_id string, seq string")
    index = spark.createDataFrame([("ACG", n[0]), ("GTA", n[1])], "kmer string, n_molecules long")
    got = {r.target_id: r for r in kmers.validate_anchors(t, index, 3, threshold).collect()}
    assert (got["t"].start_unique, got["t"].end_unique) == (start, end) and (got["t"].warning is None) == (start and end) and got["short"].start_count is None


def test_samples_are_kept_apart(spark):
    """Two samples in one job give what two jobs of one sample give."""
    ref, alt = "ACGGTACCATGA", "ACGGTATCATGA"
    targets = spark.createDataFrame([("t", ref, alt), ("short", "AC", alt), ("u", alt, ref)], "target_id string, ref_seq string, alt_seq string")
    rows = [(1, alt, "Duplex"), (2, alt, "Duplex"), (3, ref, "SimplexFwd"), (4, ref[:8], "Duplex")]
    one = {s: spark.createDataFrame([(s, *r) for r in part], "sample_id string, molecule_id long, seq string, family_type string") for s, part in (("a", rows), ("b", rows[:3]), ("c", rows[2:]))}
    index = {s: kmers.evidence(kmers.read_kmers(df, 5)) for s, df in one.items()}
    both = index["a"].union(index["b"]).union(index["c"])
    found = lambda df: sorted(map(tuple, df.collect()), key=repr)
    probes = calls.rescue_probe(targets, both, 5)
    assert found(probes) == sorted((r for i in index.values() for r in found(calls.rescue_probe(targets, i, 5))), key=repr) and probes.where("target_id = 'short'").isEmpty()
    made = spark.createDataFrame([("a", "t", "Pass"), ("b", "t", "LowConfidence")], "sample_id string, target_id string, filter string").withColumn("call_source", F.lit("CALLED"))
    got = {(r.sample_id, r.target_id): r.call_source for r in calls.rescued(made, probes).where("filter is null").collect()}
    assert got == {("b", "t"): "SUBTHRESHOLD", ("c", "t"): "NO_EVIDENCE", ("a", "u"): "RESCUED", ("b", "u"): "RESCUED", ("c", "u"): "RESCUED"}
    panel = targets.select("target_id", F.col("ref_seq").alias("seq"))
    cols = ("sample_id", "target_id", "start_count", "end_count")
    assert found(kmers.validate_anchors(panel, both, 5).select(*cols)) == sorted((r for i in index.values() for r in found(kmers.validate_anchors(panel, i, 5).select(*cols))), key=repr)


def brute_paths(start, end, nodes, most):
    out, stack = [], [[start]]
    while stack:
        p = stack.pop()
        for b in "ACGT":
            n = p[-1][1:] + b
            if n in nodes and n not in p and len(p) < most:
                (out if n == end else stack).append([*p, n])
    return sorted(out)


def test_walk_finds_all_paths():
    r = random.Random(2)
    for _ in range(40):
        seq = "".join(r.choice("ACGT") for _ in range(14))
        other = seq[:7] + r.choice("ACGT") + seq[7 + r.randint(0, 1) :]
        nodes = {s[i : i + 3]: 2 for s in (seq, other) for i in range(len(s) - 2)}
        found, spent = graph.walk(seq[:3], seq[-3:], nodes, 16, max_paths=10**6)
        if seq[:3] != seq[-3:]:
            assert sorted(found) == brute_paths(seq[:3], seq[-3:], nodes, 16) and not spent
    assert graph.walk("AAA", "CCC", {"AAA": 1}, 9) == ([], False)
    assert len(graph.walk(seq[:3], seq[-3:], nodes, 16, max_paths=1)[0]) <= 1


def test_soft_anchors_and_duplications(spark):
    assert graph.soft_anchors("AACGTT", 3, {"ACG": 1, "CGT": 1}) == (1, 2) and graph.soft_anchors("AAAA", 3, {}) is None
    t, j = "AACCGGTTACGT", "GTTAGGTT"
    made = graph.tandem_duplication(t, j)
    df = graph.tandem_duplications(spark.createDataFrame([("t", t)], "target_id string, seq string"), spark.createDataFrame([("t", j)], "target_id string, seq string"))
    assert made == "AACCGGTTA" + "GGTTA" + "CGT" and df.first().path_seq == made


def test_targeting(spark):
    rows = [("s", "TP53:0-100", "ACGTACGTACGT", "ACTTACGTACGT", "Pass"), ("s", "BRCA1:0-100", "TTTTGGGGCCCC", "TTTTGGGGATCC", "Pass")]
    df = spark.createDataFrame(rows, "sample_id string, target_id string, ref_seq string, alt_seq string, filter string")
    listed = spark.createDataFrame([("TP53", 3, "G", "T")], "chrom string, pos long, ref string, alt string")
    label = lambda *a: {r.target_id: r.filter for r in calls.targeted(df, listed, *a).collect()}
    assert label(1000) == {"TP53:0-100": "Pass", "BRCA1:0-100": "NotTargeted"} and label(0)["TP53:0-100"] == "NotTargeted"
    alts = spark.createDataFrame([("BRCA1:0-100", "ttttggggatcc")], "target_id string, alt_seq string")
    assert label(0, alts)["BRCA1:0-100"] == "Pass"


def test_calls(spark):
    cols = "target_id string, path_seq string, is_reference boolean, min_molecules long, mean_molecules double, min_variant_specific_duplex long, mean_variant_specific_molecules double, min_simplex_fwd long, min_simplex_rev long"
    ref = ("t", "ACGTA", True, 990, 990.0, 0, 990.0, 495, 495)
    for alt, want in ((("t", "ACTTA", False, 10, 10.0, 5, 10.0, 5, 5), "Pass"), (("t", "ACTTA", False, 10, 10.0, 0, 10.0, 10, 0), "StrandBias"), (("t", "ACTTA", False, 1, 1.0, 0, 1.0, 1, 0), "LowConfidence")):
        r = calls.call_variants(spark.createDataFrame([ref, alt], cols), keys=[]).first()
        assert r["filter"] == want and (want != "Pass" or r.vaf == pytest.approx(0.01))


def test_nearest(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 100), (3, "b", 5)], "id int, chrom string, mid long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 15, 2), ("a", 90, 3)], "chrom string, mid long, depth int")
    assert {r.id: r.depth for r in calls.nearest(left, right, "depth").collect()} == {1: 1, 2: 3, 3: None}


def test_filter_language(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.01), ("ab", 3, None)], "target_id string, n int, vaf double")
    x = explore.Explorer(df)
    ids = lambda t: sorted(r.target_id for r in x.filter(t).collect())
    assert ids("n > 1 AND vaf < 0.1 OR target_id == a") == ["a", "b"] and ids("target_id contains b") == ["ab", "b"] and ids("clear") == ["a", "ab", "b"] and ids("target_id == a' OR 1=1 --".split(" OR ")[0]) == []
    for bad in ("nope == 1", "n ==", "n > x", "n"):
        with pytest.raises(explore.FilterError):
            x.filter(bad)
    x.filter("clear")
    assert [r.target_id for r in x.head(1).collect()] == ["a"] and [r.target_id for r in x.tail(1).collect()] == ["b"] and x.fields()[1] == ("n", "int") and x.show("b").count() == 1 and x.search("n", "3").count() == 1


def test_formats():
    assert writers.parse_formats(None) == ["tsv"] and writers.parse_formats(" TSV, vcf") == ["tsv", "vcf"]
    with pytest.raises(ValueError):
        writers.parse_formats("xml")
    assert writers.output_paths("a/b.out", ["tsv"]) == {"tsv": "a/b.out"} and writers.output_paths("a/b.out", ["tsv", "vcf"]) == {"tsv": "a/b.tsv", "vcf": "a/b.vcf"}


def test_call_sinks(spark, tmp_path):
    import json

    row = ("chr1:5-9", "SNV", "ACGTA", "ACTTA", 1 / 3, 0.1, 0.6, 20, 10, 3, 7, 0.5, 1.0, "Pass")
    df = spark.createDataFrame([row], "target_id string, variant_type string, ref_seq string, alt_seq string, vaf double, vaf_ci_low double, vaf_ci_high double, n_molecules_ref long, n_molecules_alt long, n_duplex_alt long, n_simplex_alt long, strand_bias_p double, confidence double, filter string")
    whole = lambda form: "".join(p.read_text() for p in sorted((tmp_path / form).glob("part-*")))
    for form in ("tsv", "csv", "json"):
        writers.write_table(writers.call_table(df.coalesce(1)), str(tmp_path / form), form)
    assert whole("tsv").splitlines() == ["\t".join(writers.CALL_COLUMNS), "chr1:5-9\tSNV\tACGTA\tACTTA\t0.333333\t0.100000\t0.600000\t20\t10\t3\t7\t0.500000\t1.000000\tPASS"]
    assert json.loads(whole("json"))[0]["vaf"] == 0.333333 and whole("csv").splitlines()[1].startswith("chr1:5-9,SNV")
    writers.write_table(writers.call_table(df.limit(0)), str(tmp_path / "none"), "json")
    assert json.loads(whole("none")) == []
    writers.write_vcf(writers.vcf_records(calls.with_alleles(df)), str(tmp_path / "vcf"))
    lines = whole("vcf").splitlines()
    assert lines[0] == "##fileformat=VCFv4.3" and lines[1].startswith("##source=") and sum(x.startswith("##FILTER") for x in lines) == 7
    assert lines[-1] == "chr1\t7\t.\tG\tT\t.\tPASS\tVAF=0.333333;VAF_LO=0.100000;VAF_HI=0.600000;NREF=20;NALT=10;NDUPALT=3;NSIMALT=7;SBP=0.500000;CONF=1.000000"


def test_scores_by_a_model(spark, tmp_path):
    """A file that is no model leaves calls without scores; features that a model asks for are there by name."""
    df = spark.createDataFrame([("SNV", "ACGTA", "ACTTA", 0.5, 10, 5)], "variant_type string, ref_seq string, alt_seq string, vaf double, n_molecules_alt long, n_duplex_alt long")
    (tmp_path / "m.onnx").write_bytes(b"no model")
    (tmp_path / "m.json").write_text('{"feature_names": ["vaf", "nalt"]}')
    with pytest.warns(UserWarning, match="cannot be loaded"):
        r = ml.score_calls(df, str(tmp_path / "m.onnx"), str(tmp_path / "m.json")).first()
    assert r.ml_prob is None and r.ml_filter is None and r.n_molecules_alt == 10
    f = ml.context_features(ml.call_features(df)).first()
    assert (f.nalt, f.duplex_frac, f.subst_type, f.trinuc_context, f.is_cpg, f.log_vaf) == (10.0, pytest.approx(0.5), 6, 16 * 1 + 4 * 2 + 3, 0, pytest.approx(-0.693145, abs=1e-5))


def test_sources(spark, tmp_path):
    a, b = tmp_path / "r1.fq.gz", tmp_path / "r2.fq"
    with gzip.open(a, "wt") as f:
        f.write("@1\nACG\n+\nIII\n@2\nTT\n+\nII\n")
    b.write_text("@1\nCCC\n+\nIII\n@2\nGG\n+\nII\n")
    got = [tuple(r) for r in files.read_fastq_pairs(spark, [("s", str(a), str(b))]).orderBy("read_ord").collect()]
    assert got == [("s", 0, "ACG", "III", "CCC", "III"), ("s", 1, "TT", "II", "GG", "II")]
    lanes = files.read_fastq_pairs(spark, [("s", str(a), str(b)), ("t", str(a), str(b)), ("s", str(a), str(b))]).select("sample_id", "read_ord").collect()
    assert len(set(lanes)) == 6 and sorted(r.read_ord for r in lanes if r.sample_id == "t") == [0, 1]
    b.write_text("@1\nCCC\n+\nIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        files.read_fastq_pairs(spark, [("s", str(a), str(b))]).collect()
    fa = tmp_path / "t.fa"
    fa.write_text(">chr1:1-8 REF=G ALT=T\nacgt\nACGT\n>chr2:5-9_DEL_maxpath20\nAA\n>x REF=A\nCC\n")
    t = {r.target_id: r for r in files.read_targets(spark, str(fa)).collect()}
    assert t["chr1:1-8"].seq == "ACGTACGT" and t["chr2:5-9_DEL_maxpath20"].max_path == 20 and t["chr2:5-9_DEL_maxpath20"].start == 5 and len(t) == 3
    assert [tuple(r) for r in files.read_alternatives(spark, str(fa)).collect()] == [("chr1:1-8", "G", "T", "ACGTACGT")]
    vcf = tmp_path / "v.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tC,G\t.\tPASS\tTYPE=SNP\nchr1\t6\t.\tA\tT\t.\tbad\tX\n")
    assert files.read_vcf(spark, str(vcf)).count() == 3 and files.read_vcf(spark, str(vcf), True).count() == 2
    tsv = tmp_path / "c.tsv"
    tsv.write_text("target_id\tvaf\nt\t0.5\n")
    assert tuple(files.read_calls(spark, str(tsv), "target_id string, vaf double, filter string").first()) == ("t", 0.5, None)
    df = spark.createDataFrame([(1,)], "kmer long")
    files.write_stage(df, str(tmp_path / "idx"), "index", k=31)
    assert files.stage_header(spark, str(tmp_path / "idx"))["k"] == 31 and files.read_stage(spark, str(tmp_path / "idx"), "index").count() == 1
    with pytest.raises(ValueError):
        files.read_stage(spark, str(tmp_path / "idx"), "molecules")


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[indexing]\nkmer_size = 21\n[calling]\nmin_confidence = 0.9\n")
    c = config.load_config(str(p), kmer_size=25, max_vaf=0.3)
    assert c.kmer_size == 25 and c.call == CallConfig(min_confidence=0.9, max_vaf=0.3) and config.memory_shares(100) == {"assembly": 25, "index": 60, "paths": 15}


def test_whole_run(spark, tmp_path):
    spark.range(240).selectExpr("id as event_id", "id div 4 as user_id").coalesce(2).write.parquet(str(tmp_path / "events.parquet"))
    rows, targets = inputs.mutated_reads(spark, str(tmp_path))
    got = pipeline.run(rows, targets, config.RunConfig(ti_rescue=True)).calls.collect()
    assert got and {r.variant_type for r in got} == {"SNV"} and all(r.n_molecules_alt >= 2 for r in got if r["filter"] == "Pass")
    hit = next(r for r in got if r["filter"] == "Pass")
    start = int(hit.target_id.split(":")[1].split("-")[0])
    seqs = {r.start: r.seq for r in targets.collect()}
    other = next(s for s in seqs if s != start)
    swap = lambda s, at: (s[at], "ACGT"["CGTA".index(s[at])])
    listed = spark.createDataFrame([("chr1", start + 60, hit.ref_seq[60], hit.alt_seq[60]), ("chr1", other + 20, *swap(seqs[other], 20))], "chrom string, pos long, ref string, alt string")
    out = pipeline.run(rows, targets, config.RunConfig(ti_rescue=True), listed).calls
    found = out.collect()
    assert [r.target_id for r in found if r["filter"] == "Pass"] == [hit.target_id] and {r.call_source for r in found if r["filter"] is None} <= {"SUBTHRESHOLD", "NO_EVIDENCE"}
    assert sum(r["filter"] is None for r in found) == 1
    records = writers.vcf_records(calls.with_alleles(out.where("filter is not null")))
    writers.write_vcf(records, str(tmp_path / "out.vcf"))
    assert files.read_vcf(spark, str(tmp_path / "out.vcf")).where("pos > 1").count() == sum(r["filter"] is not None for r in found)


def test_streams(spark, tmp_path):
    parsed = reads.passed(reads.parse_reads(inputs.reads(spark, SF))).select("sample_id", "umi_a", "umi_b", "strand", "read_ord")
    parsed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parsed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.stream_families(stream).writeStream.outputMode("update").format("memory").queryName("fams").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = spark.table("fams").groupBy("sample_id", "umi_a", "umi_b").agg(F.max("fwd_reads").alias("f"), F.max("rev_reads").alias("r"))
    want = parsed.groupBy("sample_id", "umi_a", "umi_b").agg(F.count_if(F.col("strand") == "Forward").alias("f"), F.count_if(F.col("strand") == "Reverse").alias("r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scoring_extras(spark):
    t = spark.createDataFrame([("a", 10), ("a", 50)], "chrom string, pos long")
    c = spark.createDataFrame([("a", 15), ("a", 16), ("b", 50), ("a", 90)], "chrom string, pos long")
    r = scoring.tolerance_scores(t, c, 10).first()
    assert (r.tp, r.fn, r.fp) == (1, 1, 2)
    assert {x.n for x in calls.near_matches(t, c, 10, "inner").groupBy("pos").agg(F.count("*").alias("n")).collect()} == {2}
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert [x.quintile for x in ml.quintile(df, "v").orderBy("v").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


QUICK = ("kmer_codes", "parse_drop_stats", "family_types", "fingerprint_compat", "ssc_consensus", "duplex_consensus", "call_filter", "ti_exact", "nearest_partner", "path_ranking", "concordance", "ml_metrics", "bnd_pairs", "explore_histogram", "minimal_alleles", "variant_classes", "alt_windows", "junction_sequences", "molecule_columns", "log_variants_filtered", "qc_assembly", "ti_sequence_listed", "calls_tsv", "calls_vcf", "fasta_targets", "fastq_pairs", "stage_tables", "qc_files")


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    relation = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in relation.description]
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted(tuple(norm(v) for v in (float(x) if type(x).__name__ == "Decimal" else x for x in r)) for r in relation.fetchall())
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(norm(v) for v in r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def _near(x, y, bits=4):
    turned = (y << 32 | y >> 32) & (1 << 64) - 1
    return bin(x ^ y).count("1") <= bits or bin(x ^ turned).count("1") <= bits


def test_umi_clusters_of_the_query(spark):
    """Each UMI pair by plain loops: most reads first, the first seed of its bucket within two letters."""
    counts = reads.umi_counts(reads.passed(queries.parsed(spark, SF))).collect()
    seeds, want = {}, set()
    for r in sorted(counts, key=lambda r: (-r.n, r.first_ord)):
        held = seeds.setdefault((r.sample_id, r.umi_a[:3]), [])
        far = lambda s, r=r: sum(a != b for a, b in zip(s[0] + s[1], r.umi_a + r.umi_b))
        seed = next((s for s in held if far(s) <= 2), None)
        if seed is None:
            seed = (r.umi_a, r.umi_b)
            held.append(seed)
        want.add((r.sample_id, r.umi_a, r.umi_b, *seed))
    got = queries.QUERIES["umi_directional_clusters"](spark, SF)
    assert {tuple(r) for r in got.select("sample_id", "umi_a", "umi_b", "seed_a", "seed_b").collect()} == want


def test_family_parts_of_the_query(spark):
    """Each read joins the first part of its family whose first read it is compatible with."""
    rows = reads.passed(queries.parsed(spark, SF)).select("sample_id", "umi_a", "umi_b", "read_ord", "fingerprint").collect()
    heads, want = {}, set()
    for r in sorted(rows, key=lambda r: r.read_ord):
        fp, held = r.fingerprint & (1 << 64) - 1, heads.setdefault((r.sample_id, r.umi_a, r.umi_b), [])
        part = next((i for i, h in enumerate(held) if _near(h, fp)), None)
        if part is None:
            part = len(held)
            held.append(fp)
        want.add((r.sample_id, r.read_ord, part))
    assert {tuple(r) for r in queries.QUERIES["family_split"](spark, SF).select("sample_id", "read_ord", "part").collect()} == want


def test_logs_written(spark, tmp_path):
    from lociframe.operators import logs

    drops = logs.reads_dropped(queries.parsed(spark, SF))
    merges = logs.umi_merges(queries.QUERIES["umi_directional_clusters"](spark, SF))
    logs.write_logs(str(tmp_path), reads_dropped=drops, umi_clustering=merges)
    n = {r.log: r.n for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert n["reads_dropped"] == drops.count() == spark.read.csv(f"{tmp_path}/reads_dropped", sep="\t", header=True).count()
    assert spark.read.text(f"{tmp_path}/full_trace").count() == sum(n.values())
    assert logs.kmers_skipped(spark.createDataFrame([("s", 1, "A" * 40), ("s", 2, "ACG"), ("s", 3, ("A" * 20 + "N") * 3)], "sample_id string, molecule_id long, seq string")).count() == 2
