"""What must not grow with the input: what is sent whole to tasks, rows of a task, bytes of a k-mer."""

import random
import re

from pyspark.sql import functions as F

from lociframe.functions import codes
from lociframe.functions import sequence as S
from lociframe.operators import calls, graph, kmers, reads
from lociframe.plans import inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_an_index_is_never_sent_whole(spark):
    rows = spark.createDataFrame([("s", "ACGTA", "Duplex")], "sample_id string, kmer string, family_type string")
    assert "BroadcastHashJoin" not in plan(kmers.lookup(rows.select("sample_id", "kmer"), kmers.evidence(rows)))


def test_codes_are_the_kmers(spark, monkeypatch):
    rng = random.Random(1)
    seqs = [(i, dna(rng, rng.choice([0, 3, 30, 31, 40, 200]), "ACGTacgtN" if i % 3 else "ACGT")) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    monkeypatch.setattr(codes, "PIECE", 50)
    for k in (1, 2, 7, 31):
        want = sorted(map(tuple, S.explode_kmers(df, "seq", k).select("id", "kmer").collect()))
        got = S.explode_codes(df, "seq", k)
        assert sorted(map(tuple, got.select("id", codes.spelled_codes(F.col("kmer"), k)).collect())) == want
        once = S.explode_codes(df, "seq", k, distinct=True).select("id", codes.spelled_codes(F.col("kmer"), k))
        assert sorted(map(tuple, once.collect())) == sorted(set(want))


def test_errors_of_coded_kmers(spark):
    rng = random.Random(2)
    rows = [(i, dna(rng, 40), [rng.random() if rng.random() < 0.9 else None for _ in range(rng.choice([0, 10, 40, 50]))]) for i in range(20)] + [(20, dna(rng, 9), None)]
    df = spark.createDataFrame(rows, "id long, seq string, err array<double>")
    want = sorted(map(tuple, kmers.read_kmers(df, 8).select("id", "kmer", "err").collect()))
    got = S.explode_codes(df, "seq", 8, "err").select("id", codes.spelled_codes(F.col("kmer"), 8), "err")
    assert sorted(map(tuple, got.collect())) == want


def test_index_by_codes(spark):
    rng = random.Random(3)
    seqs = [dna(rng, 50) for _ in range(4)]
    df = spark.createDataFrame([("s", i % 7, "Duplex" if i % 7 else "SimplexRev", rng.choice(seqs)) for i in range(30)], "sample_id string, molecule_id long, family_type string, seq string")
    for distinct in (False, True):
        want = kmers.evidence(S.explode_kmers(df, "seq", 31), distinct=distinct)
        assert sorted(map(tuple, kmers.index_of(df, 31, distinct=distinct).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_coded_nodes_are_the_nodes(spark):
    rng = random.Random(4)
    target = dna(rng, 60)
    targets = spark.createDataFrame([("t", target)], "target_id string, seq string")
    df = spark.createDataFrame([("s", i, target[:30] + dna(rng, 30) if i % 2 else dna(rng, 60)) for i in range(12)] * 2, "sample_id string, molecule_id long, seq string")
    rows = lambda nodes: sorted(map(tuple, nodes.select("sample_id", "target_id", "kmer", "n").collect()))
    want = rows(graph.target_nodes(targets, S.explode_kmers(df, "seq", 11, raw="raw"), 11))
    assert want and rows(graph.target_nodes(targets, S.explode_codes(df, "seq", 11), 11)) == want


def test_walks_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(5)
    targets = [(f"t{i}", dna(rng, 40)) for i in range(40)]
    t = spark.createDataFrame(targets, "target_id string, seq string")
    nodes = spark.createDataFrame([("s", n, s[j : j + 31], 1) for n, s in targets for j in range(10)], "sample_id string, target_id string, kmer string, n long")
    monkeypatch.setattr(graph, "DEALT", 20)
    found = graph.walk_paths(t, nodes)
    assert sorted(r.path_seq for r in found.collect()) == sorted(s for _, s in targets)
    assert found.select(F.spark_partition_id()).distinct().count() > 8


def test_umi_pairs_of_any_cut(spark, monkeypatch):
    """More segments are taken for more UMIs; whichever, the pairs are those of all with all."""
    from lociframe.operators import reads, umis

    rng = random.Random(6)
    texts = {dna(rng, 8, "AC" if i % 2 else "ACGTNé") for i in range(60)}
    rows = [("s", t[:4], t[4:], rng.randrange(3), i) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "sample_id string, umi_a string, umi_b string, n long, first_ord long")
    place = {r[1] + r[2]: (-r[3], r[4]) for r in rows}
    apart = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((a, b, apart(a, b)) for a in place for b in place if place[a] < place[b] and apart(a, b) <= 2)
    for parts in (3, 4, 5):
        monkeypatch.setattr(umis, "parts_for", lambda rows, length, distance: parts)
        assert sorted((r.umi_a_1 + r.umi_b_1, r.umi_a_2 + r.umi_b_2, r.distance) for r in umis.neighbours(df, 2).collect()) == want
    near = sorted((a, b, apart(a, b)) for a in place for b in place if a < b and a[:3] == b[:3] and apart(a, b) <= 2)
    assert sorted((r.umi_a_1 + r.umi_b_1, r.umi_a_2 + r.umi_b_2, r.distance) for r in reads.umi_neighbours(df, 2).collect()) == near


def test_more_umis_more_segments():
    from lociframe.operators import umis

    assert [umis.parts_for(n, 24, 3) for n in (1000, 100_000, 10_000_000)] == [4, 5, 6]


def test_equal_molecules_are_cut_once(spark):
    """K-mers are cut after molecules of one sequence met; counts are those of all molecules."""
    rng = random.Random(7)
    seqs = [dna(rng, 50) for _ in range(3)] + ["ACGTACGT" * 6, "ACG"]
    rows = [("s", f"t{i % 2}", rng.choice(seqs)) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id string, target_id string, seq string")
    want = {}
    for s, t, x in rows:
        for i in range(len(x) - 30):
            want[s, t, x[i : i + 31]] = want.get((s, t, x[i : i + 31]), 0) + 1
    nodes = graph.own_nodes(df)
    assert {(r.sample_id, r.target_id, r.kmer): r.n for r in nodes.collect()} == want
    assert re.search(r"keys=\[sample_id#\d+, target_id#\d+, seq#\d+\]", plan(nodes))


def test_reads_are_worked_out_once(spark):
    """Conditions on reads don't repeat the digests that reads are made of."""
    parsed = reads.parse_reads(inputs.reads(spark, "/root/testdata/sf0.001"))
    for df in (reads.passed(parsed), reads.dropped(parsed)):
        conditions = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
        assert conditions and not any("md5" in x for x in conditions)


def test_low_quality_of_any_text(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n\n\n\n", "5é", "é4", *("".join(chr(rng.randrange(33, 75)) for _ in range(rng.randrange(1, 9))) for _ in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, q string")
    for n, least in ((5, 20), (3, 1), (12, 41)):
        got = {r.i: r.low for r in df.select("i", reads.low_quality(F.col("q"), n, least).alias("low")).collect()}
        assert [got[i] for i in range(len(texts))] == [None if t is None else t == "" or any(ord(c) - 33 < least for c in t[:n]) for t in texts]
    assert "split" not in plan(df.where(reads.low_quality(F.col("q"), 5, 20)))


def test_sequences_are_searched_by_codes(spark, monkeypatch):
    """Places of whole targets, whether hits are few or many; no letters are cut for it."""
    rng = random.Random(9)
    targets = [("a", dna(rng, 40)), ("b", dna(rng, 31)), ("c", "ACGT" * 9), ("short", "ACGTA"), ("n", "N" + dna(rng, 40)), ("late", dna(rng, 35) + "N" + dna(rng, 4))]
    turned = targets[0][1][::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = [(i, "".join(rng.choice([dna(rng, 9), turned, "N", *(t for _, t in targets), targets[0][1][:35]]) for _ in range(rng.randrange(5)))) for i in range(80)] + [(99, None)]
    want = sorted((i, n, p) for i, s in seqs for n, t in targets for p in range(len(s or "")) if len(t) >= 31 and t[0] != "N" and s.startswith(t, p))
    t, df = spark.createDataFrame(targets, "target_id string, seq string"), spark.createDataFrame(seqs, "id long, seq string")
    for few in (calls.FEW, 0):
        monkeypatch.setattr(calls, "FEW", few)
        found = calls.containing(df, t, "id")
        assert sorted(map(tuple, found.collect())) == want and "Generate" not in plan(found)
    assert len(want) > 50


def test_molecules_near_targets_are_cut_again(spark, monkeypatch):
    rng = random.Random(10)
    target = dna(rng, 60)
    targets = spark.createDataFrame([("t", target), ("u", target[20:] + dna(rng, 20))], "target_id string, seq string")
    df = spark.createDataFrame([("s", i, target[:30] + dna(rng, 30) if i % 2 else dna(rng, 60)) for i in range(12)] * 2, "sample_id string, molecule_id long, seq string")
    coded = S.explode_codes(df, "seq", 11)
    rows = lambda nodes: sorted(map(tuple, nodes.select("sample_id", "target_id", "kmer", "n").collect()))
    want = rows(graph.target_nodes(targets, coded, 11))
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert want and rows(graph.target_nodes(targets, coded, 11, molecules=df)) == want


def test_listed_kmers_meet_in_blocks(spark, monkeypatch):
    """A list's k-mers are no rows before they are distinct, and more of them meet in more parts."""
    rng = random.Random(11)
    long = dna(rng, codes.PIECE + 5000)
    seqs = [(dna(rng, rng.choice([0, 3, 30, 31, 40, 200]), "ACGTacgtN" if i % 3 else "ACGT"),) for i in range(60)] + [(None,), (long,), (long[:700],), ("ACGT" * 50,)]
    df, other = spark.createDataFrame(seqs * 2, "seq string"), spark.createDataFrame([(long[50:90],), (dna(rng, 60),)], "seq string")
    for k in (7, 31):
        want = S.explode_kmers(df.union(other), "seq", k).select("kmer").distinct()
        digest = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("kmer").cast("decimal(38,0)"))).first()
        for most in (kmers.A_PART, 100_000):
            monkeypatch.setattr(kmers, "A_PART", most)
            for letters in (None, 9_000_000):
                assert digest(kmers.allowlist(df, other, k=k, letters=letters)) == digest(want)
            coded = kmers.allowlist(df, other, k=k, coded=True)
            assert kmers.is_coded(coded) and digest(kmers.spelled(coded, k)) == digest(want)
    found = plan(kmers.allowlist(df, other))
    assert "Generate" not in found and not re.search(r"keys=\[kmer|hashpartitioning\(kmer", found)
    sizes = codes.dealt_codes(df, "seq", 31, 20).groupBy("part").agg(F.sum(F.octet_length("codes") / 8).alias("n")).collect()
    assert len(sizes) == 20 and max(r.n for r in sizes) < 1.1 * sum(r.n for r in sizes) / 20
    assert kmers.allowlist(df.where("false")).collect() == []


def test_umi_pairs_of_all_buckets(spark):
    """The query's pairs are those of all with all, whichever of their bases differ."""
    from lociframe.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    counts = [(r.sample_id, r.umi_a, r.umi_b) for r in QUERIES["canonical_umi_counts"](spark, sf).collect()]
    apart = lambda x, y: sum(p != q for p, q in zip(x[1] + x[2], y[1] + y[2]))
    want = sorted((*x, *y[1:], apart(x, y)) for x in counts for y in counts if x[0] == y[0] and x < y and apart(x, y) <= 3)
    assert any(w[1][:3] != w[3][:3] for w in want)
    assert sorted(map(tuple, QUERIES["umi_hamming_pairs"](spark, sf).collect())) == want


def test_short_umi_pairs_of_any_text(spark, monkeypatch):
    """UMIs of other lengths are no neighbours; many letters, samples, orders and small pieces change nothing."""
    from lociframe.operators import reads, umis

    rng = random.Random(9)
    monkeypatch.setattr(umis, "AT_ONCE", 50)
    for letters, d in (("ACGT", 3), ("ACN", 1), ("ABCDEFGHIJKLMNOPQRSTé", 4), ("AC", 0)):
        texts = sorted({(rng.choice("st"), dna(rng, a, letters), dna(rng, b, letters)) for _ in range(50) for a, b in ((3, 2), (2, 3), (5, 5), (1, 0))})
        rows = [(*t, rng.randrange(3), i) for i, t in enumerate(texts)] + [("s", None, "A", 1, 999)]
        df = spark.createDataFrame(rows, "sample_id string, umi_a string, umi_b string, n long, first_ord long")
        apart = lambda x, y: sum(p != q for p, q in zip(x[1] + x[2], y[1] + y[2]))
        near = [(x, y, apart(x, y)) for x in rows[:-1] for y in rows[:-1] if x[0] == y[0] and len(x[1]) == len(y[1]) and len(x[2]) == len(y[2]) and apart(x, y) <= d]
        for by_text, place in ((True, lambda x: x[1:3]), (False, lambda x: (-x[3], x[4]))):
            found = reads.umi_neighbours(df, d, bucketed=False) if by_text else umis.neighbours(df, d)
            assert sorted(map(tuple, found.collect())) == sorted((*x, *y[1:], n) for x, y, n in near if place(x) < place(y))
