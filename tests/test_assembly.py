"""Families split and called in one pass, against plain loops."""

import random

import numpy as np
import pytest

from lociframe.operators import assembly, reads, umis

READS = "sample_id string, seed_a string, seed_b string, read_ord long, fingerprint long, strand string, template_r1 string, qual_r1 string, template_r2 string, qual_r2 string, skip_r1 string"


def drawn(seed, n, pairs=6):
    """Reads of few UMI pairs: fingerprints about a few centres, one pair much deeper than the others."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(n):
        u = 0 if rng.random() < 0.5 else rng.randrange(pairs)
        fp = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            fp ^= 1 << rng.randrange(64)
        if rng.random() < 0.3:
            fp = (fp << 32 | fp >> 32) & (1 << 64) - 1
        length = rng.choice([0, 3, 8, 8, 8, 12]) if rng.random() < 0.5 else 8
        text = "".join(rng.choice("ACGTN") if rng.random() < 0.2 else "ACGT"[k % 4] for k in range(length))
        qual = "".join(chr(33 + rng.choice([2, 9, 10, 20, 37, 70])) for _ in range(rng.choice([length, length, max(0, length - 2)])))
        rows.append((rng.choice("st"), f"A{u}", f"C{u}", i * 3 % n if n % 3 else i, fp - (1 << 64) if fp >> 63 else fp, rng.choice(["Forward", "Reverse"]), text, qual, text[::-1], qual[::-1], f"k{i}"))
    return rows


def near(a, b):
    turned = (a << 32 | a >> 32) & (1 << 64) - 1
    return (a ^ b).bit_count() <= 4 or (turned ^ b).bit_count() <= 4


def brute_parts(rows):
    heads, parts = {}, {}
    for r in sorted(rows, key=lambda r: r[3]):
        own, fp = heads.setdefault(r[:3], []), r[4] % (1 << 64)
        at = next((i for i, h in enumerate(own) if near(fp, h)), None)
        if at is None:
            at = len(own)
            own.append(fp)
        parts[r[0], r[1], r[2], r[3]] = at
    return parts


def brute_call(reads_):
    n = max((len(s) for s, _ in reads_), default=0)
    if not n:
        return None
    seq, err = "", []
    for p in range(n):
        w = dict.fromkeys("ACGT", 0.0)
        for s, q in reads_:
            if p < len(s) and s[p] in w and p < len(q) and ord(q[p]) - 33 >= 10:
                w[s[p]] += 1 - 10 ** (-min(ord(q[p]) - 33, 60) / 10)
        total, best = sum(w.values()), max(w.values())
        seq += next(b for b in "ACGT" if w[b] == best) if total > 0 else "N"
        err.append(max(1 - best / total, 1e-6) if total > 0 else 1.0)
    return seq, err


def brute_called(rows):
    parts, out = brute_parts(rows), {}
    for r in sorted(rows, key=lambda r: r[3]):
        out.setdefault((*r[:3], parts[r[0], r[1], r[2], r[3]]), []).append(r)
    return {
        k: (
            sum(r[5] == "Forward" for r in v), sum(r[5] != "Forward" for r in v), v[0][3], v[0][10],
            brute_call([(r[6], r[7]) for r in v if r[5] == "Forward"]), brute_call([(r[8], r[9]) for r in v if r[5] != "Forward"]),
        )
        for k, v in out.items()
    }


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g[:4] == w[:4], k
        for a, b in zip(g[4:], w[4:]):
            assert (a is None) == (b is None)
            if b is not None:
                assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9)


def taken(df):
    side = lambda s: None if s is None else (s.seq, list(s.err))
    return {(r.sample_id, r.seed_a, r.seed_b, r.part): (r.fwd_reads, r.rev_reads, r.first_ord, r.skip, side(r.consensus_fwd), side(r.consensus_rev)) for r in df.collect()}


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_one_pass(spark, batch):
    """Whatever the batches: families end within them, at their ends and go on over many."""
    rows = drawn(1, 400)
    df = spark.createDataFrame(rows, READS)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(batch))
    try:
        same(taken(assembly.called(df)), brute_called(rows))
        parts = {(r.sample_id, r.seed_a, r.seed_b, r.read_ord): r.part for r in assembly.split_families(df).collect()}
        assert parts == brute_parts(rows)
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("deep", [20, 150])
def test_deep_families(spark, deep):
    """Families dealt over several tasks give the same."""
    rows = drawn(2, 500)
    same(taken(assembly.called(spark.createDataFrame(rows, READS), deep=deep)), brute_called(rows))


def test_whole_families(spark):
    rows = drawn(3, 60)
    got = assembly.called(spark.createDataFrame(rows, READS), bits=64)
    assert got.where("part > 0").isEmpty() and got.count() == len({r[:3] for r in rows})


def test_null_samples_are_one(spark):
    rows = [(None, *r[1:]) for r in drawn(5, 80)]
    same(taken(assembly.called(spark.createDataFrame(rows, READS))), brute_called(rows))


def test_molecules(spark):
    rows = drawn(4, 200)
    df = spark.createDataFrame(rows, READS)
    found = assembly.molecules(df, 2).collect()
    want = {k: v for k, v in brute_called(rows).items() if v[0] + v[1] >= 2}
    assert {(r.sample_id, r.seed_a, r.seed_b, r.part) for r in found} == set(want)
    for r in found:
        w = want[r.sample_id, r.seed_a, r.seed_b, r.part]
        kind = "Duplex" if w[0] and w[1] else "SimplexFwd" if w[0] else "SimplexRev"
        assert r.family_type == kind
        if kind == "Duplex" and w[4] and w[5]:
            assert len(r.duplex_consensus.seq) == min(len(w[4][0]), len(w[5][0]))
    assert len({r.molecule_id for r in found}) == len(found)
    assert assembly.molecules(df.limit(0)).count() == 0 and "skip" not in assembly.molecules(df.drop("skip_r1")).columns


def test_open_family_is_small():
    """A family of many batches is held as sums and heads only."""
    held = assembly._Open()
    for i in range(1000):
        held.add(10, i, "x", 8, np.ones((8, 4)))
    assert held.n == 10000 and held.sums.shape == (8, 4) and held.first == 0 and held.sums[0, 0] == 1000


# --- long UMIs


def greedy(rows, d):
    seeds, out = [], {}
    for s, a, b, n, first in sorted(rows, key=lambda r: (-r[3], r[4])):
        own = [x for x in seeds if x[0] == s and len(x[1]) == len(a) and len(x[2]) == len(b)]
        hit = next((x for x in own if sum(p != q for p, q in zip(x[1] + x[2], a + b)) <= d), None)
        if hit is None:
            hit = (s, a, b)
            seeds.append(hit)
        out[s, a, b] = hit[1:]
    return out


def umi_rows(seed, n, length):
    rng = random.Random(seed)
    centres = ["".join(rng.choice("ACGT") for _ in range(2 * length)) for _ in range(5)]
    found = {}
    for _ in range(n):
        u = list(rng.choice(centres))
        for _ in range(rng.randrange(5)):
            u[rng.randrange(len(u))] = rng.choice("ACGT")
        found["".join(u)] = rng.randrange(1, 9)
    return [(rng.choice("st"), u[:length], u[length:], n, i) for i, (u, n) in enumerate(found.items())] + [("s", "ACG", "T", 3, 10**6), ("s", "ACG", "A", 3, 10**6 + 1), ("s", "AC", "GT", 9, 10**6 + 2)]


@pytest.mark.parametrize(("d", "length"), [(0, 8), (1, 12), (2, 8), (3, 12)])
def test_long_umis(spark, d, length):
    """Chains of neighbours, ties and other lengths follow the greedy rule."""
    rows = umi_rows(d + 1, 150, length)
    df = spark.createDataFrame(rows, "sample_id string, umi_a string, umi_b string, n long, first_ord long")
    got = {(r.sample_id, r.umi_a, r.umi_b): (r.seed_a, r.seed_b) for r in umis.cluster_umis(df, d).collect()}
    assert got == greedy(rows, d)
    if d:
        pairs = {(r.sample_id, *sorted([(r.umi_a_1, r.umi_b_1), (r.umi_a_2, r.umi_b_2)])) for r in umis.neighbours(df, d).collect()}
        want = {
            (x[0], *sorted([x[1:3], y[1:3]])) for i, x in enumerate(rows) for y in rows[:i]
            if x[0] == y[0] and len(x[1]) == len(y[1]) and len(x[2]) == len(y[2]) and sum(p != q for p, q in zip(x[1] + x[2], y[1] + y[2])) <= d
        }
        assert pairs == want


def test_short_and_long_agree(spark):
    rows = umi_rows(9, 120, 5)[:-3]
    df = spark.createDataFrame(rows, "sample_id string, umi_a string, umi_b string, n long, first_ord long")
    one, two = umis.cluster_umis(df, 2), reads.cluster_umis(df, 2, bucketed=False)
    names = ["sample_id", "umi_a", "umi_b", "seed_a", "seed_b"]
    assert sorted(map(tuple, one.select(*names).collect())) == sorted(map(tuple, two.select(*names).collect()))


def test_a_run_merges_neighbours_of_all_buckets(spark):
    """UMIs that differ in their first bases are one family in a run."""
    from lociframe.plans import pipeline
    from lociframe.sources import files

    template = "ACGGTCATTGCAGGCTTACCGATGCAAGTC"
    umis_ = [("AACGT", "TTTCA"), ("ACCGT", "TTTCA"), ("AACGT", "TTTCA"), ("CACGT", "TTTCA"), ("GGGGG", "TTTCA")]
    rows = [("s", i, a + "TT" + template, "I" * 37, b + "TT" + template, "I" * 37) for i, (a, b) in enumerate(umis_)]
    molecules = pipeline.assemble(spark.createDataFrame(rows, files.READS))[1].collect()
    assert sorted((m.seed_a, m.fwd_reads + m.rev_reads) for m in molecules) == [("AACGT", 4), ("GGGGG", 1)]
