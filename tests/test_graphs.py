"""Walks over chains, stretches off the reference, and orders by ranges."""

import random

import pytest

from lociframe.operators import calls, graph, ranges, unitigs

K = 5


def spelled_nodes(*sequences, k=K):
    counts = {}
    for s in sequences:
        for i in range(len(s) - k + 1):
            counts[s[i : i + k]] = counts.get(s[i : i + k], 0) + 1
    return counts


def letters(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def changed(rng, s):
    at, kind = rng.randrange(len(s)), rng.randrange(3)
    return s[:at] + {0: rng.choice("ACGT"), 1: "", 2: rng.choice("ACGT") + s[at]}[kind] + s[at + 1 :]


def off_by_hand(reference, counts, max_length):
    """All stretches, by trying every simple walk."""
    out, n = set(), len(reference)
    first = {}
    for j in range(n - 1, -1, -1):
        first.setdefault(reference[j], []).append(j)

    def go(i, path):
        last = path[-1] if path else reference[i]
        for b in "ACGT":
            x = last[1:] + b
            if x not in counts or (not path and x == reference[i + 1]):
                continue
            if x in first:
                j = min((j for j in first[x] if j > i), default=None)
                if j is not None and i + 1 + len(path) + n - j <= max_length:
                    out.add((i, j, tuple(path)))
            elif x not in path and len(path) < max_length:
                go(i, [*path, x])

    for i in range(n - 1):
        if reference[i] in counts:
            go(i, [])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_off_reference(seed):
    rng = random.Random(seed)
    seq = letters(rng, 30)
    counts = spelled_nodes(seq, *(changed(rng, seq) for _ in range(4)))
    reference = [seq[i : i + K] for i in range(len(seq) - K + 1)]
    got, spent = graph.off_reference(reference, counts, len(reference) + 4)
    assert not spent and {(i, j, tuple(p)) for i, j, p in got} == off_by_hand(reference, counts, len(reference) + 4) and len(got) == len(set((i, j, tuple(p)) for i, j, p in got))


def test_budgets_of_branches():
    """A branch that spends its own budget does not keep others from being walked."""
    rng = random.Random(5)
    seq = letters(rng, 40)
    tangle = [letters(rng, 60) for _ in range(6)]
    counts = spelled_nodes(seq, *(changed(rng, seq) for _ in range(3)), seq[:9] + tangle[0], tangle[0] + seq[20:], *(a + b for a in tangle for b in tangle))
    reference = [seq[i : i + K] for i in range(len(seq) - K + 1)]
    whole, _ = graph.off_reference(reference, counts, len(reference) + 3)
    some, spent = graph.off_reference(reference, counts, len(reference) + 60, sub_expansions=40)
    none, out = graph.off_reference(reference, counts, len(reference) + 60, max_expansions=5)
    assert spent and out and {(i, j) for i, j, _ in some} and len(none) <= len(some)
    assert whole


def test_spent_walk_is_filled(spark):
    """What a walk's budget leaves out, the branches' own walks find."""
    rng = random.Random(8)
    seq, k = letters(rng, 60), 13
    one = seq[:40] + ("A" if seq[40] != "A" else "C") + seq[41:]
    counts = spelled_nodes(seq, one, k=k)
    nodes = spark.createDataFrame([("s", "t", x, n) for x, n in counts.items()], "sample_id string, target_id string, kmer string, n long")
    targets = spark.createDataFrame([("t", seq)], "target_id string, seq string")
    full = {r.path_seq for r in graph.walk_paths(targets, nodes, k).collect()}
    short = graph.walk_paths(targets, nodes, k, max_expansions=55).collect()
    assert full == {seq, one} == {r.path_seq for r in short} and all(r.budget_hit for r in short) and sum(r.is_reference for r in short) == 1
    found = graph.find_alternatives(targets, nodes, k).collect()
    assert [(r.path_seq, r.left, r.right) for r in found] == [(one, 27, 41)]


def graphs(seed, n=12):
    rng = random.Random(seed)
    targets, nodes = [], []
    for t in range(n):
        seq = letters(rng, rng.choice([4, 20, 40, 60]))
        name = f"t{t}" + ("_maxpath30" if t % 5 == 4 else "")
        targets.append((name, seq))
        if t % 4 == 3:
            seq = seq[rng.randrange(4) :]
        for s in "ab"[: 1 + t % 2]:
            counts = spelled_nodes(seq, *(changed(rng, seq) for _ in range(3)), "ACGTACGTACGTA" if t % 3 else "")
            nodes += [(s, name, k, c) for k, c in counts.items()]
    return targets, nodes


@pytest.mark.parametrize("seed", [1, 2])
def test_unitig_walk(spark, seed):
    targets, nodes = graphs(seed)
    t, n = spark.createDataFrame(targets, "target_id string, seq string"), spark.createDataFrame(nodes, "sample_id string, target_id string, kmer string, n long")
    rows = lambda df: sorted((r.sample_id, r.target_id, r.path_seq, r.is_reference, r.n_kmers) for r in df.collect())
    got, want = rows(unitigs.walk_paths(t, n, K, max_paths=10**6)), rows(graph.walk_paths(t, n, K, max_paths=10**6))
    assert got == want and len(want) > 20


def test_unitigs_hold_all(spark):
    """Chains have each k-mer once, but for rings that nothing leads into."""
    targets, nodes = graphs(3)
    nodes.append(("a", "t0", "AAAAA", 2))
    t, n = spark.createDataFrame(targets, "target_id string, seq string"), spark.createDataFrame(nodes, "sample_id string, target_id string, kmer string, n long")
    chains = unitigs.unitigs(n, unitigs.anchors(t, n, K), K).collect()
    seen = [(r.sample_id, r.target_id, r.seq[i : i + K]) for r in chains for i in range(r.n_kmers)]
    assert len(seen) == len(set(seen)) and set(seen) <= {x[:3] for x in nodes} and ("a", "t0", "AAAAA") in seen
    assert all(r.seq.startswith(r.head) and r.seq.endswith(r["last"]) and len(r.seq) == r.n_kmers + K - 1 for r in chains)
    assert len(chains) < len(nodes) / 3


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, n long, i long").repartition(7)
    from pyspark.sql import functions as F

    got = {r.i: r.rank for r in ranges.ranked(df, ["g"], F.desc("n"), "i").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


def test_nearest_over_ranges(spark):
    rng = random.Random(2)
    left = [(i, rng.choice(["x", "x", "y", "z"]), rng.randrange(500)) for i in range(200)]
    right = [(rng.choice(["x", "y"]), rng.randrange(-200, 700), rng.randrange(9)) for _ in range(20)]
    got = {r.id: r.depth for r in calls.nearest(spark.createDataFrame(left, "id long, chrom string, mid long").repartition(5), spark.createDataFrame(right, "chrom string, mid long, depth long"), "depth").collect()}
    for i, c, m in left:
        own = [(abs(m - x), x, d) for y, x, d in right if y == c]
        assert got[i] == (min(own)[2] if own else None)


def test_chains_of_any_size(spark, monkeypatch):
    """Graphs that a task holds need no joins of k-mers; larger ones have the same chains by joins."""
    targets, nodes = graphs(4)
    nodes += [("a", "t0", "AAAAA", 2), ("b", "none", "CCCCC", 1), *(("a", "ring", x, 1) for x in spelled_nodes("ACGTTACGTT"))]
    t, n = spark.createDataFrame(targets, "target_id string, seq string"), spark.createDataFrame(nodes, "sample_id string, target_id string, kmer string, n long")
    ends = unitigs.anchors(t, n, K)
    rows = lambda df: sorted(map(tuple, df.select("sample_id", "target_id", "head", "last", "seq", "n_kmers", "n").collect()))
    joined = unitigs.joined_chains
    want = rows(joined(n, ends.select("sample_id", "target_id", "start", "end"), K))
    calls = []
    monkeypatch.setattr(unitigs, "joined_chains", lambda *a: calls.append(1) or joined(*a))
    assert rows(unitigs.unitigs(n, ends, K)) == want and not calls
    monkeypatch.setattr(unitigs, "HELD", 40)
    assert rows(unitigs.unitigs(n, ends, K)) == want and calls
    assert len(want) > 40


def test_index_of_nodes(spark):
    """The nodes' counts make the index of all molecules, over targets that share k-mers, turned or not."""
    from pyspark.sql import functions as F

    from lociframe.operators import kmers
    from lociframe.plans import inputs

    rng = random.Random(3)
    one = "".join(rng.choice("ACGT") for _ in range(45))
    turned = one[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = [one, turned, one[:35], "ACGTACGT" * 6, "AC", one[:20] + "N" + one[20:]]
    rows = [("s" if i % 3 else "t", f"t{i % 4}", i, rng.choice(seqs)) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, target_id string, molecule_id long, seq string").withColumn("family_type", inputs.family(F.col("molecule_id")))
    names = ["sample_id", "kmer", "n_molecules", "n_duplex", "n_simplex_fwd", "n_simplex_rev"]
    got = graph.index_of_nodes(graph.own_nodes(df)).select(*names).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, kmers.index_of(df).select(*names).collect()))


@pytest.mark.parametrize("coded", [False, True])
@pytest.mark.parametrize("keys", [["sample_id"], []])
def test_path_evidence_by_target(spark, coded, keys):
    """Figures of each path are those of its k-mers, one by one; a path given twice counts once, and no path of a target is sorted or joined k-mer by k-mer."""
    from pyspark.sql import functions as F

    from lociframe.functions.codes import kmer_code

    rng, k = random.Random(4), 5
    turn = lambda s: min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    paths = [(*("s" for _ in keys), f"t{i % 3}", letters(rng, rng.randrange(4, 14)) + rng.choice(["", "N", "acgtac"]), i % 4 == 0) for i in range(24)]
    paths = list(dict.fromkeys(paths))
    seen = {turn(p[-2][i : i + k].upper()) for p in paths for i in range(len(p[-2]) - k + 1)}
    index = {m: (rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.randrange(8) / 8) for m in sorted(seen) if "N" not in m and rng.random() < 0.8}
    df = spark.createDataFrame([(*("s" for _ in keys), m, *v) for m, v in index.items()], "".join(f"{c} string, " for c in keys) + "kmer string, n_molecules long, n_duplex long, n_simplex_fwd long, n_simplex_rev long, mean_err double")
    df = df.withColumn("kmer", kmer_code(F.col("kmer"), k)) if coded else df
    found = graph.path_evidence(spark.createDataFrame(paths + paths[:5], "".join(f"{c} string, " for c in keys) + "target_id string, path_seq string, is_reference boolean"), df, k, keys)
    own = lambda p: [m for m in (turn(p[-2][i : i + k].upper()) for i in range(len(p[-2]) - k + 1)) if "N" not in m]
    want = []
    for p in paths:
        mine, ref = own(p), {m for q in paths if q[-1] and q[-3] == p[-3] for m in own(q)}
        if mine:
            v = [index.get(m, (0, 0, 0, 0, 0.0)) for m in mine]
            new = [x for m, x in zip(mine, v) if m not in ref] or v
            mean = lambda rows, i: sum(r[i] for r in rows) / len(rows)
            low = [min(r[i] for r in v) for i in range(4)]
            want.append((*p, low[0], mean(v, 0), low[1], mean(v, 1), low[2], low[3], mine[[r[0] for r in v].index(low[0])], mean(v, 4), min(r[1] for r in new), mean(new, 0)))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "path_seq" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_index_of_nodes_by_codes(spark):
    from lociframe.functions.codes import spelled_codes

    rng = random.Random(5)
    rows = [("s", "t", s[i : i + 31], 1, 0, 1, 0) for s in (letters(rng, 80) for _ in range(3)) for i in range(50)]
    nodes = spark.createDataFrame(rows, "sample_id string, target_id string, kmer string, n long, n_duplex long, n_simplex_fwd long, n_simplex_rev long")
    coded = graph.index_of_nodes(nodes, coded=True)
    assert sorted(map(tuple, coded.withColumn("kmer", spelled_codes(coded.kmer, 31)).collect())) == sorted(map(tuple, graph.index_of_nodes(nodes).collect()))
