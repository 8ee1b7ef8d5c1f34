"""Merkle manifest, signature trees and kd-trees against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lociframe.llm import kd_clusters, merkle, signature_join
from lociframe.llm.numbering import numbered

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append((at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else None))
        at >>= 1
    return out


def folded(node, way):
    for right, sibling in way:
        node = H(node) if sibling is None else H(sibling, node) if right else H(node, sibling)
    return node


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        own[g] = levels_of([leaf(*r) for r in groups[g]])
    shared = levels_of([own[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = siblings_of(own[g], i) + siblings_of(shared, k)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            found = folded(leaf(*r[:3], r[3] + 1, r[4]) if hit else leaf(*r), way)
            root = shared[-1][0]
            out.append((r[0], leaf(*r), own[g][-1][0], root, H(*(s for _, s in way if s is not None)), found, found == root))
    return sorted(out, key=repr)


def manifest_rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i * 3 % 1009 if i % 50 else None, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, 5, i]), rng.choice(["é" * (i % 9), "", None, f"t{i}"])) for i in range(n)]


@pytest.mark.parametrize(
    ("n", "langs"), [(0, ["x"]), (1, [None]), (5, ["x", None, "é"]), (700, ["x", "x", "x", "y", None]), (600, [f"l{i}" for i in range(300)] + ["="])]
)
def test_manifest(spark, tmp_path, n, langs):
    rows = manifest_rows(n, langs)
    df = spark.createDataFrame([(*r, "more") for r in rows], DOCS + ", leaf string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("n", [*range(1, 18), 31, 100, 255, 256])
def test_traversal(n):
    leaves = [merkle.digest(str(i).encode()) for i in range(n)]
    levels = levels_of([x.decode() for x in leaves])
    paths = list(merkle.traverse(leaves, len(levels) - 1 if n > 1 else 0)) if n else []
    # Siblings are lists that the traversal goes on to change, so they are taken one by one.
    walk = merkle.traverse(leaves, len(levels) - 1)
    for i in range(n):
        assert [s.decode() if s else None for s in next(walk)] == [s for _, s in siblings_of(levels, i)]
    assert next(walk).decode() == levels[-1][0] and len(paths) == n + 1


def test_traversal_memory():
    """No stack holds more than one node per level, and none is finished late."""
    leaves, most, late = [merkle.digest(str(i).encode()) for i in range(256)], [], []

    class Seen(merkle.Builder):
        def step(self):
            super().step()
            most.append(len(self.stack))

        def node(self):
            late.append((self.level, not self.done and self.next > self.index_start))
            return super().node()

        def __init__(self, level, index, leaves):
            self.index_start = index << level
            super().__init__(level, index, leaves)

    before, merkle.Builder = merkle.Builder, Seen
    try:
        list(merkle.traverse(leaves, 8))
    finally:
        merkle.Builder = before
    assert max(most) <= 9 and not any(x for _, x in late[16:-1])


def test_verify(spark):
    rows = manifest_rows(400, ["x", "y"], seed=4)
    df = spark.createDataFrame(rows, DOCS)
    columns = list(merkle.COLUMNS)
    found = merkle.manifest(df, "doc_id", "lang", columns)
    changed = [(*r[:4], (r[4] or "") + "!") if (r[0] or 0) % 10 == 3 else r for r in rows] + [(99999, "a", "x", 1, "new")]
    got = merkle.verify(spark.createDataFrame(changed, DOCS), found, "doc_id", columns).collect()
    assert len(got) == 401
    want = {}
    known = {(r[0], leaf(*r)) for r in rows if r[0] is not None}
    for r in changed:
        want.setdefault(r[0], []).append((r[0], leaf(*r)) in known)
    have = {}
    for r in got:
        have.setdefault(r.key, []).append(r.valid)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aabc"), rng.choice([None, 1, 2, i]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, i long, w long").repartition(5)
    got = {r.i: (r.place, r.total) for r in numbered(df, "g", ["k", "i"], df.w).collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        done = 0
        for r in own:
            assert got[r[2]] == (done, sum(x[3] for x in own))
            done += r[3]


# --- signature trees


def word_set(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_similar(data):
    sets = [word_set(t) for _, t in data]
    label = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = [[d for (d, _), x in zip(data, label) if x == y and d is not None] for y in label]
    return sorted(((d, len(s), d if not s else min(x, default=None)) for (d, _), s, x in zip(data, sets, ids)), key=repr)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"n{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"n{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def likely(seed, n=60):
    """Texts of 1 to 400 words with edited copies about the limit, chains of edits, and a shared long line."""
    rng = random.Random(seed)
    line = [f"line{i}" for i in range(40)]
    data = []
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 11, 12, 13, 20, 30, 50, 100, 200, 400]))]
        if rng.random() < 0.3:
            words = line + words
        data.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = edited(rng, words, rng.randrange(1 + len(words) // 40 + 1))
            data.append(" ".join(words))
    rng.shuffle(data)
    return [(i, t) for i, t in enumerate(data)]


def joined(spark, data):
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, h string").repartition(3)
    return sorted((tuple(r) for r in signature_join.similar_documents(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    data = likely(seed) + [(None, None), (5, ""), (None, "a b c d"), (None, "A b C d"), (7, "same words here"), (7, "same words here"), (7, "other"), (8, " \t ")]
    assert joined(spark, data) == brute_similar(data)


def test_join_of_blocks(spark, monkeypatch):
    """Clusters of several blocks: chains whose ends aren't similar, in blocks of a few sets."""
    rng = random.Random(3)
    words, data = [f"w{i}" for i in range(60)], []
    for i in range(60):
        data.append((i, " ".join(words)))
        words = edited(rng, words, 1)
    monkeypatch.setattr(signature_join, "BLOCK_BITS", 9)
    monkeypatch.setattr(signature_join, "LEAST", 64)
    many = data + [(100 + i, " ".join(edited(rng, data[0][1].split(), 1))) for i in range(40)]
    assert joined(spark, many) == brute_similar(many)


def test_join_empty(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]


def test_buckets_lose_no_pair():
    """Random sets at the limit of similarity share a key at every size."""
    rng = np.random.default_rng(1)
    for n in [9, 10, 18, 19, 20, 37, 38, 57, 95, 100, 190, 500, 1234, 5000]:
        for _ in range(20):
            m = int(rng.integers(n, n * 100 // 90 + 1))
            most = (n + m) * 10 // 190
            differ = most - (n + m - most) % 2
            common = (n + m - differ) // 2
            if differ < m - n or 100 * common < 90 * (n + m - common):
                continue
            pool = rng.integers(-(1 << 63), 1 << 63, n + m, dtype=np.int64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : n + m - common]]))
            assert len(np.intersect1d(signature_join.bucket_keys(a), signature_join.bucket_keys(b)))


def test_tree_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, int(rng.integers(5, 200)))
        sets += [np.unique(base), np.unique(np.concatenate([base[: len(base) - len(base) // 20], rng.integers(0, 1 << 62, len(base) // 25)]))]
    sets.sort(key=len)
    offsets = np.cumsum([0, *map(len, sets)])
    a, b = signature_join.SignatureTree(np.concatenate(sets), offsets, np.arange(len(sets))).pairs(90, 100)
    kept = set(zip(a.tolist(), b.tolist()))
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= kept and len(kept) < len(sets) * (len(sets) - 1) / 8


# --- kd-trees


def brute_clusters(rows):
    kept = [(i, [math.floor(256 * max(min(x, 2**18), -(2**18))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:40]
    centroids = [v for _, v in first]
    if not centroids:
        return []
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(6):
        own = [min((d2(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
        if r == 5:
            break
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    each = [sum(d for d, c in own if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, each[c], sum(each), sha[c]) for (i, _), (d, c) in zip(kept, own)), key=repr)


def clustered(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = kd_clusters.cluster(df, "vec_id", "embedding").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_clusters(spark):
    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middles)]) for i in range(400)]
    same = [0.5] * 64
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(None, same), (3, rows[3][1]), (3, same), (2000, None), (2001, [0.1] * 63), (2002, [*[0.1] * 63, None]), (2003, [*[0.1] * 63, math.nan]), (2004, [*[0.1] * 63, math.inf]), (2005, [1e300] + [-1e4] * 63)]
    assert clustered(spark, rows) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [i / 7] * 64) for i in range(n)] + [(None, [0.3] * 64)] * (n > 1)
    assert clustered(spark, rows) == brute_clusters(rows)


def test_owners_drop_and_keep():
    """Every centroid that is nearest to some vector of a leaf stays, and far apart clusters leave one."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-4000, 4000, (40, 8))
    x = centroids[rng.integers(0, 40, 3000)] + rng.integers(-40, 41, (3000, 8))
    order, starts = kd_clusters.kd_order(x)
    x = x[order]
    counts = np.diff([*starts, len(x)])
    assert sorted(order) == list(range(3000)) and counts.max() <= kd_clusters.LEAF
    alive = kd_clusters.owners(np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), centroids)
    own = ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.repeat(alive, counts, axis=0)[np.arange(3000), own].all()
    assert (alive.sum(axis=1) == 1).mean() > 0.5
