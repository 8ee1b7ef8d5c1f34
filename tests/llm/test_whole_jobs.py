"""Near duplicates of the pipeline's stage against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lociframe.llm import resemblance


def shingle_set(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(data):
    sets = [shingle_set(t) for _, t in data]
    label = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = [[d for (d, _), x in zip(data, label) if x == y and d is not None] for y in label]
    return sorted(((d, t or "", min(x, default=None)) for (d, t), x in zip(data, ids)), key=repr)


def near_copies(seed, n):
    """Texts with copies of which 1 to 10 words in 300 are others: similarities from 0.7 to 0.97."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    data = []
    for _ in range(n):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), rng.randrange(1, 11)):
            other[at] = word()
        data += [" ".join(words), " ".join(other)]
    rng.shuffle(data)
    return list(enumerate(data))


def crowd(seed):
    """Many near copies of one text, and texts that share a long line with each other but are not similar."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    data = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(3)):
            words[at] = f"x{rng.randrange(9)}"
        data.append((i, " ".join(words)))
    return data + [(100 + i, " ".join(base[:30] + [f"y{i}z{k}" for k in range(i % 15)])) for i in range(40)] + [(None, " ".join(base)), (None, None), (7, "short"), (8, "short"), (None, "alone")]


def md5(text):
    return hashlib.md5((text or "").encode()).digest()


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, block):
    """No link that brute force hasn't, and of pairs at 0.8 or more at least 95 of 100."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    monkeypatch.setattr(resemblance, "SETS", block)
    for data in (near_copies(1, 60), crowd(2)):
        docs = spark.createDataFrame(data, "doc_id long, text string")
        texts = {md5(t): t or "" for _, t in data}
        got = sorted(((r.doc_id, texts[bytes(r.t)], r.component_id) for r in resemblance.near_duplicates(docs).collect()), key=repr)
        want = brute_components(data)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        moved = [(a, b) for a, b in zip(got, want) if a != b]
        linked = sum(x[0] != x[2] for x in want)
        assert all(a[0] == a[2] for a, _ in moved) and len(moved) <= 0.05 * linked, moved
    assert resemblance.near_duplicates(docs.limit(0)).count() == 0


def met(rng, common, left, right):
    """Whether two sets share a key and stay within all chains' budgets."""
    pool = rng.integers(-(1 << 63), (1 << 63) - 1, common + left + right, dtype=np.int64)
    sets = [np.unique(pool[: common + left]), np.unique(np.concatenate([pool[:common], pool[common + left :]]))]
    bits = [resemblance.wide(s) for s in sets]
    shared = set.intersection(*(set(resemblance.heads(x, len(s)).tolist()) for x, s in zip(bits, sets)))
    fp = np.stack([np.packbits(x, bitorder="little").view(np.uint64) for x in bits])
    n, masks = np.array([len(s) for s in sets]), resemblance.chain_masks()
    return any(len(resemblance.close(masks, fp, n, np.array([k >> 16] * 2), np.array([0]), np.array([1]))[0]) for k in shared)


@pytest.mark.parametrize(
    ("common", "left", "right", "least"),
    [(4, 1, 0, 0.9), (6, 1, 0, 0.97), (8, 1, 1, 0.97), (12, 3, 0, 0.95), (12, 2, 1, 0.95), (20, 2, 3, 0.95), (40, 5, 5, 0.95), (52, 13, 0, 0.9), (60, 8, 7, 0.9), (100, 12, 13, 0.9), (200, 25, 25, 0.9), (270, 15, 15, 0.98)],
)
def test_recall_by_size(common, left, right, least):
    """Pairs at a similarity of 0.8 and above meet, with all filters on, whatever their size."""
    rng = np.random.default_rng(common)
    assert sum(met(rng, common, left, right) for _ in range(200)) >= least * 200


def test_stage_takes_near_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline

    data = near_copies(3, 60)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    want = {c for _, _, c in brute_components(data)}
    assert want <= kept and len(kept - want) <= 3
