"""Passage removal against a brute-force dictionary of windows."""

import random

import pytest

from lociframe.llm import suffix_dedup as op

SF = "/root/testdata/sf0.001"


def brute(docs):
    """(doc_id, text) rows -> sorted (doc_id, n_bytes, n_removed, n_spans, kept)."""
    first, out = {}, []
    key = lambda i: -(1 << 63) if i is None else i
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (key(i), s):
                gone[s : s + 100] = b"\1" * 100
        spans = sum(x and (not k or not gone[k - 1]) for k, x in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_text)) for r in frame.collect()), key=repr)


def texts(seed):
    r = random.Random(seed)
    words = ["the", "of", "naïve", "and", "x", "stone", "bread", "11", "river"]
    passage = [" ".join(r.choice(words) for _ in range(n)) for n in (12, 25, 60, 200)]
    docs = [(k, "a" * k) for k in (98, 99, 100, 101, 150, 230)]
    docs += [(300 + k, "ab" * k) for k in (49, 50, 51, 120)]
    for i in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        parts.insert(r.randint(0, len(parts)), r.choice(passage))
        docs.append((1000 - i, " ".join(parts)))
    near = passage[3]
    for i in range(40):
        k = r.randrange(len(near))
        docs.append((2000 + i, near[:k] + "#" + near[k + 1 :]))
    docs += [(5, None), (6, ""), (7, passage[2]), (7, passage[2]), (8, passage[2]), (8, passage[1] + passage[3]), (None, passage[1]), (None, None)]
    return docs


@pytest.mark.parametrize("chunk", [1 << 20, 128, 1 << 12])
def test_removal(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    docs = texts(chunk)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(op.cleaned(frame)) == brute(docs)


def test_empty(spark):
    assert op.cleaned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, k, s, hashlib.sha256(b).hexdigest()) for i, n, k, s, b in brute(docs))
    assert sum(x[2] for x in want) > 0
    assert sorted(map(tuple, op.op7_suffix_array_dedup(spark, SF).collect())) == want


def test_rows_grow_with_the_copies(spark):
    """Near copies of one text: what the suffixes of all phrases come to is in proportion to the copies."""
    r = random.Random(9)
    base = [f"word{i}" for i in range(60)]

    def rows(n):
        docs = []
        for i in range(n):
            words = list(base)
            for at in r.sample(range(60), 3):
                words[at] = f"other{r.randrange(10**6)}"
            docs.append((i, " ".join(words)))
        frame = op._marked(spark.createDataFrame(docs, "doc_id long, text string"))
        return sum(len(x.runs) for x in op.repeated_runs(frame).collect())

    few, many = rows(200), rows(800)
    assert 2.5 * few < many < 6 * few
