"""Archives, shards, SpotSigs and the pipeline."""

import gzip
import hashlib
import random
import re
import zlib

import pytest

from lociframe.llm import mixing, spotsigs, training_order, warc
from lociframe.llm.tokens import default_vocabulary, tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- WARC

PAGES = [
    (5, "http://a/", "x" * 100), (3, "http://b c\r\n", "x" * 100), (9, None, "x" * 100), (4, "u", "x" * 99), (2, "u", "x" * 99),
    (7, "é", None), (8, "", ""), (10, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 4), (None, "n", "y" * 200),
    (11, "u", "naïve\r\n\r\n" * 30), (11, "u", "naïve\r\n\r\n" * 30),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), compression)
    out = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in out} == {"record"}
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((j for j, _, h in PAGES if h == html and j is not None), default=None)
        again = len(raw) >= 100 and i is not None and i > first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)


def record(k, body=b"body"):
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def salvaged(data):
    out = list(warc.salvage(data))
    at = 0
    for _, start, end, *_ in out:
        assert start >= at or start == at or out
        at = max(at, end)
    return [int(re.search(r"\d+", x[3]["warc-record-id"])[0]) for x in out if x[0] == "record"], [(a, b) for k, a, b, *_ in out if k == "gap"]


@pytest.mark.parametrize("pack", [lambda x: x, lambda x: gzip.compress(x, mtime=0)])
def test_salvage(pack):
    parts = [pack(record(k, b"%d " % k * 50)) for k in range(6)]
    assert salvaged(b"".join(parts)) == ([0, 1, 2, 3, 4, 5], [])
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    broken = bytearray(b"".join(parts))
    broken[starts[2] + len(parts[2]) // 2] ^= 0x55
    got, gaps = salvaged(bytes(broken))
    assert [k for k in got if k != 2] == [0, 1, 3, 4, 5] and gaps == [(starts[2], starts[3])]
    cut = b"".join(parts[:3]) + parts[3][: len(parts[3]) // 2] + b"".join(parts[4:])
    got, gaps = salvaged(cut)
    assert got == [0, 1, 2, 4, 5] and len(gaps) == 1 and gaps[0][0] == starts[3]
    junk = b"junk\n" + b"".join(parts) + b"tail"
    got, gaps = salvaged(junk)
    assert got == [0, 1, 2, 3, 4, 5] and gaps == [(0, 5), (len(junk) - 4, len(junk))]
    assert salvaged(b"") == ([], []) and salvaged(b"nothing") == ([], [(0, 7)])


def test_salvage_of_a_broken_member_of_many_records():
    body = b"".join(record(k, random.Random(k).randbytes(4000)) for k in range(20))
    data = gzip.compress(body, mtime=0)
    got, gaps = salvaged(data[: len(data) // 2] + gzip.compress(record(99), mtime=0))
    assert got[-1] == 99 and got[:-1] == list(range(len(got) - 1)) and 5 < len(got) < 15 and len(gaps) == 1


def test_warc_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


# --- training order


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = training_order.slots(range(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != training_order.slots(range(n), n, key=1)).mean() > 0.9
        assert abs(sum(abs(a - b) for a, b in zip(got[1:], got)) / (n - 1) / n - 1 / 3) < 0.05


def test_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(1000, None), (None, ""), (1001, "a"), (1001, "a")], "doc_id long, text string"))
    path = str(tmp_path / "shards")
    out = training_order.materialise_order(docs, path, length=256, shard=64).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(len(out))) and [(r.shard, r.record) for r in out] == [divmod(k, 64) for k in range(len(out))]
    files = {int(p.parent.name[6:]): str(p) for p in (tmp_path / "shards").glob("shard=*/part-*")}
    assert len(files) == -(-len(out) // 64)
    by_number, np = {}, __import__("numpy")
    for r in out:
        raw = training_order.read_record(files, r.slot, length=256, shard=64)
        assert zlib.crc32(raw) == r.ids_crc32 and len(raw) == 512
        by_number[r.number] = (np.frombuffer(raw, "<u2")[: r.n_tokens], r.doc_ids)
    tok = tokenizer(default_vocabulary())
    stream = np.concatenate([by_number[k][0] for k in range(len(out))])
    want = sorted(tuple(np.frombuffer(tok.encode(r.text), "<u4").tolist()) for r in docs.collect())
    assert len(stream) == sum(map(len, want)) + len(want)
    assert {d for _, ids in by_number.values() for d in ids} == {r.doc_id for r in docs.collect()}
    cut, now = [], []
    for t in stream.tolist():
        now.append(t)
        if t == 2 and tuple(now[:-1]) in set(want):
            cut.append(tuple(now[:-1]))
            now = []
    assert sorted(cut) == want
    assert training_order.materialise_order(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_query_of_training_order(spark, tmp_path):
    """The query against plain loops: ids run together in the order of rows, cut at 2048, each sequence at its slot."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
    docs = [(r.doc_id, r.text) for r in docs] + [(None, None), (7, ""), (7, "twice"), (7, "twice")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    tok, stream, owner = tokenizer(default_vocabulary()), [], []
    for i, text in docs:
        ids = [*np.frombuffer(tok.encode(text), "<u4").tolist(), 2]
        stream += ids
        owner.append((i, len(stream) - len(ids), len(stream)))
    n = -(-len(stream) // 2048)
    want = []
    for k, slot in enumerate(training_order.slots(range(n), n).tolist()):
        part = stream[k * 2048 : (k + 1) * 2048]
        raw = np.array(part + [2] * (2048 - len(part)), "<u2").tobytes()
        inside = [i for i, a, b in owner if a < k * 2048 + len(part) and b > k * 2048]
        want.append((slot, *divmod(slot, 4096), k, inside, len(part), zlib.crc32(raw)))
    got = training_order.op2_training_order(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and n > 5


# --- SpotSigs


def brute_signatures(text):
    tokens = re.findall(r"[^\W_]+", text.lower())
    groups, group = [], []
    for t in tokens:
        if t in spotsigs.ANCHORS:
            group.append(t)
        else:
            groups.append((" ".join(group), t))
            group = []
    groups = groups or [("", t) for t in tokens]
    chains = [(g, a, groups[i + 1][1] if i + 1 < len(groups) else None) for i, (g, a) in enumerate(groups)]
    spots = [c for c in chains if c[0] and c[2]]
    return set(spots) or {c[1:] for c in chains if c[2] or len(chains) == 1}


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


def check_spotsigs(data, out):
    data = sorted(((i, t or "") for i, t in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = {r.doc_id: r for r in out}
    assert len(out) == len(data)
    by_text = {}
    for k, (i, text) in enumerate(data):
        if [j for j, _ in data].count(i) > 1:
            continue
        following = data[(k + 1) % len(data)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(brute_signatures, (text, edited, following))
        assert int(r.fingerprint.split(":")[0]) == len(a) and int(r.edited_fingerprint.split(":")[0]) == len(b)
        assert abs(r.near_edited - brute_likeness(a, b)) < 1e-9 and abs(r.near_next - brute_likeness(a, c)) < 1e-9
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_spotsigs_query(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_spotsigs(data, spotsigs.op8_spotsigs(spark, SF).collect())


def test_spotsigs_odd(spark):
    long = "the cat of hats, " * 5000
    data = [(1, ""), (2, None), (3, "the"), (5, "the the the"), (8, long), (9, long), (11, "plain words only here"), (12, "the a " * 9000), (None, "the house is red"), (20, "x"), (20, "y the z w")]
    check_spotsigs(data, spotsigs.compare_edits(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect())
    check_spotsigs([(4, "the lone text")], spotsigs.compare_edits(spark.createDataFrame([(4, "the lone text")], "doc_id long, text string")).collect())
    assert spotsigs.compare_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_pairs(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    base = [r.sample(range(10**6), n) for n in (5, 12, 40)]
    data = [sorted({x if r.random() > 0.1 else r.randrange(10**6) for x in r.choice(base)}) for _ in range(150)] + [[], [], base[1]]
    signed = spark.createDataFrame(list(enumerate(data)), "doc_id long, sigs array<long>")
    got = {(x.a, x.b): x.likeness for x in spotsigs.similar_pairs(signed).collect()}
    name = {}
    for i, s in enumerate(data):
        name.setdefault(tuple(s), i)
    want = {}
    for s, i in name.items():
        for t, j in name.items():
            if i < j and s and t and (v := len({*s} & {*t}) / len({*s} | {*t})) >= 0.8:
                want[i, j] = v
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    members = {x.doc_id: x.class_id for x in spotsigs.class_members(signed).collect()}
    assert members == {i: name[tuple(s)] for i, s in enumerate(data)}
    assert F is not None


# --- pipeline


def test_take(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    r = random.Random(1)
    data = [(i, " \n".join(f"{i}w{k}" for k in range(r.randint(0, 30))), s, 5) for i, s in enumerate(["a"] * 90 + ["b"] * 5 + [None] * 9)] + [(7, "x y z", "a", 5)] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size long")
    out = mixing.take(docs)
    assert out.columns == docs.columns
    words = {}
    for x in out.collect():
        words[x.source] = words.get(x.source, 0) + len(WORD.findall(x.text))
        whole = [d for d in data if d[0] == x.doc_id]
        assert any(d[1].startswith(x.text) for d in whole) and x.size == 5
    sized = docs.selectExpr("doc_id", "source", f"cast(regexp_count(text, '{mixing.WORD}') as long) as size") if hasattr(mixing, "WORD") else docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size"))
    target = {x.source: x.target for x in mixing.budgets(sized).collect()}
    assert all(abs(words.get(s, 0) - t) <= 4 for s, t in target.items())
    assert mixing.take(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
        assert {r.doc_id for r in docs.collect()} <= seen.keys()
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[1] > 0.6 * sizes[0]
    direct = sorted(map(tuple, p.STAGES[-1][1](spark, docs, SF).select("doc_id", "doc_tokens", "start").collect()))
    assert sum(1 for r in direct if r[2] == 0) == docs.count()
    whole = p.run(spark, SF)
    assert sum(1 for r in whole.collect() if r.start == 0) == docs.count()


def test_pipeline_odd_tables(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, component_id long"
    text = " ".join(f"word{i}" for i in range(40))
    data = [(1, text, None, None, None, 1, None, 7), (1, text, None, None, None, 1, None, 7), (None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 2, True, 8), (3, text + " mail me@x.org", "en", "a", 9, 3, False, 9)]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")]
