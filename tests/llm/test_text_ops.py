"""Quality, packing, SimHash, mixing, PII and URL operators against brute force."""

import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import mixing, packing, pii, quality, simhash, urls
from lociframe.llm.tokens import default_vocabulary, tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, extra string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_documents(spark):
    long = "naïve words, all different: " + " ".join(f"w{i}" for i in range(30_000))
    data = [(1, "", "a", None), (2, None, None, "x"), (3, "one", "b", ""), (4, long, "b", "y"), (5, long, None, None)]
    data += [(6, "same text here again today", "a", "")] * 2 + [(None, "same text here again today", "c", ""), (7, " \t\n ", "", None)]
    return spark.createDataFrame(data, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# --- quality


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from(["a", "b", "c#", "\n", "d", "\x0b", "é", "x x", "a\nb"]), max_size=60))
def test_statistics(parts):
    text = " ".join(parts)
    assert quality.statistics(text)[:5] == brute_statistics(text)


def test_repeated_windows_of_many_different_words():
    words = [f"w{i}" for i in range(7000)]
    assert quality.repeated_words(words + words[:6]) == 12


def test_quality_query(spark):
    out = {r.doc_id: r for r in quality.op1_quality_rules(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    assert out.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        assert tuple(out[i])[1:6] == brute_statistics(texts[i])
    for r in out.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    found = quality.judge(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == bool(r[-1]) for r in found)
    assert len(found) > 80 and right / len(found) > 0.9


def test_trees_are_monotone():
    import numpy as np

    r = np.random.default_rng(3)
    x = r.random((800, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * r.random(800) < 0.7).astype(float)
    model = quality.fit(x, y, {"a": -1}, ("a", "b"))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1)
    assert (np.diff(model.score(grid)) <= 1e-12).all()
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.8
    assert quality.fit(x, np.ones(800), names=("a", "b")) is None


def test_quality_odd(spark):
    docs = odd_documents(spark)
    out = quality.judge(docs, None).collect()
    assert len(out) == 9 and {r.doc_id for r in out if r.kept} == {4, 5}
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5]
    assert quality.judge(empty(spark), None).count() == 0
    assert quality.train(docs, empty(spark, "doc_id long, quality int")) is None


# --- tokens and packing


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=60) | st.text(alphabet="aA'sTé ²٣Σς\x1c\x85\n<|endoftext|>", max_size=40))
def test_ids_are_the_vocabulary_s(text):
    tok = tokenizer(default_vocabulary())
    want = tok.full.encode(text, add_special_tokens=False).ids
    assert tok.np.frombuffer(tok.encode(text), "<u4").tolist() == want


@settings(deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_assignment(lengths):
    places, cost = packing.assign(lengths, 64)
    sizes = packing.capacities(sum(lengths), 64)
    assert len(cost) == len(sizes) and sum(sizes) == sum(lengths)
    filled, taken = [set() for _ in sizes], [set() for _ in lengths]
    for k, start, n, s, offset in places:
        for x, span in ((taken[k], range(start, start + n)), (filled[s], range(offset, offset + n))):
            assert not x & set(span)
            x.update(span)
    assert [len(x) for x in taken] == lengths and all(x == set(range(n)) for x, n in zip(filled, sizes))


def check_packing(docs, out, tok):
    ids = {}
    for r in docs.collect():
        raw = tok.np.array(tok.full.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        ids.setdefault(r.doc_id, []).append(raw)
    sequences, covered = {}, {}
    for r in out:
        raw = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32)
        assert len(raw) == r.doc_tokens and r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end == 4096 or end & (end - 1) == 0 and end < 4096
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}


def test_packing_query(spark):
    check_packing(documents(spark), packing.op4_packing(spark, SF).collect(), tokenizer(default_vocabulary()))


def test_packing_odd(spark):
    docs = odd_documents(spark)
    check_packing(docs, packing.pack(docs).collect(), tokenizer(default_vocabulary()))
    assert packing.pack(empty(spark)).count() == 0
    r = packing.pack(docs.where("doc_id = 3"), with_ids=True).collect()[0]
    assert zlib.crc32(r.ids) == r.ids_crc32


# --- SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    hs = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """doc_id -> smallest reachable doc_id, over (doc_id, fp) pairs."""
    ids = [i for i, _ in fps]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4 or ids[a] is not None and ids[a] == ids[b]:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(fps))]


def test_simhash_query(spark):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in documents(spark).collect()]
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(docs, brute_components(docs)))
    assert rows(simhash.op5_simhash_near_dedup(spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_a_dense_cloud(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(6):
        centre = r.getrandbits(64)
        fps += [centre] + [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(120)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.classes(spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")).collect()
    assert sorted((r.fp, r.component_id) for r in got) == sorted(zip(signed, brute_components(list(enumerate(fps)))))


def test_simhash_odd(spark):
    docs = odd_documents(spark)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (7, 1), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (None, 6)], key=repr)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, free = {}, sum(sizes.values()), set(sizes)
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


def check_mix(data, out):
    sizes = {}
    for _, s, n in data:
        sizes[s] = sizes.get(s, 0) + n
    target, source = brute_targets(sizes), {i: s for i, s, _ in data}
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(out) == len(data) and all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_mixing_query(spark):
    data = [(r.doc_id, r.source, len(WORD.findall(r.text))) for r in documents(spark).collect()]
    out = mixing.op6_mixing_sources(spark, SF)
    check_mix(data, out.collect())
    assert rows(out) == rows(mixing.op6_mixing_sources(spark, SF))


def test_mixing_with_caps_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    data = [(i, s, (i * 37) % 50) for i, s in enumerate(["hot"] * 300 + ["b"] * 7 + [None] * 5 + ["c"] * 2 + [""] * 3)] + [(999, "zero", 0)]
    check_mix(data, mixing.mix(spark.createDataFrame(data, "doc_id long, source string, size long")).collect())


def test_mixing_odd(spark):
    docs = odd_documents(spark)
    sized = docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size"))
    out = mixing.mix(sized).collect()
    assert len(out) == 9 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.mix(empty(spark, "doc_id long, source string, size long")).count() == 0


# --- PII


def brute_luhn(digits):
    ds = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def brute_base(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and brute_luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return out


PII_TEXTS = [
    "a@b.c_d@e.f x@y.z@q.r .@a.b a@b a@b. é ü a+b@c-d.e-f.g",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 1.2.3 1.2.3.4",
    "4111 1111-1111 1111 and 4111111111111112, 4111  1111 1111 1111 6304000000000000000",
    "+1 (555) 010-9999 +1 +12345678 +1234567 ++49 30 1234567. +",
    "IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000; card 378282246310005 " + "- " * 30 + "order 378282246310005",
    "ssn 078-05-1120, 078-05-1120; social security: 000-12-3456",
    "9" * 40_000 + "." + "a" * 40_000 + "@",
    "x.y" * 9000 + "@b" + ".c" * 9000,
    "", None, "🙂 a@b.cd 🙂 10.0.0.1",
]


def test_pii_base(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)) + [(None, "a@b.c")], "doc_id long, text string")
    import hashlib

    for r in pii.detect(docs).collect():
        text = "a@b.c" if r.doc_id is None else PII_TEXTS[r.doc_id]
        base = brute_base(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (r.doc_id, base, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone")]
        assert r.spans.startswith(listed)
        if r.doc_id == 4:
            assert "iban:5:32" in r.spans and r.spans.count("iban") == 1 and r.spans.count("shortcard") == 1
        if r.doc_id == 5:
            assert r.spans.count("ssn") == 2 or r.spans.count("ssn") == 1
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_query(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    out = pii.op10_pii(spark, SF).collect()
    assert len(out) == len(texts) and sum(r.n_email for r in out) > 0
    for r in out:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd, ip 10.0.0.1", 1), (2, None, None), (3, "", 0), (4, "é 10.1.1.1@x.yz!", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert out == {1: ("mail [EMAIL], ip [IP]", 21), 2: (None, None), 3: ("", 0), 4: ("é [EMAIL]!", 10)}


# --- URLs


def test_url_rules(spark):
    data = [
        (1, "http://A.Example.NET/en/1?x"), (2, "http://example.net/de/"), (3, "http://notexample.com/de/1"), (4, "http://x.example.com/de/1"),
        (5, "https://example.org/fr/2#a"), (6, "http://net/"), (7, "http://a.net"), (8, "spam-farm."), (9, None), (10, ""), (10, "http://x-net/"),
        (None, "http://www.spam-farm.example.org/en"), (12, "http://h/click?a=1&redirect=2"), (13, "x://"), (14, "http://h?/adserver/"),
    ]
    out = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert out == {
        (1, "a.example.net", "/en/1"): ("example.net/en/", "allow"), (2, "example.net", "/de/"): ("net/", "block"), (3, "notexample.com", "/de/1"): (None, "allow"),
        (4, "x.example.com", "/de/1"): ("example.com/de/", "block"), (5, "example.org", "/fr/2"): ("org/fr/", "allow"), (6, "net", "/"): ("net/", "block"),
        (7, "a.net", ""): (None, "allow"), (8, "", ""): (None, "allow"), (9, "", ""): (None, "allow"), (10, "", ""): (None, "allow"), (10, "x-net", "/"): (None, "allow"),
        (None, "www.spam-farm.example.org", "/en"): (None, "block"), (12, "h", "/click"): (None, "block"), (13, "", ""): (None, "allow"), (14, "h", ""): (None, "block"),
    }
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_finds_what_all_rules_find():
    rules = [urls.Rule(t, "block") for t in ("a*b.c", "/ads/", "x-y-z", "*end", "q?r=s&t")] + [urls.Rule(t, "block", True) for t in ("net", "b.net/p/", "com/x")]
    index = urls.Index(rules)
    for where in ("a.net/ads/x", "b.net/p/q?r=s&t", "com/xylophone", "aab.c/x-y-z-", "net.com/p", "c.b.net/pend", "h/ADS/ads/"):
        want = {r.text for r in rules if re.search(r.regex(), where)}
        assert {r.text for r in index.matches(where, set(urls.TOKEN.findall(where.lower())))} == want
