"""SimHash with exact resemblance: near copies whose shingle sets have a Jaccard similarity of 4/5 or more.

At that similarity some 15 % of a SimHash's bits differ, too many for keys that
no pair can miss. So a fingerprint has 256 bits here, which lie on two rings of
32 segments (the second one in another order of the bits), and the pigeonring
filter is run from the other end: two fingerprints meet if a chain of two
consecutive segments is equal in either ring, longer chains from there on must
stay within their share of the 54 bits that may differ in all, and then the
whole distance must. Sets that are linked so make a cluster; within a cluster
the sets themselves are compared, so no pair below the similarity is linked.
Bits of small sets are coarser: they lie on ``SMALL_RINGS`` rings, and a pair
with one of up to ``SMALL`` shingles may differ in ``SMALL_DISTANCE`` bits. Pairs
at a similarity of 0.8 meet with a chance of 0.9 or more at every size, at 0.85
and 0.9 of some 0.99 and 0.999; equal sets always do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, text_key
from .components import components

#: Words in a shingle, least similarity as a fraction.
SHINGLE, PARTS, WHOLE = 5, 4, 5
#: Bits, 64-bit parts of a fingerprint, segments of a ring (a byte each), rings, bits that may differ.
BITS, LONGS, RING, RINGS, DISTANCE = 256, 4, 32, 2, 54
#: Shingles of a small set, and for those: rings, bits that may differ.
SMALL, SMALL_RINGS, SMALL_DISTANCE = 64, 4, 68
#: Chains that are checked, in segments.
CHAINS = (4, 8, 16, 32)
#: Fingerprints of a key, and sets of a cluster, that are compared at once; more are compared block by block.
BLOCK, SETS = 1024, 256


def shingles(text: bytes, size: int = SHINGLE):
    """Sorted distinct hashes of a text's shingles of words, A-Z lower-cased; a shorter text is one shingle, no words none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return np.empty(0, np.int64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ each[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def rings():
    """Bit numbers in the order of each ring; the first ``RINGS`` are those of all sets."""
    import numpy as np

    drawn = np.random.default_rng(5)
    return np.stack([np.arange(BITS), *(drawn.permutation(BITS) for _ in range(SMALL_RINGS - 1))])


def wide(toks):
    """The 256 bits of a set of shingle hashes, as an array of 0 and 1: those set in over half the hashes."""
    import numpy as np

    total = np.zeros(BITS, np.int64)
    for at in range(0, len(toks), 4096):
        x = toks[at : at + 4096].view(np.uint64)
        each = np.empty((len(x), LONGS), np.uint64)
        for i in range(LONGS):
            h = (x ^ np.uint64(0xA24BAED4963EE407 * (i + 1) % (1 << 64))) * np.uint64(0x9FB21C651E98DF25)
            h = (h ^ (h >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
            each[:, i] = h ^ (h >> np.uint64(28))
        total += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * total > len(toks)).astype(np.uint8)


def heads(bits, n: int):
    """The keys of the fingerprint of a set of ``n`` shingles: each two consecutive segments of each of its rings, with their number."""
    import numpy as np

    out = []
    for r, order in enumerate(rings()[: SMALL_RINGS if n <= SMALL else RINGS]):
        seg = np.packbits(bits[order], bitorder="little").astype(np.int32)
        out.append(((r * RING + np.arange(RING, dtype=np.int32)) << 16) | (seg << 8) | np.roll(seg, -1))
    return np.concatenate(out)


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


SIGNED = "doc_id long, t binary, h long, n int, fp array<long>, keys array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h, n, fp, keys): text key, hash and size of the set of shingles, its fingerprint and the keys of that."""

    def batch(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in batches:
            hs, ns, fps, keys = [], [], [], []
            for text in b.column(2):
                toks = shingles(text.as_py())
                bits = wide(toks)
                hs.append(xxh64_intdigest(toks.tobytes()) - (1 << 63))
                ns.append(len(toks))
                fps.append(np.packbits(bits, bitorder="little").view(np.int64))
                keys.append(heads(bits, len(toks)))
            columns = [pa.array(hs, pa.int64()), pa.array(ns, pa.int32()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], [f.split()[0] for f in SIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("t"), _bytes())
    return rows.mapInArrow(batch, SIGNED)


def _merge(label, a, b):
    """Merge the trees of a and b; every label is a root before and after."""
    import numpy as np

    while len(a):
        ra, rb = label[a], label[b]
        on = ra != rb
        if not on.any():
            return
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label != label[label]).any():
            label[:] = label[label]


def _groups(batches, columns):
    """Batches in the order of their first column -> lists of arrays that hold whole groups."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        gid = b.column(0).to_numpy(zero_copy_only=False)
        if gid[0] == gid[-1]:
            if held and held[-1].column(0)[0].as_py() != gid[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b)
            continue
        cut = int((gid != gid[-1]).nonzero()[0][-1]) + 1
        yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def chain_masks():
    """The bits of each chain that begins at a segment: by segment, length of chain and part of the fingerprint."""
    import numpy as np

    masks = np.zeros((SMALL_RINGS * RING, len(CHAINS), LONGS), np.uint64)
    for r, order in enumerate(rings()):
        for i in range(RING):
            for c, size in enumerate(CHAINS):
                bits = np.zeros(BITS, np.uint8)
                bits[np.concatenate([order[8 * (s % RING) : 8 * (s % RING) + 8] for s in range(i, i + size)])] = 1
                masks[r * RING + i, c] = np.packbits(bits, bitorder="little").view(np.uint64)
    return masks


def close(masks, fp, n, head, a, b):
    """Those of the pairs a, b, which share the segments at ``head``, whose sizes can do, whose chains stay in their budgets and whose distance is small enough."""
    import numpy as np

    least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = WHOLE * least >= PARTS * most
    a, b, least = a[ok], b[ok], least[ok]
    for c, size in enumerate(CHAINS):
        budget = size * np.where(least <= SMALL, SMALL_DISTANCE, DISTANCE) // RING
        x = (fp[a] ^ fp[b]) & masks[head[a], c]
        ok = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= budget
        a, b, least = a[ok], b[ok], least[ok]
    return a, b


def _near(batches):
    """Rows (gid, head, h, n, f0..f3) in the order of gid -> a spanning forest of each group's near fingerprints: a, b."""
    import numpy as np
    import pyarrow as pa

    masks = chain_masks()
    for t in _groups(batches, 8):
        gid, head, h, n = (t.column(i).to_numpy() for i in range(4))
        n = n.astype(np.int64)
        fp = np.stack([t.column(4 + i).to_numpy() for i in range(LONGS)], axis=1).view(np.uint64)
        label = np.arange(len(gid))
        edges = np.flatnonzero(np.diff(gid)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(gid)]))
        for s, e in zip(starts[ends - starts > 64], ends[ends - starts > 64]):  # large groups: rows against all
            for at in range(s, e, 128):
                a, b = np.meshgrid(np.arange(at, min(e, at + 128)), np.arange(s, e), indexing="ij")
                _merge(label, *close(masks, fp, n, head, *(x.ravel() for x in (a, b))))
        small = np.repeat(ends - starts <= 64, ends - starts)
        for d in range(1, 64):
            at = np.flatnonzero((gid[d:] == gid[:-d]) & small[d:])
            if not len(at):
                break
            _merge(label, *close(masks, fp, n, head, at, at + d))
        on = np.flatnonzero(label != np.arange(len(gid)))
        yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(h[label[on]])], ["a", "b"])


def _dealt(rows: DataFrame, group: str, hot: DataFrame, block: int, *columns: str) -> DataFrame:
    """``rows`` with gid: its group, or in the groups of ``hot`` (group, n) each pair of blocks that it belongs to."""
    rows = rows.join(hot, group, "left").withColumn("blocks", F.ceil(F.coalesce("n_group", F.lit(1)) / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    gid = F.xxhash64(F.col(group), F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(gid.alias("gid"), *columns)


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the fingerprints of ``nodes`` (h, n, fp, keys) say may be similar."""
    keys = nodes.select("h", "n", F.explode("keys").alias("key"), *(F.col("fp")[i].alias(f"f{i}") for i in range(LONGS)))
    hot = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_group")).where(F.col("n_group") > BLOCK)
    hot = materialise(hot, "hot")
    head = F.shiftright("key", 16).alias("head")
    rows = _dealt(keys, "key", hot, BLOCK, head, "h", "n", *(f"f{i}" for i in range(LONGS)))
    found = rows.repartition("gid").sortWithinPartitions("gid", "h").mapInArrow(_near, "a long, b long")
    return materialise(found.distinct(), "near")


def _alike(batches):
    """Rows (gid, h, toks) in the order of gid -> a spanning forest of each group's similar sets: a, b."""
    import numpy as np
    import pyarrow as pa

    for t in _groups(batches, 3):
        gid, h, sets = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).chunk(0) if t.num_rows else None
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        edges = np.flatnonzero(np.diff(gid)) + 1
        out = [np.empty(0, np.int64)] * 2
        outs = [out]
        for s, e in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(gid)]))):
            m = e - s
            if m < 2:
                continue
            size = np.diff(offsets[s : e + 1]).astype(np.int64)
            tok = np.unique(values[offsets[s] : offsets[e]], return_inverse=True)[1]
            row = np.repeat(np.arange(m), size)
            order = np.argsort(tok, kind="stable")
            tok, row = tok[order], row[order]
            common = np.zeros((m, m), np.float32)
            top = int(tok[-1]) + 1 if len(tok) else 0
            for low in range(0, top, 4096):  # counts of common shingles, some columns at a time
                a, b = np.searchsorted(tok, [low, low + 4096])
                x = np.zeros((m, min(4096, top - low)), np.float32)
                x[row[a:b], tok[a:b] - low] = 1
                common += x @ x.T
            both = size[:, None] + size[None, :]
            a, b = np.nonzero((WHOLE + PARTS) * common >= PARTS * both)
            label = np.arange(m)
            _merge(label, a[a < b], b[a < b])
            on = np.flatnonzero(label != np.arange(m))
            outs.append([h[s + on], h[s + label[on]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*outs)], ["a", "b"])


def _sets(batches):
    """(root, h, text) -> (root, h, toks)."""
    import pyarrow as pa

    for b in batches:
        toks = pa.array([shingles(t.as_py()) for t in b.column(2)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), toks], ["root", "h", "toks"])


def similar(clusters: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect the similar sets within ``clusters`` (h, root), by the whole sets."""
    wanted = materialise(nodes.select("h", F.col("t").alias("k")).join(clusters, "h"), "wanted")
    texts = docs.select(text_key(F.col("text")).alias("t"), _bytes()).join(wanted.hint("merge"), F.col("t") == F.col("k")).select("root", "h", "text")
    sets = materialise(texts.mapInArrow(_sets, "root long, h long, toks array<long>").dropDuplicates(["h"]), "sets")
    hot = clusters.groupBy("root").agg(F.count("*").alias("n_group")).where(F.col("n_group") > SETS)
    rows = _dealt(sets, "root", materialise(hot, "hot"), SETS, "h", "toks")
    found = materialise(rows.repartition("gid").sortWithinPartitions("gid", "h").mapInArrow(_alike, "a long, b long").distinct(), "similar")
    released(wanted)
    released(sets)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, t, component_id), one row for each row of ``docs`` (``doc_id``, ``text``); t is ``text_key``.

    A component is what links of similarity 4/5 or more connect, named by its
    smallest ``doc_id``; of rows without any id only, it is null. Null, empty
    and blank texts have no shingles and are copies of each other. An empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(signed(docs), "signed")
    nodes = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.min("t").alias("t"), F.max("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    rows = rows.select("doc_id", "t", "h")
    clusters = materialise(components(candidates(nodes)), "clusters")
    clusters = clusters.union(clusters.select("root", "root").distinct()).toDF("h", "root").distinct()
    tied = materialise(components(similar(materialise(clusters, "clusters"), nodes, docs)), "roots")
    least = nodes.select("h", "first").join(tied.toDF("h", "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = materialise(least, "roots")
    names = least.groupBy("root").agg(F.min("first").alias("component_id"))
    least = materialise(least.join(names, "root").select("h", "component_id"), "classes")
    return rows.join(least, "h").select("doc_id", "t", "component_id")
