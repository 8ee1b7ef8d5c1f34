"""SimHash fingerprints, linked by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of five segments. If two fingerprints
differ in at most t bits, then from some segment on, the differences in each
chain of l consecutive segments stay within l * t / 5, for every l at once
(the pigeonring principle). With t = 4 that means: one segment is equal, it and
the next differ in at most one bit, the next three in at most two, and so on.
The first two conditions make an equality join: the equal segment with either
half of the next one, 19 bits; the longer chains are checked before the whole
distance is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resemblance
from .common import materialise, stand_ins, table
from .components import components

#: Hash seed, words in a shingle, bits that may differ.
SEED, SHINGLE, DISTANCE = 42, 4, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints compared within one group; a larger group is compared block by block.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's lower-cased words; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    counts, bits = np.zeros(64, np.int64), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + k - 1 : k - 1 + min(n, at + (1 << 16))].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[8 * byte : 8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ bits
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as the signed long of the same 64 bits. Null text counts as empty."""

    def batch(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(batch, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """The ten chain heads of a fingerprint: (segment, key)."""
    part = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    out = []
    for i, (at, width) in enumerate(SEGMENTS):
        after, following = SEGMENTS[(i + 1) % 5]
        for half, (lo, size) in enumerate(((0, 6), (6, following - 6))):
            head = F.shiftleft(part(at, width), 13).bitwiseOR(part(after + lo, size))
            out.append(F.struct(F.lit(i).alias("seg"), head.bitwiseOR(F.lit((2 * i + half) << 40)).alias("key")))
    return F.array(*out)


def _linked(batches):
    """Rows (gid, seg, fp) in the order of gid -> a spanning forest of each group's links."""
    import numpy as np
    import pyarrow as pa

    masks = np.zeros((5, 6), np.uint64)
    for i in range(5):
        for n in range(1, 6):
            at, width = SEGMENTS[(i + n - 1) % 5]
            masks[i, n] = masks[i, n - 1] | np.uint64(((1 << width) - 1) << at)
    budget = [n * DISTANCE // 5 for n in range(6)]

    def near(x, seg):
        ok = np.ones(x.shape, bool)
        for n in (2, 3, 4, 5):
            ok[ok] = np.bitwise_count(x[ok] & masks[seg[ok], n]) <= budget[n]
            if not ok.any():
                break
        return ok

    def join(label, a, b):
        """Merge the trees of a and b; every label is a root before and after."""
        while len(a):
            ra, rb = label[a], label[b]
            on = ra != rb
            if not on.any():
                return
            a, b, ra, rb = a[on], b[on], ra[on], rb[on]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (label != label[label]).any():
                label[:] = label[label]

    def forest(gid, seg, fp):
        label = np.arange(len(gid))
        edges = np.flatnonzero(np.diff(gid)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(gid)]))
        for s, e in zip(starts[ends - starts > 64], ends[ends - starts > 64]):  # large groups: rows against all
            for at in range(s, e, 256):
                x = fp[at : min(e, at + 256), None] ^ fp[None, s:e]
                a, b = np.nonzero(near(x, np.full(x.shape, seg[s])))
                join(label, a + at, b + s)
        small = np.repeat(ends - starts <= 64, ends - starts)
        for d in range(1, 64):
            at = np.flatnonzero((gid[d:] == gid[:-d]) & small[d:])
            if not len(at):
                break
            at = at[near(fp[at + d] ^ fp[at], seg[at])]
            join(label, at, at + d)
        on = np.flatnonzero(label != np.arange(len(gid)))
        a, b = fp[on].view(np.int64), fp[label[on]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        if cut:
            yield forest(now[0][:cut], now[1][:cut], now[2][:cut].view(np.uint64))
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield forest(held[0], held[1], held[2].view(np.uint64))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``: enough of them to connect what the distance connects."""
    keys = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.seg", "k.key")
    shared = keys.groupBy("key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = keys.join(shared, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).select("key", "seg", "fp", "own", other.alias("other"))
    gid = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(gid.alias("gid"), "seg", "fp")
    return rows.repartition("gid").sortWithinPartitions("gid", "fp").mapInArrow(_linked, "a long, b long").distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of (doc_id, fp) rows."""
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    tied = materialise(components(links(first)), "roots")
    members = tied.union(tied.select("root", "root").distinct())
    least = members.join(first, members.node == first.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    least = members.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    out = first.join(least, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return materialise(out, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``. Null, empty and blank texts have
    fingerprint 0 and are linked like others. Equal ids are one document.
    A null ``doc_id`` never names a component; a component of such rows only
    has a null one. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    return fps.join(classes(fps), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest ``doc_id``.

    Near duplicates are those of ``resemblance``: SimHash of five-word shingles
    with pigeonring chains, then a similarity of 0.8 or more of the sets. Of
    several rows with the smallest id, the text with the smallest hash stays.
    Of components without any id, all rows stay. Rows are judged one by one: an
    id that is gone from one component may stay in another.
    """
    return stand_ins(docs, resemblance.near_duplicates(docs))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
