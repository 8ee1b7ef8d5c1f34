"""Jaccard join of shingle sets by signature trees.

Equal sets are one class from the start. Sets that may be similar meet by
shared parts: sets of one range of sizes split their shingles by hash into so
many buckets that two similar ones, which differ in a bounded number of
shingles, have an equal bucket, so no link is lost. What shared buckets connect
is a cluster. A cluster's sets, in the order of their sizes, are cut into
blocks of a bounded number of shingles, and a block is joined with itself by a
signature tree: a node holds the OR of its sets' bitmaps and the range of their
sizes, and two nodes are walked down together only as long as the shingles they
can have in common are enough, their sizes are near enough, and they aren't all
in one component already. What is left at the leaves is compared by whole sets.
Pairs of blocks of a cluster follow, by the same bounds, where a cluster is of
several blocks and not of one component by then.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, released, table, text_key
from .components import components
from .numbering import numbered
from .resemblance import _groups, shingles

#: Fixed values of the query: words in a shingle, least similarity as a fraction.
SHINGLE, PARTS, WHOLE = 3, 90, 100
#: Shingles of a block, the least that a set counts as there, children of a node, bits of the largest bitmap.
BLOCK_BITS, LEAST, FAN, WIDEST = 20, 1024, 4, 1 << 16
#: First sizes of the ranges of sizes, each a quarter above the one before.
STARTS = [1]
while STARTS[-1] < 1 << 40:
    STARTS.append(STARTS[-1] + max(1, STARTS[-1] // 4))


def buckets(c: int, parts: int = PARTS, whole: int = WHOLE) -> tuple[int, int]:
    """Buckets of the sets of size range ``c``, and how many of the lightest a set leaves out.

    A pair whose smaller set has at most ``top`` shingles differs in at most
    ``most``. With twice as many spare buckets as each may leave out, one that
    is equal in both is left out by neither.
    """
    top = STARTS[c + 1] - 1
    most = (top + top * whole // parts) * (whole - parts) // (whole + parts)
    if not most:
        return 0, 0
    spare = (most + 1) // 14
    return most + 1 + 2 * spare, spare


def bucket_keys(toks, parts: int = PARTS, whole: int = WHOLE):
    """The hashes of a set's buckets, for its own size range and those below that a similar set can be in."""
    import numpy as np

    n = len(toks)
    if not n:
        return np.empty(0, np.int64)
    mixed = toks.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    out = []
    for c in range(bisect_right(STARTS, -(-n * parts // whole)) - 1, bisect_right(STARTS, n)):
        k, spare = buckets(c, parts, whole)
        if not k:
            continue
        at = (mixed % np.uint64(k)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=k)
        sums = np.zeros(k, np.uint64)
        has = np.flatnonzero(count)
        sums[has] = np.add.reduceat((mixed * np.uint64(0xBF58476D1CE4E5B9))[order], (np.cumsum(count) - count)[has])
        key = (sums ^ (np.arange(k, dtype=np.uint64) + np.uint64(c * 0x632BE59BD9B4E019 % (1 << 64)))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
        out.append(key[np.argsort(count, kind="stable")[spare:]])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


SIGNED = "doc_id long, t binary, h long, n long, keys array<long>"


def signed(docs: DataFrame, size: int = SHINGLE, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(doc_id, t, h, n, keys): text key, hash and size of the set of shingles, its buckets' hashes; h is null for no words."""

    def batch(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [shingles(text.as_py(), size) for text in b.column(2)]
            h = pa.array([xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], pa.int64())
            keys = pa.array([bucket_keys(s, parts, whole) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), h, pa.array([len(s) for s in sets], pa.int64()), keys], [f.split()[0] for f in SIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("t"), _bytes())
    return rows.mapInArrow(batch, SIGNED)


def clusters(nodes: DataFrame) -> DataFrame:
    """(h, root): sets of ``nodes`` (h, keys) that equal buckets connect; sets that share none are left out."""
    keys = nodes.select("h", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    links = keys.join(shared, "key").where("h <> b").select(F.col("h").alias("a"), "b")
    tied = materialise(components(links), "clusters")
    return tied.union(tied.select("root", "root").distinct()).toDF("h", "root")


class SignatureTree:
    """The levels of a tree over sets in the order of their sizes, from the sets up."""

    def __init__(self, toks, offsets, label):
        import numpy as np

        n = np.diff(offsets)
        bits = 64
        while bits < min(WIDEST, 4 * int(n.max())):
            bits *= 2
        mixed = toks.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = (mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
        maps = np.zeros((len(n), bits // 64), np.uint64)
        for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
            row = np.zeros(bits, np.uint8)
            row[at[a:b]] = 1
            maps[i] = np.packbits(row, bitorder="little").view(np.uint64)
        spare = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # shingles that share a bit with another of their set
        self.levels = [(maps, n, n, spare, label, label)]
        while len(self.levels[-1][0]) > 1:
            maps, lo, hi, spare, first, last = self.levels[-1]
            every = np.arange(0, len(lo), FAN)
            of = lambda f, x: f.reduceat(x, every)
            self.levels.append((of(np.bitwise_or, maps), of(np.minimum, lo), of(np.maximum, hi), of(np.maximum, spare), of(np.minimum, first), of(np.maximum, last)))

    def pairs(self, parts: int, whole: int):
        """The pairs i < j of sets that no bound excludes."""
        import numpy as np

        a = b = np.zeros(1, np.int64)
        step = np.arange(FAN)
        for depth, (maps, lo, hi, spare, first, last) in enumerate(reversed(self.levels)):
            if depth:
                a, b = (x.ravel() for x in np.broadcast_arrays((FAN * a)[:, None, None] + step[:, None], (FAN * b)[:, None, None] + step))
                ok = (a <= b) & (b < len(lo))
                a, b = a[ok], b[ok]
            one = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b])
            ok = ~one & (whole * hi[a] >= parts * lo[b])
            a, b = a[ok], b[ok]
            need = -(-parts * (lo[a] + lo[b]) // (parts + whole))
            ok = a == b
            for s in range(0, len(a), 4096):
                x, y = a[s : s + 4096], b[s : s + 4096]
                common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
                ok[s : s + 4096] |= np.minimum(common, np.minimum(hi[x], hi[y])) >= need[s : s + 4096]
            a, b = a[ok], b[ok]
        return a[a < b], b[a < b]


def joined(toks, offsets, label, side, first: int, parts: int, whole: int):
    """Merges in ``label`` what is similar among sets in the order of their sizes; returns the pairs of labels merged.

    ``label`` has what is known to be one component by its smallest number,
    ``side`` the block; of two blocks only pairs across are compared. The set
    ``first`` is compared with all before the tree is built, since most sets of
    a cluster resemble any of it.
    """
    import numpy as np

    n, found = np.diff(offsets), []
    dense = np.unique(toks, return_inverse=True)[1]
    flag = np.zeros(int(dense.max(initial=-1)) + 1, bool)
    across = len(np.unique(side)) > 1

    def compare(i, js):
        js = js[label[js] != label[i]]
        if across:
            js = js[side[js] != side[i]]
        if not len(js):
            return
        mine = dense[offsets[i] : offsets[i + 1]]
        flag[mine] = True
        lengths = n[js]
        hits = flag[np.concatenate([dense[offsets[j] : offsets[j + 1]] for j in js])]
        common = np.add.reduceat(hits.astype(np.int64), np.cumsum(lengths) - lengths)
        flag[mine] = False
        for j in js[whole * common >= parts * (lengths + n[i] - common)]:
            if label[i] != label[j]:
                low, high = min(label[i], label[j]), max(label[i], label[j])
                label[label == high] = low
                found.append((low, high))

    every = np.arange(len(n))
    compare(first, every[every != first])
    if (label != label[0]).any():
        a, b = SignatureTree(toks, offsets, label.copy()).pairs(parts, whole)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edges = np.flatnonzero(np.diff(a)) + 1
        for js, i in zip(np.split(b, edges), a[np.concatenate(([0], edges))] if len(a) else []):
            compare(int(i), js)
    return found


def _grouped(batches, parts: int, whole: int):
    """Groups of rows (gid, root, h, known, side, toks) -> (h, known, labels, merged), the last two as places in the distinct ``known``."""
    import numpy as np
    import pyarrow as pa

    for t in _groups(batches, 6):
        gid, root, h, known, side = (t.column(i).to_numpy() for i in range(5))
        lists = t.column(5)
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        edges = np.flatnonzero(np.diff(gid)) + 1
        for s, e in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(gid)]))):
            order = s + np.lexsort((h[s:e], np.diff(offsets)[s:e]))
            toks = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in order])
            ends = np.concatenate(([0], np.cumsum(np.diff(offsets)[order])))
            names, label = np.unique(known[order], return_inverse=True)
            label = label.astype(np.int64)
            pivot = np.flatnonzero(h[order] == root[order])
            merged = joined(toks, ends, label, side[order], int(pivot[0]) if len(pivot) else len(order) // 2, parts, whole)
            yield h[order], names, label, merged


def labels(sets: DataFrame, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(h, label), written: the smallest ``h`` that each set of (gid, root, h, toks) is linked to within its group; of a ``root`` no row."""

    def run(batches):
        import pyarrow as pa

        for h, names, label, _ in _grouped(batches, parts, whole):
            least = names[label]  # labels are numbers of sorted hashes, so the smallest stands for all
            on = least != h
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(least[on])], ["h", "label"])

    rows = sets.select("gid", "root", "h", F.col("h").alias("known"), F.lit(0).alias("side"), "toks")
    return materialise(rows.repartition("gid").sortWithinPartitions("gid", "h").mapInArrow(run, "h long, label long"), "labels")


def links(sets: DataFrame, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """Links (a, b) between the components ``known`` of the sets of two blocks: (gid, root, h, known, side, toks)."""

    def run(batches):
        import pyarrow as pa

        for _, names, _, merged in _grouped(batches, parts, whole):
            a, b = zip(*merged) if merged else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names[list(a)], pa.int64()), pa.array(names[list(b)], pa.int64())], ["a", "b"])

    rows = sets.select("gid", "root", "h", "known", "side", "toks")
    return rows.repartition("gid").sortWithinPartitions("gid", "h").mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(h, root) for each set of ``nodes`` (h, n, one, keys) that links of similarity parts / whole or more connect with a smaller one.

    ``one`` is (doc_id, t) of a row of ``docs`` that has the set.
    """
    members = clusters(nodes).join(nodes.select("h", "n", "one"), "h")
    placed = numbered(members, "root", ["n", "h"], F.greatest("n", F.lit(LEAST)), tag="placed")
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    placed = placed.select("root", "h", "n", "one", block(F.col("place")).alias("block"), (block(F.col("total") - 1) + 1).alias("blocks"))
    # One row has each set, so copies of a text meet no join.
    wanted = placed.select(F.coalesce("one.doc_id", F.lit(-1)).alias("d"), F.col("one.t").alias("k"), "root", "h", "n", "block", "blocks")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), text_key(F.col("text")).alias("t"), _bytes())
    texts = texts.join(wanted.hint("merge"), (F.col("doc") == F.col("d")) & (F.col("t") == F.col("k")))

    def tokens(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([shingles(t.as_py(), size) for t in b.column(5)], pa.list_(pa.int64()))], ["root", "h", "n", "block", "blocks", "toks"])

    texts = texts.dropDuplicates(["doc", "t"]).select("root", "h", "n", "block", "blocks", "text")
    sets = materialise(texts.mapInArrow(tokens, "root long, h long, n long, block long, blocks long, toks array<long>"), "sets")
    # The cluster's first set goes to all of its blocks, so what is linked to it has one label in all.
    everywhere = F.when(F.col("h") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    own = sets.withColumn("at", F.explode(everywhere))
    found = labels(own.select(F.xxhash64("root", "at").alias("gid"), "root", "h", "toks"), parts, whole)
    known = sets.where("blocks > 1").select("root", "h", "n", "block").join(found, "h", "left").withColumn("known", F.coalesce("label", "h"))
    # Blocks whose sets all have the first one's label need no comparison with each other.
    of = known.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.bool_and(F.col("known") == F.col("root")).alias("one"))
    of = materialise(of, "blocks")
    a, b = (of.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi", "one"))) for s in "ab")
    pairs = a.join(b, "root").where((F.col("block_a") < F.col("block_b")) & (F.col("hi_a") * whole >= F.col("lo_b") * parts) & ~(F.col("one_a") & F.col("one_b")))
    if of.isEmpty() or pairs.isEmpty():
        released(sets)
        return found.toDF("h", "root")
    sides = materialise(pairs.select("root", "block_a", "block_b", F.explode(F.array("block_a", "block_b")).alias("block")), "pairs")
    both = sets.select("root", "h", "block", "toks").join(sides, ["root", "block"]).join(known.select("h", "known"), "h")
    across = links(both.select(F.xxhash64("root", "block_a", "block_b").alias("gid"), "root", "h", "known", (F.col("block") == F.col("block_b")).cast("int").alias("side"), "toks"), parts, whole)
    tied = materialise(components(materialise(across, "links")), "tied").toDF("label", "least")
    released(sets)
    # What a label is tied to is its sets', and its own.
    every = found.union(tied.select("label", "label"))
    out = every.join(tied, "label", "left").select("h", F.coalesce("least", "label").alias("root")).where("h <> root")
    return materialise(out, "similar")


def similar_documents(docs: DataFrame, size: int = SHINGLE, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs`` (``doc_id``, ``text``).

    A text's set has its distinct shingles of ``size`` words, A-Z lower-cased; a
    shorter text is one shingle. Null, empty and blank texts have no shingles,
    are linked with nothing and keep their own id. Two rows are linked at a
    Jaccard similarity of parts / whole or more; ``component_id`` is the
    smallest id that links reach. Repeated rows are linked like any others, ids
    need not be unique; a null id never names a component, and a component
    without any id has a null one. An empty table gives no rows. Other columns
    aren't read. Shingles and sets are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(signed(docs, size, parts, whole), "signed")
    nodes = rows.where("h is not null").groupBy("h").agg(F.min(F.struct("doc_id", "t")).alias("one"), F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    rows = rows.select("doc_id", "h", "n")
    tied = similar(docs, nodes, size, parts, whole)
    least = nodes.select("h", "first").join(tied, "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = materialise(least, "roots")
    names = least.groupBy("root").agg(F.min("first").alias("component_id"))
    least = materialise(least.join(names, "root").select("h", "component_id"), "classes")
    named = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(least, "h", "left").select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"))


def op12_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM docs),
sets AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) AS sid, first, len(s) AS n FROM (SELECT s, min(doc_id) AS first FROM cut WHERE len(s) > 0 GROUP BY s)),
each AS MATERIALIZED (SELECT sid, n, unnest(s) AS tok FROM sets),
pairs AS MATERIALIZED (
  SELECT a.sid AS a, b.sid AS b FROM each a JOIN each b ON a.tok = b.tok AND a.sid < b.sid AND {WHOLE} * a.n >= {PARTS} * b.n AND {WHOLE} * b.n >= {PARTS} * a.n
  GROUP BY a.sid, b.sid, a.n, b.n HAVING {WHOLE} * count(*) >= {PARTS} * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT sid, sid FROM sets UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
named AS (SELECT r.a AS sid, min(x.first) AS component_id FROM reach r JOIN sets x ON x.sid = r.b GROUP BY r.a)
SELECT c.doc_id, CAST(len(c.s) AS BIGINT) AS n_shingles, CASE WHEN len(c.s) = 0 THEN c.doc_id ELSE m.component_id END AS component_id
FROM cut c LEFT JOIN sets x ON x.s = c.s LEFT JOIN named m ON m.sid = x.sid
"""
