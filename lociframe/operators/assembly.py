"""Molecules from sorted reads: families are split and called in one pass, whatever their depth.

Reads are dealt by family, sorted within the task, and read batch by batch. A
family that goes on in the next batch is held as sums per position and base, and
as its parts' first fingerprints, never as reads; so memory depends on the
length of reads and the number of parts, not on depth. Families deeper than
``DEEP`` reads are dealt over several tasks: their parts are found from their
distinct fingerprints, and each task's sums are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import sequence as S
from ..sources.shared import written
from .reads import MAX_QUALITY, MIN_BASE_QUALITY, duplex_consensus

FAMILY = ["sample_id", "seed_a", "seed_b"]
#: Bits that fingerprints of one part may differ in; reads of a family that one task takes.
BITS, DEEP = 4, 1_000_000


def compatible(fps, first: int, bits: int = BITS):
    """Which fingerprints are within ``bits`` of ``first``, as they are or with their halves swapped."""
    import numpy as np

    first = np.uint64(first)
    turned = (fps << np.uint64(32)) | (fps >> np.uint64(32))
    return (np.bitwise_count(fps ^ first) <= bits) | (np.bitwise_count(turned ^ first) <= bits)


def take_parts(fps, heads: list[int], bits: int = BITS):
    """The part of each of a family's next fingerprints, in their order: the first whose head is compatible, else a new one, added to ``heads``."""
    import numpy as np

    part = np.full(len(fps), -1, np.int64)
    for i, h in enumerate(heads):
        part[(part < 0) & compatible(fps, h, bits)] = i
    while len(rest := np.flatnonzero(part < 0)):
        heads.append(int(fps[rest[0]]))
        near = rest[compatible(fps[rest], heads[-1], bits)]
        part[near] = part[rest[0]] = len(heads) - 1
    return part


def _families(b, names):
    """Starts of the families of a batch, which is in their order; nulls are equal."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for n in names:
        c = b.column(b.schema.get_field_index(n))
        c = pc.fill_null(c, "\0" if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else -1)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _key(b, names, at):
    return tuple(b.column(b.schema.get_field_index(n))[at].as_py() for n in names)


class Splitter:
    """Parts of the reads of sorted batches; holds the open family's heads."""

    def __init__(self, names, bits):
        self.names, self.bits, self.open, self.heads = names, bits, None, []

    def parts(self, b):
        """(starts of families, whether the first one goes on from the batch before, part of each row)."""
        import numpy as np

        starts = _families(b, self.names)
        fps = b.column(b.schema.get_field_index("fingerprint")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        goes_on = self.open == _key(b, self.names, 0)
        part = np.zeros(len(fps), np.int64)
        ends = np.append(starts[1:], len(fps))
        heads = fps[np.repeat(starts, ends - starts)]
        turned = (fps << np.uint64(32)) | (fps >> np.uint64(32))
        own = (np.bitwise_count(fps ^ heads) <= self.bits) | (np.bitwise_count(turned ^ heads) <= self.bits)
        several = np.add.reduceat((~own).astype(np.int64), starts) > 0
        several[-1] = True  # may go on in the next batch
        several[0] |= goes_on
        for f in np.flatnonzero(several):
            known = self.heads if f == 0 and goes_on else []
            part[starts[f] : ends[f]] = take_parts(fps[starts[f] : ends[f]], known, self.bits)
            if f == len(starts) - 1:
                self.open, self.heads = _key(b, self.names, int(starts[-1])), known
        return starts, goes_on, part


def _dealt(reads: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return reads.repartition(*keys).sortWithinPartitions(*keys, *order)


def split_families(reads: DataFrame, bits: int = BITS) -> DataFrame:
    """``reads`` (seed_a, seed_b, fingerprint, read_ord) with ``part``: the first group of the family whose first read is compatible.

    Parts beyond the first are UMI collisions. One sort, no second look at the reads.
    """
    schema = StructType([*reads.schema.fields, StructField("part", LongType())])

    def run(batches):
        import pyarrow as pa

        split = Splitter(FAMILY, bits)
        for b in batches:
            if b.num_rows:
                part = split.parts(b)[2]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return _dealt(reads, FAMILY, "read_ord").mapInArrow(run, schema)


_SIDE = "struct<seq: string, err: array<double>>"
CALLED = f"sample_id string, seed_a string, seed_b string, part long, fwd_reads long, rev_reads long, first_ord long, skip string, consensus_fwd {_SIDE}, consensus_rev {_SIDE}"
SUMS = "sample_id string, seed_a string, seed_b string, part long, strand boolean, n long, first_ord long, skip string, length int, sums array<double>"


def _weights(min_quality: int, cap: int):
    """Weight of each quality's character, and place of each letter among A, C, G, T (4: none of them)."""
    import numpy as np

    q = np.arange(256) - 33
    weight = np.where(q < min_quality, 0.0, 1 - 10.0 ** (-np.minimum(q, cap) / 10))
    place = np.full(256, 4, np.int64)
    for i, letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
        place[list(letters)] = i
    return weight, place


def _flat(column):
    """A text column's characters, the row of each, and its place there."""
    import numpy as np
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), length)
    return data, row, np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length), length


class _Open:
    """What is held of a part's strand: reads, first place, its skipped bases, sums per position and base."""

    def __init__(self):
        import numpy as np

        self.n, self.first, self.skip, self.length, self.sums = 0, None, None, 0, np.zeros((0, 4))

    def add(self, n, first, skip, length, sums):
        import numpy as np

        self.n += int(n)
        if self.first is None or first < self.first:
            self.first, self.skip = int(first), skip
        self.length = max(self.length, int(length))
        if len(self.sums) < length:
            self.sums = np.concatenate([self.sums, np.zeros((int(length) - len(self.sums), 4))])
        self.sums[: int(length)] += sums[: int(length)]


def _called(sums, cap):
    """Letters and errors of positions: the base of the greatest weight, the first letter of equal ones, N without weight."""
    import numpy as np

    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    top = sums[np.arange(len(sums)), best] if len(sums) else total
    none = total <= 0
    err = np.maximum(1 - top / np.where(none, 1.0, total), 10.0 ** (-cap / 10))
    letters = np.frombuffer(b"ACGT", np.uint8)[best]
    return np.where(none, np.uint8(ord("N")), letters).astype(np.uint8), np.where(none, 1.0, err)


def _sides(groups, cap):
    """Struct column of the consensus of (length, sums) pairs; null for None and for no positions."""
    import numpy as np
    import pyarrow as pa

    missing = np.array([g is None or not g[0] for g in groups], bool)
    kept = [g[1][: g[0]] for g, m in zip(groups, missing) if not m]
    letters, err = _called(np.concatenate(kept) if kept else np.zeros((0, 4)), cap)
    lengths = np.array([0 if m else g[0] for g, m in zip(groups, missing)], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    text = pa.StringArray.from_buffers(len(groups), offsets.buffers()[1], pa.py_buffer(letters.tobytes()))
    errs = pa.ListArray.from_arrays(offsets, pa.array(err))
    return pa.StructArray.from_arrays([text, errs], ["seq", "err"], mask=pa.array(missing))


def _molecule_batch(rows, cap):
    """Rows (key, part, forward or None, reverse or None), the sides being ``_Open``, as a batch of ``CALLED``."""
    import pyarrow as pa

    side = lambda i: _sides([None if r[i] is None else (r[i].length, r[i].sums) for r in rows], cap)
    first = [min((s for s in r[2:] if s is not None), key=lambda s: s.first) for r in rows]
    columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(3)] + [
        pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[i].n if r[i] is not None else 0 for r in rows], pa.int64()) for i in (2, 3)),
        pa.array([s.first for s in first], pa.int64()), pa.array([s.skip for s in first], pa.string()), side(2), side(3),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CALLED.split(", ")[:8]] + ["consensus_fwd", "consensus_rev"])


def _sum_groups(b, starts, part, min_quality, cap):
    """Per (family, part, strand) of a batch, in that order: family, part, strand, reads, first row, length, sums."""
    import numpy as np

    of = lambda n: b.column(b.schema.get_field_index(n))
    weight, place = _weights(min_quality, cap)
    fam = np.zeros(b.num_rows, np.int64)
    fam[starts[1:]] = 1
    fam = np.cumsum(fam)
    back = np.array([x != "Forward" for x in of("strand").to_pylist()], np.int64)
    parts = int(part.max()) + 1
    key, group = np.unique((fam * parts + part) * 2 + back, return_inverse=True)
    data, row, pos, length = _flat(of("seq"))
    qual, qrow, qpos, qlength = _flat(of("qual"))
    w = np.zeros(len(data))
    held = pos < qlength[row]  # a base without a quality has no weight
    starts_q = np.cumsum(qlength) - qlength
    w[held] = weight[qual[(starts_q[row] + pos)[held]]]
    at = place[data]
    longest = np.zeros(len(key), np.int64)
    np.maximum.at(longest, group, length)
    base = np.cumsum(longest) - longest
    known = at < 4
    sums = np.bincount(((base[group[row]] + pos) * 4 + at)[known], weights=w[known], minlength=4 * int(longest.sum())).reshape(-1, 4)
    ords = of("read_ord").to_numpy(zero_copy_only=False)
    n = np.bincount(group, minlength=len(key))
    order = np.lexsort((ords, group))
    first = order[np.cumsum(n) - n]
    return key // (2 * parts), key // 2 % parts, key % 2, n, first, longest, base, sums, ords


def _open_groups(b, starts, part, min_quality, cap):
    """The same as lists of (family, part, strand, arguments of ``_Open.add``)."""
    fam, parts, back, n, first, longest, base, sums, ords = _sum_groups(b, starts, part, min_quality, cap)
    skip = b.column(b.schema.get_field_index("skip")).to_pylist()
    for i in range(len(fam)):
        yield int(fam[i]), int(parts[i]), int(back[i]), (n[i], ords[first[i]], skip[first[i]], longest[i], sums[base[i] : base[i] + longest[i]])


READS = [*FAMILY, "read_ord", "fingerprint", "strand", "seq", "qual", "skip"]


#: Columns of parsed and clustered reads that calling takes.
COLUMNS = [*FAMILY, "read_ord", "fingerprint", "strand", "template_r1", "qual_r1", "template_r2", "qual_r2", "skip_r1"]


def oriented(reads: DataFrame) -> DataFrame:
    """Read 1 of forward reads and read 2 of reverse ones, with what a pass needs."""
    fwd = F.col("strand") == "Forward"
    skip = F.col("skip_r1") if "skip_r1" in reads.columns else F.lit(None)
    more = [c for c in ("part",) if c in reads.columns]
    return reads.select(
        *FAMILY, "read_ord", "fingerprint", "strand", F.when(fwd, F.col("template_r1")).otherwise(F.col("template_r2")).alias("seq"),
        F.when(fwd, F.col("qual_r1")).otherwise(F.col("qual_r2")).alias("qual"), skip.cast("string").alias("skip"), *more,
    )


def call_families(reads: DataFrame, bits: int = BITS, min_quality: int = MIN_BASE_QUALITY, cap: int = MAX_QUALITY) -> DataFrame:
    """(FAMILY, part, fwd_reads, rev_reads, first_ord, skip, consensus_fwd, consensus_rev) of ``READS``, in one pass."""

    def run(batches):
        split, open_ = Splitter(FAMILY, bits), {}  # (part, strand) -> sums of the open family
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            starts, goes_on, part = split.parts(b)
            rows, now = [], {}
            if open_ and not goes_on:
                rows += _rows(key, open_)
                open_ = {}
            for fam, p, back, more in _open_groups(b, starts, part, min_quality, cap):
                if fam == 0 and goes_on:
                    open_.setdefault((p, back), _Open()).add(*more)
                else:
                    now.setdefault(fam, {}).setdefault((p, back), _Open()).add(*more)
            last = len(starts) - 1
            if goes_on and last > 0:
                rows += _rows(key, open_)
                open_ = {}
            for fam, groups in now.items():
                if fam == last:
                    open_ = groups
                else:
                    rows += _rows(_key(b, FAMILY, int(starts[fam])), groups)
            key = split.open
            if rows:
                yield _molecule_batch(rows, cap)
        if open_:
            yield _molecule_batch(_rows(key, open_), cap)

    def _rows(key, groups):
        return [(key, p, groups.get((p, 0)), groups.get((p, 1))) for p in sorted({p for p, _ in groups})]

    return _dealt(reads.select(*READS), FAMILY, "read_ord").mapInArrow(run, CALLED)


def call_deep(reads: DataFrame, counts: DataFrame, bits: int = BITS, min_quality: int = MIN_BASE_QUALITY, cap: int = MAX_QUALITY, deep: int = DEEP) -> DataFrame:
    """``call_families`` for families too deep for a task; ``counts`` (FAMILY, n) has their sizes."""
    seen = reads.groupBy(*FAMILY, "fingerprint").agg(F.min("read_ord").alias("read_ord"))
    parts = written(split_families(seen, bits)).select(*FAMILY, "fingerprint", "part")
    salt = F.pmod(F.xxhash64("read_ord"), F.ceil(F.col("n") / deep)).cast("int")
    rows = reads.join(counts, FAMILY).join(parts, [*FAMILY, "fingerprint"]).withColumn("salt", salt)
    keys = [*FAMILY, "salt"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        open_: dict = {}
        key = None

        def out():
            rows = [(key, p, back, g) for (p, back), g in open_.items()]
            columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(3)] + [
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] == 1 for r in rows]), pa.array([r[3].n for r in rows], pa.int64()), pa.array([r[3].first for r in rows], pa.int64()),
                pa.array([r[3].skip for r in rows], pa.string()), pa.array([r[3].length for r in rows], pa.int32()), pa.array([r[3].sums.ravel() for r in rows], pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUMS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            starts = _families(b, keys)
            part = b.column(b.schema.get_field_index("part")).to_numpy(zero_copy_only=False).astype(np.int64)
            for fam, p, back, more in _open_groups(b, starts, part, min_quality, cap):
                own = _key(b, keys, int(starts[fam]))
                if own != key:
                    if open_:
                        yield out()
                    open_, key = {}, own
                open_.setdefault((p, back), _Open()).add(*more)
        if open_:
            yield out()

    sums = _dealt(rows.select(*READS, "part", "salt"), keys, "read_ord").mapInArrow(run, SUMS)
    # A few rows a strand: positions meet as rows.
    each = sums.select(*FAMILY, "part", "strand", F.posexplode("sums").alias("i", "w")).groupBy(*FAMILY, "part", "strand", "i").agg(F.sum("w").alias("w"))
    four = each.groupBy(*FAMILY, "part", "strand", F.floor(F.col("i") / 4).cast("int").alias("pos")).agg(*(F.sum(F.when(F.col("i") % 4 == j, F.col("w"))).alias(c) for j, c in enumerate("ACGT")))
    total, best = F.col("A") + F.col("C") + F.col("G") + F.col("T"), F.greatest("A", "C", "G", "T")
    base = F.when(total <= 0, "N").when(F.col("A") == best, "A").when(F.col("C") == best, "C").when(F.col("G") == best, "G").otherwise("T")
    err = F.when(total <= 0, 1.0).otherwise(F.greatest(1 - F.try_divide(best, total), F.lit(10.0 ** (-cap / 10))))
    called = four.select(*FAMILY, "part", "strand", F.struct("pos", base.alias("base"), err.alias("err")).alias("p"))
    called = called.groupBy(*FAMILY, "part", "strand").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    called = called.select(*FAMILY, "part", "strand", F.struct(F.array_join("ps.base", "").alias("seq"), F.col("ps.err").alias("err")).alias("c"))
    of = sums.groupBy(*FAMILY, "part", "strand").agg(F.sum("n").alias("n"), F.min(F.struct("first_ord", "skip")).alias("f"))
    both = of.join(called, [*FAMILY, "part", "strand"], "left")
    side = lambda back, c: F.first(F.when(F.col("strand") == back, F.col(c)), ignorenulls=True)
    both = both.groupBy(*FAMILY, "part").agg(F.coalesce(side(False, "n"), F.lit(0)).alias("fwd_reads"), F.coalesce(side(True, "n"), F.lit(0)).alias("rev_reads"), F.min("f").alias("f"), side(False, "c").alias("consensus_fwd"), side(True, "c").alias("consensus_rev"))
    return both.select(*FAMILY, "part", "fwd_reads", "rev_reads", F.col("f.first_ord").alias("first_ord"), F.col("f.skip").alias("skip"), "consensus_fwd", "consensus_rev")


def called(reads: DataFrame, bits: int = BITS, min_quality: int = MIN_BASE_QUALITY, cap: int = MAX_QUALITY, deep: int = DEEP) -> DataFrame:
    """Families' parts with their counts and strands' consensus, from clustered reads (``seed_a``, ``seed_b``) of any depth.

    ``bits`` of 64 keeps families whole. ``reads`` is read twice: once for the
    sizes of families, which a task adds up before they meet, and once for the
    pass.
    """
    rows = oriented(reads)
    hot = written(reads.groupBy(*FAMILY).agg(F.count("*").alias("n")).where(F.col("n") > deep))
    if hot.isEmpty():
        return call_families(rows, bits, min_quality, cap)
    usual = rows.join(hot.select(*FAMILY), FAMILY, "left_anti")
    return call_families(usual, bits, min_quality, cap).unionByName(call_deep(rows, hot, bits, min_quality, cap, deep))


def molecules(reads: DataFrame, min_family_size: int = 1, **calling) -> DataFrame:
    """``called`` families that are large enough, with their type, a stable id and, for duplexes, both strands' consensus."""
    out = called(reads, **calling).where(F.col("fwd_reads") + F.col("rev_reads") >= min_family_size)
    out = out.withColumns({"family_type": S.family_type(F.col("fwd_reads"), F.col("rev_reads")), "molecule_id": S.stable_hash(*(F.col(c) for c in (*FAMILY, "part")))})
    if "skip_r1" not in reads.columns:
        out = out.drop("skip")
    duplex = duplex_consensus(F.col("consensus_fwd.seq"), F.col("consensus_fwd.err"), F.col("consensus_rev.seq"), F.col("consensus_rev.err"))
    return out.withColumn("duplex_consensus", F.when(F.col("family_type") == "Duplex", duplex))
