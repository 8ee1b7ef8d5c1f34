"""Clusters of long UMIs: a similarity join by shared segments, and the greedy rule as rounds over its sparse graph."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.shared import written

NODE = ["sample_id", "umi_a", "umi_b"]
#: Segments beyond the distance, at most; letters of both UMIs that are compared in blocks, their rows a task and pairs at once.
MORE_PARTS, SHORT, BLOCK_ROWS, AT_ONCE = 3, 12, 500_000, 1 << 19
PAIRS = "sample_id string, umi_a_1 string, umi_b_1 string, n_1 long, first_ord_1 long, umi_a_2 string, umi_b_2 string, n_2 long, first_ord_2 long, distance int"


def segments(length, parts: int):
    """(first letter, letters) of each of ``parts`` nearly equal segments, as columns of a length."""
    ends = [F.floor(length * i / parts).cast("int") for i in range(parts + 1)]
    return [(a + 1, b - a) for a, b in zip(ends, ends[1:])]


def parts_for(rows: int, length: int, distance: int) -> int:
    """Segments to cut texts into so that ``rows`` random ones rarely agree in all but ``distance`` of them."""
    parts = distance + 1
    while parts < distance + MORE_PARTS and 4 ** (length * (parts - distance) / parts) < rows:
        parts += 1
    return parts


def in_blocks(counts: DataFrame, rows: int, parts: int, distance: int, by_text: bool) -> DataFrame:
    """``neighbours`` of short UMIs: those of an equal choice of segments come as one list, whose pairs are compared many at once.

    A list has no more rows than there are texts for the letters beyond its
    choice, whatever the depth. Lists come in order, so that a pair's first is
    above its second. A pair counts in the first choice that it shares: where it
    differs in all segments that come before the choice's last and are not in it.
    """
    import pyarrow as pa

    choices = list(combinations(range(parts), parts - distance))
    before = [[i for i in range(max(c, default=0)) if i not in c] for c in choices]
    whole = F.concat("umi_a", "umi_b")
    cut = [F.substring(whole, a, n) for a, n in segments(F.length(whole), parts)]
    keys = F.posexplode(F.array(*(F.concat(F.lit(""), *(cut[i] for i in c)) for c in choices))).alias("at", "segment")
    own = F.struct(*([] if by_text else [(-F.col("n")).alias("o"), "first_ord"]), "umi_a", "umi_b", *([F.col("n"), F.col("first_ord")] if by_text else []))
    by = ["sample_id", "la", "lb", "at", "segment"]
    given = counts.dropna(subset=NODE).select("sample_id", F.length("umi_a").alias("la"), F.length("umi_b").alias("lb"), own.alias("u"), keys)
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, -(-rows * len(choices) // BLOCK_ROWS))
    lists = given.repartition(tasks, *by).groupBy(*by).agg(F.sort_array(F.collect_list("u")).alias("u")).where(F.size("u") > 1).select("sample_id", (F.col("la") + F.col("lb")).alias("length"), "at", "u")
    names = [x.split()[0] for x in PAIRS.split(", ")]

    def compare(batches):
        import numpy as np

        has = np.array([[i in b for i in range(parts)] for b in before])
        for batch in batches:
            flat = batch.column(3).flatten()
            columns = dict(zip((f.name for f in flat.type), flat.flatten()))
            columns["n"] = columns["n"] if by_text else pa.array(-columns["o"].to_numpy(zero_copy_only=False))
            sample, (length, at, n) = batch.column(0), (np.asarray(c) for c in (batch.column(1), batch.column(2), batch.column(3).value_lengths()))
            group = np.repeat(np.arange(len(n)), n)
            texts = [(a + b).ljust(SHORT, "\0") for a, b in zip(columns["umi_a"].to_pylist(), columns["umi_b"].to_pylist())]
            kinds, letters = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
            # Letters as numbers of so many bits, packed into words.
            bits = 4 if len(kinds) <= 16 else 32
            per = 64 // bits
            letters = letters.reshape(-1, SHORT).astype(np.uint64)
            packed = [sum(letters[:, p] << np.uint64(bits * (p - w)) for p in range(w, min(w + per, SHORT))) for w in range(0, SHORT, per)]
            ones = sum(1 << bits * p for p in range(per))
            masks = np.zeros((len(packed), SHORT + 1, parts), np.uint64)
            for size in range(SHORT + 1):
                for i in range(parts):
                    for p in range(size * i // parts, size * (i + 1) // parts):
                        masks[p // per, size, i] |= np.uint64(1 << bits * (p % per))
            later = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(group))
            upto = np.concatenate([[0], np.cumsum(later)])
            low = 0
            while low < len(group):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + AT_ONCE, "right")) - 1)
                one = np.repeat(np.arange(low, high), later[low:high])
                two = one + 1 + np.arange(len(one)) - (upto[one] - upto[low])
                low = high
                differing = []
                for word in packed:
                    x = word[one] ^ word[two]
                    for shift in (16, 8, 4, 2, 1):
                        if shift < bits:
                            x |= x >> np.uint64(shift)
                    differing.append(x & np.uint64(ones))
                d = sum(np.bitwise_count(x) for x in differing)
                near = np.flatnonzero(d <= distance)
                one, two, d, differing = one[near], two[near], d[near], [x[near] for x in differing]
                new = np.ones(len(one), bool)
                for i in range(parts):
                    apart = np.logical_or.reduce([(x & m[length[group[one]], i]) != 0 for x, m in zip(differing, masks)])
                    new &= apart | ~has[at[group[one]], i]
                one, two, d = one[new], two[new], d[new]
                if len(one):
                    sides = [columns[c].take(pa.array(x)) for x in (one, two) for c in ("umi_a", "umi_b", "n", "first_ord")]
                    yield pa.RecordBatch.from_arrays([sample.take(pa.array(group[one])), *sides, pa.array(d.astype(np.int32))], names)

    return lists.mapInArrow(compare, PAIRS)


def neighbours(counts: DataFrame, distance: int = 1, by_text: bool = False) -> DataFrame:
    """Pairs (``_1`` the one that comes first, or ``by_text`` the smaller one) of a sample's UMI pairs within a Hamming distance.

    Two texts that differ in ``distance`` places agree in all but as many of
    any number of segments, so pairs meet only by equal choices of these, and
    only by the first one that they share. The more UMIs there are, the more
    segments a choice has, so that chance agreements stay as rare as rows. UMIs
    of other lengths are no neighbours.
    """
    counts = written(counts.select(*NODE, "n", "first_ord"))
    size = counts.agg(F.count("*").alias("n"), F.max(F.length("umi_a") + F.length("umi_b")).alias("length")).first()
    parts, words = parts_for(size.n, size.length or 0, distance), max(1, -(-(size.length or 0) // S.WORD))
    if (size.length or 0) <= SHORT:
        return in_blocks(counts, size.n, parts, distance, by_text)
    choices = list(combinations(range(parts), parts - distance))
    cut = lambda whole: [F.substring(whole, a, n) for a, n in segments(F.length(whole), parts)]
    whole = F.concat("umi_a", "umi_b")
    keys = F.array(*(F.concat(*(cut(whole)[i] for i in c)) for c in choices))
    rows = counts.select("*", F.length("umi_a").alias("la"), F.length("umi_b").alias("lb"), S.text_words(whole, words).alias("words"), F.posexplode(keys).alias("at", "segment"))
    side = lambda i: rows.select("sample_id", "la", "lb", "at", "segment", *(F.col(c).alias(f"{c}_{i}") for c in ("umi_a", "umi_b", "n", "first_ord", "words")))
    both = side(1).join(side(2).hint("merge"), ["sample_id", "la", "lb", "at", "segment"])
    order = lambda i: F.struct(*([] if by_text else [-F.col(f"n_{i}"), f"first_ord_{i}"]), f"umi_a_{i}", f"umi_b_{i}")
    differing = S.differing_bytes(F.col("words_1"), F.col("words_2"), words)  # null but for ASCII, where it is the distance
    near = F.coalesce(differing <= distance, F.lit(True))
    same = [x == y for x, y in zip(*(cut(F.concat(f"umi_a_{i}", f"umi_b_{i}")) for i in (1, 2)))]
    shared = F.coalesce(*(F.when(reduce(lambda x, y: x & y, (same[i] for i in c)), n) for n, c in enumerate(choices)))
    both = both.where(F.when(order(1) < order(2), F.when(near, shared == F.col("at"))))
    d = F.coalesce(differing.cast("int"), S.umi_distance(F.col("umi_a_1"), F.col("umi_b_1"), F.col("umi_a_2"), F.col("umi_b_2")))
    names = ("umi_a_1", "umi_b_1", "n_1", "first_ord_1", "umi_a_2", "umi_b_2", "n_2", "first_ord_2")
    return both.select("sample_id", *names, d.alias("distance")).where(F.col("distance") <= distance)


def seeds(links: DataFrame) -> DataFrame:
    """The seeds among the nodes of ``links``, whose ``_1`` comes before ``_2``: a node is one unless a neighbour before it is.

    A round takes all nodes whose neighbours before them are decided; links of
    decided nodes go. Each round is written, and only its emptiness is asked for.
    """
    names = lambda i: [F.col("sample_id"), F.col(f"umi_a_{i}").alias("umi_a"), F.col(f"umi_b_{i}").alias("umi_b")]
    first, second = ["sample_id", "umi_a_1", "umi_b_1"], ["sample_id", "umi_a_2", "umi_b_2"]
    left = written(links.select(*first, *second[1:]))
    open_ = written(left.select(*names(1)).union(left.select(*names(2))).distinct())
    found = None
    while not open_.isEmpty():
        new = written(open_.join(left.select(*names(2)), NODE, "left_anti"))
        found = new if found is None else found.union(new)
        taken = left.join(new.toDF(*first), first, "left_semi")
        gone = written(taken.select(*names(2)).distinct())
        open_ = written(open_.join(new, NODE, "left_anti").join(gone, NODE, "left_anti"))
        left = written(left.join(gone.toDF(*second), second, "left_anti").join(gone.toDF(*first), first, "left_anti"))
    return written(found) if found is not None else open_


def cluster_umis(counts: DataFrame, distance: int = 1) -> DataFrame:
    """``counts`` (sample_id, umi_a, umi_b, n, first_ord) with the seed's UMI pair (``seed_a``, ``seed_b``).

    The greedy rule without buckets, for UMIs of any length: most reads first,
    then first come; each joins the first seed within the distance, else it is
    a seed. No group is worked through by one task.
    """
    rows = counts.select(*NODE, "n", "first_ord")
    if distance <= 0:
        return rows.withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b")})
    links = written(neighbours(rows, distance))
    own = seeds(links)
    one = own.select("sample_id", F.col("umi_a").alias("umi_a_1"), F.col("umi_b").alias("umi_b_1"))
    two = own.select("sample_id", F.col("umi_a").alias("umi_a_2"), F.col("umi_b").alias("umi_b_2"))
    joined = links.join(one, one.columns, "left_semi").join(two, two.columns, "left_anti")
    best = F.min(F.struct((-F.col("n_1")).alias("n"), F.col("first_ord_1").alias("o"), F.col("umi_a_1").alias("a"), F.col("umi_b_1").alias("b")))
    joined = joined.groupBy("sample_id", F.col("umi_a_2").alias("umi_a"), F.col("umi_b_2").alias("umi_b")).agg(best.alias("s"))
    out = rows.join(joined, NODE, "left")
    return out.select(*rows.columns, F.coalesce("s.a", "umi_a").alias("seed_a"), F.coalesce("s.b", "umi_b").alias("seed_b"))
