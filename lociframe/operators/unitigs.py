"""Graphs of unbranched stretches: k-mer chains contracted by joins, and walks over what is left.

Graphs that a task can hold are contracted where their k-mers meet. In larger
ones a chain is contracted by pointer doubling: each k-mer points at the one
before it, and pointing on to where that one points halves the distance to the
chain's head, so a chain of n k-mers takes log2(n) joins whatever task its
k-mers are in. A target's group then has branching points instead of k-mers.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.shared import written
from .graph import EXTRA_LENGTH, MAX_EXPANSIONS, MAX_PATHS, PATHS, SOFT_REACH, by_graph, spelled

GRAPH = ["sample_id", "target_id"]
CHAINS = "sample_id string, target_id string, head string, last string, seq string, n_kmers int, n long"
#: Fixed value: k-mers of a graph that is contracted in one task.
HELD = 200_000


def anchors(targets: DataFrame, nodes: DataFrame, k: int = 31, reach: int = SOFT_REACH) -> DataFrame:
    """(sample_id, target_id, seq, at_start, at_end, limit): places of a target's first and last k-mer that are in the graph, not further inward than ``reach``."""
    t = targets.select("target_id", F.upper("seq").alias("seq"), S.path_limit(F.col("target_id")).alias("limit"))
    n = F.length("seq") - k + 1
    places = t.where(n > 0).withColumn("at", F.explode(F.array_distinct(F.flatten(F.array(F.sequence(F.lit(0), F.least(F.lit(reach), n - 1)), F.sequence(F.greatest(F.lit(0), n - 1 - reach), n - 1))))))
    places = places.withColumn("kmer", F.substring(F.col("seq"), F.col("at") + 1, F.lit(k))).join(nodes.select(*GRAPH, "kmer"), ["target_id", "kmer"])
    found = places.groupBy(*GRAPH, "seq", "limit").agg(
        F.min(F.when(F.col("at") <= reach, F.col("at"))).alias("at_start"), F.max(F.when(F.col("at") >= n - 1 - reach, F.col("at"))).alias("at_end")
    )
    return found.where("at_start < at_end").withColumns({
        "start": F.substring(F.col("seq"), F.col("at_start") + 1, F.lit(k)), "end": F.substring(F.col("seq"), F.col("at_end") + 1, F.lit(k)),
        "limit": F.coalesce("limit", n + EXTRA_LENGTH),
    })


def chains_of(counts: dict[str, int], starts: set[str], stops: set[str]) -> list[list[str]]:
    """The unbranched chains of a graph's k-mers, but for rings; a chain begins at a start and is over at a stop."""
    fronts: dict[str, list[str]] = {}
    backs: dict[str, int] = {}
    for x in counts:
        fronts.setdefault(x[:-1], []).append(x)
        backs[x[1:]] = backs.get(x[1:], 0) + 1
    follows = {}
    for x in counts:
        after = fronts.get(x[1:], ())
        if len(after) == 1 and backs[x[1:]] == 1 and after[0] != x and after[0] not in starts and x not in stops:
            follows[x] = after[0]
    out = []
    for x in counts.keys() - follows.values():
        chain = [x]
        while (x := follows.get(x)) is not None:
            chain.append(x)
        out.append(chain)
    return out


def unitigs(nodes: DataFrame, ends: DataFrame, k: int = 31) -> DataFrame:
    """(sample_id, target_id, head, last, seq, n_kmers, n): the unbranched chains of each graph, ``n`` their least count.

    ``nodes`` has sample_id, target_id, kmer and n, ``ends`` the start and end
    of each graph: a chain begins at the start and is over at the end. Rings
    without a way in, which no walk can reach, are left out.
    """
    nodes, ends = nodes.select(*GRAPH, "kmer", "n"), ends.select(*GRAPH, "start", "end")
    large = written(nodes.groupBy(*GRAPH).agg(F.count("*").alias("n")).where(F.col("n") > HELD).select(*GRAPH))
    if large.isEmpty():
        return held_chains(nodes, ends)
    return held_chains(nodes.join(large, GRAPH, "left_anti"), ends).unionByName(joined_chains(nodes.join(large, GRAPH, "left_semi"), ends, k))


def held_chains(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``unitigs`` of graphs of at most ``HELD`` k-mers, each in a task."""

    def group(key, ends, kmer, n):
        counts = dict(zip(kmer, n))
        found = chains_of(counts, {e["start"] for e in ends}, {e["end"] for e in ends})
        return [(*key, c[0], c[-1], spelled(c), len(c), min(counts[x] for x in c)) for c in found]

    # A graph without ends has its chains as well.
    none = F.lit(None).cast("string")
    given = ends.unionByName(nodes.select(*GRAPH).distinct().select(*GRAPH, none.alias("start"), none.alias("end")))
    return by_graph(given, nodes, ["kmer", "n"], group, CHAINS)


def joined_chains(nodes: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """``unitigs`` of graphs of any size, by joins."""
    a = nodes.select(*GRAPH, F.col("kmer").alias("src"), F.right("kmer", F.lit(k - 1)).alias("mid"))
    b = nodes.select(*GRAPH, F.col("kmer").alias("dst"), F.substring("kmer", 1, k - 1).alias("mid"))
    edges = written(a.join(b, [*GRAPH, "mid"]).select(*GRAPH, "src", "dst"))
    one_out = edges.groupBy(*GRAPH, "src").agg(F.count("*").alias("outs"), F.min("dst").alias("dst")).where("outs = 1").drop("outs")
    one_in = edges.groupBy(*GRAPH, "dst").agg(F.count("*").alias("ins"), F.min("src").alias("src")).where("ins = 1").drop("ins")
    starts = ends.select(*GRAPH, F.col("start").alias("dst"))
    stops = ends.select(*GRAPH, F.col("end").alias("src"))
    before = one_out.join(one_in, [*GRAPH, "src", "dst"]).where("src <> dst").join(starts, [*GRAPH, "dst"], "left_anti").join(stops, [*GRAPH, "src"], "left_anti")
    before = before.select(*GRAPH, F.col("dst").alias("kmer"), F.col("src").alias("to"))
    at = nodes.join(before, [*GRAPH, "kmer"], "left")
    at = written(at.select(*GRAPH, "kmer", "n", F.coalesce("to", "kmer").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    most = at.groupBy(*GRAPH).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        on = at.select(*GRAPH, F.col("kmer").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        step = at.join(on, [*GRAPH, "to"]).select(*GRAPH, "kmer", "n", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("more").alias("moved"))
        step = written(step)
        at = step.drop("moved")
        if step.where("moved > 0").isEmpty():
            break
    heads = at.where("steps = 0").select(*GRAPH, F.col("kmer").alias("to"))
    chains = at.join(heads, [*GRAPH, "to"], "left_semi").groupBy(*GRAPH, "to")
    chains = chains.agg(F.sort_array(F.collect_list(F.struct("steps", "kmer"))).alias("c"), F.min("n").alias("n"))
    tail = F.array_join(F.transform(F.slice("c.kmer", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda x: F.right(x, F.lit(1))), "")
    seq = F.concat(F.col("to"), F.when(F.size("c") > 1, tail).otherwise(""))
    return chains.select(*GRAPH, F.col("to").alias("head"), F.element_at("c.kmer", -1).alias("last"), seq.alias("seq"), F.size("c").alias("n_kmers"), "n")


def walk(start: str, end: str, size: dict[str, int], after: dict[str, list[str]], max_length: int, max_paths: int = MAX_PATHS, max_expansions: int = MAX_EXPANSIONS):
    """Simple paths of chains from one to another as lists of their heads, and whether a budget ended the walk.

    ``size`` has each chain's k-mers, ``after`` what follows it. Chains from which
    the end is further than ``max_length`` allows are not entered.
    """
    before: dict[str, list[str]] = {}
    for a, bs in after.items():
        for b in bs:
            before.setdefault(b, []).append(a)
    left, heap = {}, [(size[end], end)]
    while heap:  # least k-mers from a chain's first one to the end
        d, x = heapq.heappop(heap)
        if x in left or d > max_length:
            continue
        left[x] = d
        for y in before.get(x, ()):
            if y not in left:
                heapq.heappush(heap, (d + size[y], y))
    if start not in left:
        return [], False
    if start == end:
        return [[start]], False
    paths, path, seen, length, spent = [], [start], {start}, size[start], 0
    stack = [iter(after.get(start, ()))]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            gone = path.pop()
            seen.discard(gone)
            length -= size[gone]
            continue
        spent += 1
        if spent > max_expansions:
            return paths, True
        if x in seen or x not in left or length + left[x] > max_length:
            continue
        if x == end:
            paths.append([*path, end])
            if len(paths) >= max_paths:
                return paths, True
            continue
        path.append(x)
        seen.add(x)
        length += size[x]
        stack.append(iter(after.get(x, ())))
    return paths, False


def walk_paths(targets: DataFrame, nodes: DataFrame, k: int = 31, max_paths: int = MAX_PATHS, max_expansions: int = MAX_EXPANSIONS) -> DataFrame:
    """The paths of ``graph.walk_paths``, found over contracted chains; budgets count chains."""
    ends = written(anchors(targets, nodes, k))
    chains = unitigs(nodes, ends, k)

    def group(key, ends, head, last, seq, n_kmers):
        rows, size, spelt = [], dict(zip(head, n_kmers)), dict(zip(head, seq))
        heads: dict[str, list[str]] = {}
        for h in sorted(size):
            heads.setdefault(h[: k - 1], []).append(h)
        after = {h: heads.get(x[1:], []) for h, x in zip(head, last)}
        ending = dict(zip(last, head))
        for t in ends:
            if t["start"] not in size or t["end"] not in ending:
                continue
            found, spent = walk(t["start"], ending[t["end"]], size, after, int(t["limit"]), max_paths, max_expansions)
            reference = False
            for p in found:
                whole = t["seq"][: t["at_start"]] + spelt[p[0]] + "".join(spelt[x][k - 1 :] for x in p[1:]) + t["seq"][t["at_end"] + k :]
                is_ref = not reference and whole == t["seq"]
                reference |= is_ref
                rows.append((*key, whole, is_ref, sum(size[x] for x in p), spent))
        return rows

    return by_graph(ends, written(chains), ["head", "last", "seq", "n_kmers"], group, PATHS)
