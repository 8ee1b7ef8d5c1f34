"""Candidate paths through a target's k-mers: graph, bounded walk, ranking, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.codes import _windows, kmer_code, spelled_codes
from ..sources.shared import written
from .kmers import family_counts, is_coded, lookup, merge

#: Bounds of a walk, and of each walk that leaves the reference path.
MAX_PATHS, EXTRA_LENGTH, MAX_EXPANSIONS, JUNCTION_EXTRA, SOFT_REACH = 100, 50, 2_000_000, 250, 10
SUB_EXPANSIONS = 300_000
#: Rows of ids or k-mers that may be sent to every task; k-mers of graphs that are dealt to one task.
FEW, DEALT = 100_000, 200_000


_TURN = str.maketrans("ACGT", "TGCA")


def edges(nodes: DataFrame, k: int) -> DataFrame:
    """(src, dst) of the de Bruijn graph: a node's last k - 1 letters are the next one's first."""
    a = nodes.select(F.col("kmer").alias("src"), F.right("kmer", F.lit(k - 1)).alias("mid"))
    b = nodes.select(F.col("kmer").alias("dst"), F.substring("kmer", 1, k - 1).alias("mid"))
    return a.join(b, "mid").select("src", "dst")


def target_nodes(targets: DataFrame, occurrences: DataFrame, k: int = 31, least: int = 2, molecules: DataFrame | None = None) -> DataFrame:
    """(sample_id, target_id, kmer, n): raw k-mers, in both orientations, of the molecules that touch a target.

    ``occurrences`` has sample_id, molecule_id and kmer (canonical, or its code).
    Counts are over all molecules. A target sees its own molecules' k-mers, so
    no task needs the whole index. A written table of few different k-mers is a
    small file of many rows: it is never sent whole, whatever its size says.
    Given the ``molecules`` (sample_id, molecule_id, seq) that coded occurrences
    were cut from, those that touch a target are found as sequences and cut
    again, so that many of them shuffle letters and not k-mers.
    """
    coded = is_coded(occurrences)
    wanted = S.explode_codes(targets.select("target_id", "seq"), "seq", k) if coded else S.explode_kmers(targets.select("target_id", "seq"), "seq", k)
    wanted = written(wanted.select("target_id", "kmer").distinct())
    # Molecules are found through the distinct k-mers of targets, which are few for a panel.
    few = wanted.count() <= FEW
    touched = written(occurrences.join(F.broadcast(wanted) if few else wanted.hint("merge"), "kmer").select("sample_id", "molecule_id", "target_id").distinct())
    some = touched.count() <= FEW
    near = (occurrences if molecules is None or not coded else molecules).join(F.broadcast(touched) if some else touched.hint("merge"), ["sample_id", "molecule_id"])
    if "kmer" not in near.columns:
        near = S.explode_codes(near.select("sample_id", "target_id", "seq"), "seq", k, distinct=True)
    near = written(near.select("sample_id", "target_id", "kmer").distinct())
    # Only k-mers that some target sees are counted, so all others meet no shuffle.
    seen = near.select("sample_id", "kmer").distinct()
    counted = occurrences.join(F.broadcast(seen) if near.count() <= FEW else seen.hint("merge"), ["sample_id", "kmer"], "left_semi")
    counted = counted.groupBy("sample_id", "kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    near = near.join(counted.hint("merge"), ["sample_id", "kmer"])
    if coded:
        near = near.withColumn("kmer", spelled_codes(F.col("kmer"), k))
    both = F.explode(F.array_distinct(F.array("kmer", S.reverse_complement(F.col("kmer")))))
    return near.select("sample_id", "target_id", both.alias("kmer"), "n")


def own_nodes(molecules: DataFrame, k: int = 31) -> DataFrame:
    """(sample_id, target_id, kmer, n): raw k-mers of each target's own molecules (sample_id, target_id, seq), and counts by family type if they have it.

    Molecules of one sequence meet before they are cut, so the k-mers that are
    grouped grow with different sequences and not with depth.
    """
    counts = family_counts()[1:] if "family_type" in molecules.columns else []
    different = molecules.groupBy("sample_id", "target_id", "seq").agg(F.count("*").alias("n"), *counts)
    rows = S.explode_kmers(different, "seq", k, canonical=None, raw="kmer")
    return rows.groupBy("sample_id", "target_id", "kmer").agg(*(F.sum(c).alias(c) for c in different.columns[3:]))


def index_of_nodes(nodes: DataFrame, k: int = 31, coded: bool = False) -> DataFrame:
    """The index (``kmers.index_of``) of the molecules whose ``own_nodes``, with counts by family type, these are; no molecule is cut again."""
    kmer = kmer_code(F.col("kmer"), k) if coded else S.canonical(F.col("kmer"))
    return merge(nodes.select("sample_id", kmer.alias("kmer"), F.col("n").alias("n_molecules"), "n_duplex", "n_simplex_fwd", "n_simplex_rev"))


def walk(start: str, end: str, counts: dict[str, int], max_length: int, max_paths: int = MAX_PATHS, max_expansions: int = MAX_EXPANSIONS, by_evidence: bool = False):
    """Simple paths from start to end as lists of k-mers, and whether the budget ended the walk.

    Depth first, successors by letter or by evidence. A first pass backwards
    from the end gives each node its least distance to it; nodes that cannot
    arrive within ``max_length`` k-mers are not entered.
    """
    if start not in counts or end not in counts:
        return [], False
    left, layer, far = {end: 0}, [end], 0
    while layer and far < max_length:
        far += 1
        before = []
        for n in layer:
            front = n[:-1]
            for b in "ACGT":
                p = b + front
                if p in counts and p not in left:
                    left[p] = far
                    before.append(p)
        layer = before
    if start not in left or left[start] + 1 > max_length:
        return [], False
    nexts: dict[str, list[str]] = {}

    def following(n: str) -> list[str]:
        if n not in nexts:
            back = n[1:]
            out = [m for b in "ACGT" if (m := back + b) in left]
            nexts[n] = sorted(out, key=lambda m: -counts[m]) if by_evidence else out
        return nexts[n]

    paths, path, seen, spent = [], [start], {start}, 0
    stack = [iter(following(start))]
    if start == end:
        return [[start]], False
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            seen.discard(path.pop())
            continue
        spent += 1
        if spent > max_expansions:
            return paths, True
        if node in seen or len(path) + 1 + left[node] > max_length:
            continue
        if node == end:
            paths.append([*path, end])
            if len(paths) >= max_paths:
                return paths, True
            continue
        path.append(node)
        seen.add(node)
        stack.append(iter(following(node)))
    return paths, False


def off_reference(reference: list[str], counts: dict[str, int], max_length: int, max_expansions: int = MAX_EXPANSIONS, sub_expansions: int = SUB_EXPANSIONS, by_evidence: bool = False):
    """(left, right, k-mers between) of each stretch that leaves the reference path at one place and rejoins it further on, and whether a budget ended a walk.

    Each branch of a place is walked depth first, over nodes that are not of the
    reference, with ``sub_expansions`` steps of its own; a branch that spends
    them ends without the others being lost. Nodes from which the reference
    cannot be reached again within ``max_length`` k-mers, the whole path's
    length, are not entered. A k-mer that the reference repeats is rejoined at
    its first place after the one left.
    """
    places: dict[str, list[int]] = {}
    for i, x in enumerate(reference):
        places.setdefault(x, []).append(i)
    n = len(reference)
    # Steps from a node back to the reference, by layers.
    back, layer, far = {}, [x for x in places if x in counts], 0
    while layer and far < max_length:
        far += 1
        layer = list(dict.fromkeys(b + x[:-1] for x in layer for b in "ACGT"))
        layer = [x for x in layer if x in counts and x not in places and x not in back]
        back.update(dict.fromkeys(layer, far))

    def following(x: str) -> list[str]:
        out = [x[1:] + b for b in "ACGT" if x[1:] + b in counts]
        return sorted(out, key=lambda y: -counts[y]) if by_evidence else out

    found, total, ended = [], 0, False
    for i in range(n - 1):
        if reference[i] not in counts:
            continue
        for branch in following(reference[i]):
            if branch == reference[i + 1]:
                continue
            path, seen, spent, stack = [], set(), 0, [iter([branch])]
            while stack:
                node = next(stack[-1], None)
                if node is None:
                    stack.pop()
                    if path:
                        seen.discard(path.pop())
                    continue
                spent += 1
                total += 1
                if spent > sub_expansions or total > max_expansions:
                    ended = True
                    break
                if node in places:
                    j = next((j for j in places[node] if j > i), None)
                    if j is not None and i + 1 + len(path) + n - j <= max_length:
                        found.append((i, j, list(path)))
                    continue
                # At best the end of the reference is what is rejoined.
                if node in seen or node not in back or i + 2 + len(path) + back[node] > max_length:
                    continue
                path.append(node)
                seen.add(node)
                stack.append(iter(following(node)))
            if total > max_expansions:
                return found, True
    return found, ended


def spelled(kmers: list[str]) -> str:
    return kmers[0] + "".join(x[-1] for x in kmers[1:]) if kmers else ""


def soft_anchors(seq: str, k: int, counts: dict[str, int], reach: int = SOFT_REACH) -> tuple[int, int] | None:
    """Places of the first and last k-mer of a target that are in the graph, not further inward than ``reach``."""
    n = len(seq) - k + 1
    if n < 1:
        return None
    start = next((i for i in range(min(reach + 1, n)) if seq[i : i + k] in counts), None)
    end = next((n - 1 - i for i in range(min(reach + 1, n)) if seq[n - 1 - i : n - 1 - i + k] in counts), None)
    return None if start is None or end is None or start >= end else (start, end)


PATHS = "sample_id string, target_id string, path_seq string, is_reference boolean, n_kmers int, budget_hit boolean"
ALTERNATIVES = "sample_id string, target_id string, left int, right int, stretch string, path_seq string, n_kmers int, budget_hit boolean"


def length_limit(limit, seq: str, k: int, extra: int = 0) -> int:
    """Most k-mers of a target's path: its id's, else its own length and some more."""
    return int(limit) if limit is not None else len(seq) - (k - 1) + EXTRA_LENGTH + extra


def by_graph(given: DataFrame, parts: DataFrame, names: list[str], group, schema: str, keys: tuple[str, ...] = ("sample_id", "target_id"), size: int | None = None) -> DataFrame:
    """``group`` over each graph (``keys``): its rows of ``given`` as dicts, and ``names`` of ``parts``, ``size`` rows at most, as lists.

    Graphs meet in one shuffle as a row of lists each and are walked one after
    the other, as many to a task as hold some ``DEALT`` parts: adaptive plans
    count bytes, not walks, and would give all to a few tasks.
    """
    import pyarrow as pa

    spark = parts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-(parts.count() if size is None else size) // DEALT))
    own = [c for c in given.columns if c not in keys]
    left = given.select(*keys, F.struct(*own).alias("__given"), F.lit(None).cast(parts.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("__part"))
    right = parts.select(*keys, F.lit(None).cast(left.schema["__given"].dataType).alias("__given"), F.struct(*names).alias("__part"))
    lists = left.union(right).repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list("__given").alias("__given"), F.collect_list("__part").alias("__part"))
    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}
    at_given, at_part = len(keys), len(keys) + 1
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                part = b.column(at_part)
                begin = [0, *part.value_lengths().to_pylist()]
                flat = part.flatten()
                columns = [flat.field(i).to_pylist() if flat.offset == 0 else flat.flatten()[i].to_pylist() for i in range(len(names))]
                out, low = [], 0
                for *key, rows, n in zip(*(b.column(i).to_pylist() for i in range(at_given + 1)), begin[1:]):
                    if rows and n:
                        out += group(tuple(key), rows, *(c[low : low + n] for c in columns))
                    low += n
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return lists.mapInArrow(run, schema)


def by_target(targets: DataFrame, nodes: DataFrame, group, schema: str) -> DataFrame:
    """``group`` over each sample's targets (seq, limit) and their nodes' k-mers and counts."""
    samples = nodes.select(F.col("sample_id").alias("sample_id"), F.col("target_id").alias("target_id")).distinct()  # columns of its own
    wanted = targets.select("target_id", "seq", S.path_limit(F.col("target_id")).alias("limit")).join(samples.hint("merge"), "target_id")
    return by_graph(wanted.select("sample_id", "target_id", "seq", "limit"), nodes, ["kmer", "n"], group, schema)


def find_alternatives(targets: DataFrame, nodes: DataFrame, k: int = 31, max_expansions: int = MAX_EXPANSIONS, sub_expansions: int = SUB_EXPANSIONS, by_evidence: bool = False, extra: int = 0) -> DataFrame:
    """Stretches that leave a target's own path and rejoin it, each joined into the target as a path of its own.

    ``left`` and ``right`` are the places of the k-mers left and rejoined,
    ``stretch`` has the letters between. Stretches of one path that don't
    overlap are rows of their own and are not combined.
    """

    def group(key, given, nodes, n):
        counts = dict(zip(nodes, n))
        rows = []
        for t in given:
            seq = t["seq"].upper()
            reference = [seq[i : i + k] for i in range(len(seq) - k + 1)]
            found, spent = off_reference(reference, counts, length_limit(t["limit"], seq, k, extra), max_expansions, sub_expansions, by_evidence)
            for i, j, between in found:
                whole = spelled([*reference[: i + 1], *between, *reference[j:]])
                rows.append((*key, i, j, "".join(x[-1] for x in between), whole, i + 1 + len(between) + len(reference) - j, spent))
        return rows

    return by_target(targets, nodes, group, ALTERNATIVES)


def walk_paths(targets: DataFrame, nodes: DataFrame, k: int = 31, max_paths: int = MAX_PATHS, max_expansions: int = MAX_EXPANSIONS, by_evidence: bool = False, extra: int = 0, sub_expansions: int = SUB_EXPANSIONS) -> DataFrame:
    """Paths of each sample's targets: one walk per group, in its own task.

    Targets need target_id and seq. Their length, an id's ``_maxpathN``, and
    ``extra`` bound a path. Paths are completed by the target's ends where
    anchors lie inward, and the first that equals the target is the reference.
    Where the walk's budget ends it, the stretches that leave the target's own
    path are walked one by one with budgets of their own and added.
    """

    def group(key, given, nodes, n):
        counts = dict(zip(nodes, n))
        rows = []
        for t in given:
            seq = t["seq"].upper()
            at = soft_anchors(seq, k, counts)
            if at is None:
                continue
            limit = length_limit(t["limit"], seq, k, extra)
            found, spent = walk(seq[at[0] : at[0] + k], seq[at[1] : at[1] + k], counts, limit, max_paths, max_expansions, by_evidence)
            if spent and len(found) < max_paths:
                own = [seq[i : i + k] for i in range(at[0], at[1] + 1)]
                known = {tuple(p) for p in found}
                more = [[*own[: i + 1], *between, *own[j:]] for i, j, between in off_reference(own, counts, limit, max_expansions, sub_expansions, by_evidence)[0]]
                more = [own, *more] if all(x in counts for x in own) else [p for p in more if all(x in counts for x in p)]
                found += [p for p in more if tuple(p) not in known][: max_paths - len(found)]
            reference = False
            for p in found:
                whole = seq[: at[0]] + spelled(p) + seq[at[1] + k :]
                is_ref = not reference and whole == seq
                reference |= is_ref
                rows.append((*key, whole, is_ref, len(p), spent))
        return rows

    return by_target(targets, nodes, group, PATHS)


def tandem_duplication(target: str, junction: str) -> str | None:
    """The target with the copy that a junction of two halves describes; null unless both halves lie in it, the copy's end first."""
    half = len(junction) // 2
    target, junction = target.upper(), junction.upper()
    end, start = target.find(junction[:half]), target.find(junction[half:])
    if end < 0 or start < 0 or start > end + half - 1:
        return None
    stop = end + half
    return target[:stop] + target[start:stop] + target[stop:]


def tandem_duplications(targets: DataFrame, junctions: DataFrame) -> DataFrame:
    """Synthetic duplication paths: (target_id, path_seq) by the junctions of a target."""
    half = F.floor(F.length("junction") / 2).cast("int")
    seq, junction = F.upper("seq"), F.upper("junction")
    rows = targets.select("target_id", "seq").join(junctions.select("target_id", F.col("seq").alias("junction")), "target_id")
    stop = F.instr(seq, F.substring(junction, F.lit(1), half)) - 1 + half
    start = F.instr(seq, F.substring(junction, half + 1, F.length("junction"))) - 1
    rows = rows.withColumns({"s": start, "e": stop, "h": half}).where("s >= 0 and e >= h and s <= e - 1")
    copy = F.substring(seq, F.col("s") + 1, F.col("e") - F.col("s"))
    return rows.select("target_id", F.concat(F.substring(seq, F.lit(1), F.col("e")), copy, F.substring(seq, F.col("e") + 1, F.length("seq"))).alias("path_seq"))


def path_evidence(paths: DataFrame, index: DataFrame, k: int = 31, keys: list[str] | None = None) -> DataFrame:
    """Paths with the evidence of their k-mers and of those that the target's reference path lacks.

    ``paths`` has the keys (sample_id), target_id, path_seq and is_reference; the
    index has letters or codes. The fallback for paths without own k-mers is the
    whole path's figure. Each of a target's k-mers is looked up once, whatever
    the number of its paths, and comes back to them as a list.
    """
    keys = keys if keys is not None else ["sample_id"]
    by = [*keys, "target_id"]
    figures = ["n_molecules", "n_duplex", "n_simplex_fwd", "n_simplex_rev", *(["mean_err"] if "mean_err" in index.columns else [])]
    size = paths.agg(F.sum(F.greatest(F.length("path_seq") - k + 1, F.lit(0)))).first()[0] or 0
    wanted = paths.groupBy(*by).agg(F.concat_ws("N", F.collect_list("path_seq")).alias("seq"))
    wanted = S.explode_codes(wanted, "seq", k, distinct=True).withColumn("code", F.col("kmer"))
    if not is_coded(index):
        wanted = wanted.withColumn("kmer", spelled_codes(F.col("code"), k))
    found = lookup(wanted, index.select(*keys, "kmer", *figures), keys)
    if "mean_err" in figures:
        found = found.withColumn("mean_err", F.coalesce("mean_err", F.lit(0.0)))

    def group(key, given, kmers, *values):
        import numpy as np
        import pyarrow as pa

        found = list(dict.fromkeys((g["path_seq"], g["is_reference"]) for g in given if g["path_seq"] is not None))
        codes, clean, begin = _windows(pa.array([seq for seq, _ in found], pa.string()), k)
        kmers = np.array(kmers)
        order = np.argsort(kmers)
        kmers, columns = kmers[order], [np.array(v)[order] for v in values]
        at = np.minimum(np.searchsorted(kmers, codes), len(kmers) - 1)
        shared = np.zeros(len(kmers), bool)
        for (_, is_ref), a, b in zip(found, begin, begin[1:]):
            if is_ref:
                shared[at[a:b][clean[a:b]]] = True
        rows = []
        for (seq, is_ref), a, b in zip(found, begin, begin[1:]):
            places = np.flatnonzero(clean[a:b])
            if not len(places):
                continue
            here = at[a:b][places]
            n, d, fwd, rev, *err = (c[here] for c in columns)
            low, own = int(n.argmin()), ~shared[here]
            first = seq[places[low] : places[low] + k].upper()
            weakest = min(first, first.translate(_TURN)[::-1])
            mean = lambda x: x.sum().item() / len(x)
            rows.append((
                *key, seq, is_ref, n.min().item(), mean(n), d.min().item(), mean(d), fwd.min().item(), rev.min().item(), weakest, *map(mean, err),
                (d[own] if own.any() else d).min().item(), mean(n[own] if own.any() else n),
            ))
        return rows

    types = dict(paths.dtypes)
    schema = [*((c, types[c]) for c in by), ("path_seq", "string"), ("is_reference", "boolean"), ("min_molecules", "bigint"), ("mean_molecules", "double"), ("min_duplex", "bigint"), ("mean_duplex", "double")]
    schema += [("min_simplex_fwd", "bigint"), ("min_simplex_rev", "bigint"), ("weakest_kmer", "string"), *([("mean_error_prob", "double")] if "mean_err" in figures else [])]
    schema += [("min_variant_specific_duplex", "bigint"), ("mean_variant_specific_molecules", "double")]
    return by_graph(paths.select(*by, "path_seq", "is_reference"), found, ["code", *figures], group, ", ".join(f"{c} {t}" for c, t in schema), tuple(by), size)


def rank_paths(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best supported first: least molecules, then mean, then the sequence."""
    order = Window.partitionBy(*(keys if keys is not None else ["sample_id"]), "target_id").orderBy(F.desc("min_molecules"), F.desc("mean_molecules"), "path_seq")
    return scored.withColumn("rank", F.row_number().over(order))


def pathfind_stats(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Targets, those with variants, with a reference only or nothing, unusable or frequent anchors, spent budgets; by sample if both sides have it."""
    keys = [c for c in ("sample_id",) if c in anchors.columns and c in paths.columns]
    per = paths.groupBy(*keys, "target_id").agg(F.count_if(~F.col("is_reference")).alias("alts"), F.count_if("is_reference").alias("refs"), F.bool_or("budget_hit").alias("spent"))
    all_ = anchors.join(per, [*keys, "target_id"], "left").groupBy(*keys)
    return all_.agg(
        F.count("*").alias("n_targets"), F.count_if(F.col("alts") > 0).alias("n_with_variants"), F.count_if((F.col("alts") == 0) & (F.col("refs") > 0)).alias("n_ref_only"),
        F.count_if(F.col("alts").isNull()).alias("n_no_paths"), F.count_if(F.col("start_kmer").isNull()).alias("n_no_anchor"),
        F.count_if(F.col("warning").isNotNull()).alias("n_non_unique_anchors"), F.count_if("spent").alias("n_budget_hit"),
    )
