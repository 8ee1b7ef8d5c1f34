"""The whole analysis as one plan per stage: assemble, index, find paths, call.

Every table starts with ``sample_id``, so one job runs all samples. Stages are
frames; nothing is collected between them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, calls, graph, kmers, reads, umis
from ..sources.shared import written
from .config import RunConfig


@dataclass
class Run:
    """A run's frames, each lazy."""

    parsed: DataFrame
    molecules: DataFrame
    index: DataFrame
    paths: DataFrame
    scored: DataFrame
    calls: DataFrame


def assemble(read_pairs: DataFrame, config: RunConfig = RunConfig(), keep: Callable[[DataFrame], DataFrame] = written) -> tuple[DataFrame, DataFrame]:
    """Parsed reads, and molecules with their consensus; ``keep`` holds on to reads that several steps take."""
    parsed = reads.parse_reads(read_pairs, config.layout, config.min_umi_quality, config.min_template_length)
    good = keep(reads.passed(parsed))
    counts = reads.umi_counts(good)
    # UMIs meet by shared segments, whatever their length: buckets would keep neighbours apart that differ in their first bases.
    seeds = umis.cluster_umis(counts, config.max_hamming_distance)
    rows = good.join(seeds.select("sample_id", "umi_a", "umi_b", "seed_a", "seed_b").hint("merge"), ["sample_id", "umi_a", "umi_b"])
    return parsed, assembly.molecules(keep(rows), config.min_family_size)


def index(molecules: DataFrame, targets: DataFrame, config: RunConfig = RunConfig(), *extra: DataFrame, two_pass: bool = True) -> tuple[DataFrame, DataFrame]:
    """K-mer occurrences of on-target molecules, and their evidence by canonical k-mer."""
    allowed = kmers.allowlist(targets.select("seq"), *(e.select("seq") for e in extra), k=config.kmer_size)
    rows = kmers.read_kmers(reads.consensus_reads(molecules), config.kmer_size)
    rows = kmers.on_target(rows, allowed) if two_pass else kmers.on_list(rows, allowed)
    return rows, kmers.evidence(rows)


def find_paths(targets: DataFrame, occurrences: DataFrame, evidence: DataFrame, config: RunConfig = RunConfig(), junctions: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> tuple[DataFrame, DataFrame]:
    """Paths per sample and target, and their evidence, best first."""
    nodes = keep(graph.target_nodes(targets, occurrences, config.kmer_size, config.graph_min_molecules))
    extra = graph.JUNCTION_EXTRA if junctions is not None else 0
    paths = keep(graph.walk_paths(targets, nodes, config.kmer_size, config.max_paths, extra=extra))
    if junctions is not None:
        samples = nodes.select("sample_id", "target_id").distinct()
        made = graph.tandem_duplications(targets, junctions).join(samples, "target_id").select("sample_id", "target_id", "path_seq")
        made = made.join(paths.select("sample_id", "target_id", "path_seq"), ["sample_id", "target_id", "path_seq"], "left_anti")
        paths = paths.unionByName(made.withColumns({"is_reference": F.lit(False), "n_kmers": F.length("path_seq") - config.kmer_size + 1, "budget_hit": F.lit(False)}))
    return paths, graph.rank_paths(graph.path_evidence(paths, evidence, config.kmer_size))


def run(read_pairs: DataFrame, targets: DataFrame, config: RunConfig = RunConfig(), listed: DataFrame | None = None, junctions: DataFrame | None = None, alternatives: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> Run:
    """All stages; ``listed`` variants switch to tumour-informed calls, with rescue if the configuration asks for it.

    Each stage's result is read several times by the next, so ``keep`` holds on
    to it: by default it is written to the shared folder and read back, which
    keeps plans short and survives lost executors.
    """
    parsed, molecules = assemble(read_pairs, config, keep)
    molecules = keep(molecules)
    extra = [x.select(F.col(c).alias("seq")) for x, c in ((junctions, "seq"), (alternatives, "alt_seq")) if x is not None]
    occurrences, evidence = index(molecules, targets, config, *extra)
    occurrences = keep(occurrences)
    evidence = keep(kmers.evidence(occurrences))
    paths, scored = find_paths(targets, occurrences, evidence, config, junctions, keep)
    scored = keep(scored)
    found = keep(calls.call_variants(scored, config.call))
    if listed is not None:
        found = calls.targeted(found, listed, config.ti_position_tolerance, alternatives)
        if config.ti_rescue:
            probes = calls.rescue_probe(calls.alternatives_of(calls.windows_of(targets, listed)), evidence, config.kmer_size)
            found = calls.rescued(keep(found), probes)
    return Run(parsed, molecules, evidence, paths, scored, found)
