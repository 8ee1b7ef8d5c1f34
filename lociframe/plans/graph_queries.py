"""Walks through the graphs of targets, one target per user, with their SQL: paths are grown k-mer by k-mer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, graph, unitigs
from ..sources.shared import written
from . import inputs as I
from .queries import query, rounded

_WALK = f"""WITH RECURSIVE {I.SQL_USER_MOLECULES},
w(target_id, target, s) AS (
  SELECT t.target_id, t.seq, n.raw FROM targets t JOIN nodes n ON n.target_id = t.target_id AND n.raw = substr(t.seq, 1, 31)
  UNION ALL
  SELECT w.target_id, w.target, w.s || right(n.raw, 1) FROM w JOIN nodes n ON n.target_id = w.target_id AND n.front = right(w.s, 30)
  WHERE length(w.s) < length(w.target) + 50 AND right(w.s, 31) <> right(w.target, 31) AND strpos(w.s, n.raw) = 0)
SELECT target_id, s AS path_seq, s = target AS is_reference, CAST(length(s) - 30 AS INTEGER) AS n_kmers FROM w WHERE right(s, 31) = right(target, 31)"""


def user_nodes(spark, sf):
    """Targets and the k-mers of their molecules with their counts."""
    molecules, targets = I.user_molecules(spark, sf)
    return targets, written(graph.own_nodes(molecules, I.K))


@query(_WALK)
def target_walk(spark, sf):
    return graph.walk_paths(*user_nodes(spark, sf)).select("target_id", "path_seq", "is_reference", "n_kmers")


@query(_WALK)
def unitig_walk(spark, sf):
    return unitigs.walk_paths(*user_nodes(spark, sf)).select("target_id", "path_seq", "is_reference", "n_kmers")


@query(f"""WITH RECURSIVE {I.SQL_USER_MOLECULES},
own AS MATERIALIZED (SELECT target_id, seq, i, substr(seq, i + 1, 31) AS raw, substr(seq, i + 2, 31) AS following FROM (SELECT *, unnest(range(0, length(seq) - 30)) AS i FROM targets)),
b(target_id, gone, s, done) AS (
  SELECT o.target_id, o.i, o.raw || right(n.raw, 1), p.raw IS NOT NULL
  FROM own o JOIN nodes h ON h.target_id = o.target_id AND h.raw = o.raw JOIN nodes n ON n.target_id = o.target_id AND n.front = right(o.raw, 30) AND n.raw <> o.following
  LEFT JOIN (SELECT DISTINCT target_id, raw FROM own) p ON p.target_id = o.target_id AND p.raw = n.raw WHERE length(o.following) = 31
  UNION ALL
  SELECT b.target_id, b.gone, b.s || right(n.raw, 1), p.raw IS NOT NULL
  FROM b JOIN nodes n ON n.target_id = b.target_id AND n.front = right(b.s, 30) LEFT JOIN (SELECT DISTINCT target_id, raw FROM own) p ON p.target_id = b.target_id AND p.raw = n.raw
  WHERE NOT b.done AND length(b.s) < 210 AND strpos(substr(b.s, 2), n.raw) = 0),
found AS (SELECT b.target_id, gone, s, min(o.i) AS back FROM b JOIN own o ON o.target_id = b.target_id AND o.raw = right(b.s, 31) AND o.i > b.gone WHERE b.done GROUP BY b.target_id, gone, s)
SELECT f.target_id, CAST(f.gone AS INTEGER) AS "left", CAST(f.back AS INTEGER) AS "right", substr(s, 32, length(s) - 32) AS stretch, substr(t.seq, 1, f.gone + 31) || substr(s, 32, length(s) - 32) || substr(t.seq, f.back + 31) AS path_seq
FROM found f JOIN targets t ON t.target_id = f.target_id WHERE f.gone + 1 + length(s) - 32 + length(t.seq) - 30 - f.back <= length(t.seq) - 30 + 50""")
def reference_alternatives(spark, sf):
    return graph.find_alternatives(*user_nodes(spark, sf)).select("target_id", "left", "right", "stretch", "path_seq")


@query(f"""WITH {I.SQL_USER_MOLECULES}, e AS MATERIALIZED (SELECT a.target_id, a.raw AS src, b.raw AS dst FROM nodes a JOIN nodes b ON b.target_id = a.target_id AND b.front = right(a.raw, 30)),
ends AS (SELECT target_id, substr(seq, 1, 31) AS s, right(seq, 31) AS e FROM targets),
inner_ AS (SELECT target_id, dst FROM e WHERE src <> dst AND (target_id, src) IN (SELECT (target_id, src) FROM e GROUP BY target_id, src HAVING count(*) = 1)
  AND (target_id, dst) IN (SELECT (target_id, dst) FROM e GROUP BY target_id, dst HAVING count(*) = 1)
  AND (target_id, dst) NOT IN (SELECT (target_id, s) FROM ends) AND (target_id, src) NOT IN (SELECT (target_id, e) FROM ends)),
n AS (SELECT target_id, count(*) AS kmers FROM nodes GROUP BY target_id), i AS (SELECT target_id, count(*) AS inner_kmers FROM inner_ GROUP BY target_id)
SELECT n.target_id, kmers - coalesce(inner_kmers, 0) AS n_chains, kmers AS n_kmers FROM n LEFT JOIN i ON i.target_id = n.target_id""")
def unitig_counts(spark, sf):
    targets, nodes = user_nodes(spark, sf)
    chains = unitigs.unitigs(nodes, written(unitigs.anchors(targets, nodes)))
    return chains.groupBy("target_id").agg(F.count("*").alias("n_chains"), F.sum("n_kmers").cast("bigint").alias("n_kmers"))


#: Evidence of whole paths and of the k-mers that the target itself lacks; a path beside its target.
_CALLS = f"""{_WALK.split("SELECT target_id, s AS path_seq")[0]},
idx AS MATERIALIZED (SELECT least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS d
  FROM (SELECT event_id, substr(seq, i, 31) AS raw FROM (SELECT *, unnest(range(1, greatest(length(seq) - 29, 1))) AS i FROM um)) GROUP BY kmer),
paths AS (SELECT target_id, s, s = target AS is_reference FROM w WHERE right(s, 31) = right(target, 31)),
pk AS (SELECT target_id, s, is_reference, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT *, substr(s, i, 31) AS raw FROM (SELECT *, unnest(range(1, length(s) - 29)) AS i FROM paths))),
ref AS (SELECT DISTINCT target_id, kmer FROM pk WHERE is_reference),
ev AS (SELECT p.target_id, p.s, p.is_reference, min(n) AS least, min(d) FILTER (ref.kmer IS NULL) AS own_d, min(d) AS all_d FROM pk p JOIN idx ON idx.kmer = p.kmer LEFT JOIN ref ON ref.target_id = p.target_id AND ref.kmer = p.kmer GROUP BY ALL)
SELECT a.target_id, a.s AS alt_seq, r.least AS n_molecules_ref, a.least AS n_molecules_alt, coalesce(a.own_d, a.all_d) AS n_duplex_alt, greatest(0, a.least - coalesce(a.own_d, a.all_d)) AS n_simplex_alt, round(a.least / (a.least + r.least), 6) AS vaf
FROM ev a JOIN ev r ON r.target_id = a.target_id AND r.is_reference WHERE NOT a.is_reference"""


@query(_CALLS)
def graph_calls(spark, sf):
    """From molecules to calls: index, walks, evidence, figures and shares."""
    molecules, targets = I.user_molecules(spark, sf)
    rows = molecules.withColumn("family_type", I.family(F.col("molecule_id"))).select("sample_id", "target_id", "family_type", "seq")
    nodes = written(graph.own_nodes(rows, I.K))
    paths = written(graph.walk_paths(targets, nodes))
    scored = written(graph.path_evidence(paths, graph.index_of_nodes(nodes, I.K, coded=True)))
    found = rounded(calls.call_variants(scored), "vaf")
    return found.select("target_id", "alt_seq", "n_molecules_ref", "n_molecules_alt", "n_duplex_alt", "n_simplex_alt", "vaf")
