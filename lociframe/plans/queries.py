"""One query per operator over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, stats
from ..functions import sequence as S
from ..operators import assembly, calls, explore, graph, kmers, logs, ml, ranges, reads, scoring, sketch, umis
from ..sources import writers
from ..sources.shared import new_path, written
from . import inputs as I
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NO_SAMPLE: list[str] = []


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def doc_kmers(spark, sf):
    return S.explode_kmers(I.documents(spark, sf), "seq", I.K)


def doc_index(spark, sf):
    return kmers.index_of(I.documents(spark, sf), I.K, NO_SAMPLE)


def doc_codes(spark, sf):
    return S.explode_codes(I.documents(spark, sf), "seq", I.K)


def listed_index(spark, sf, *sequences: DataFrame):
    """The index of the k-mers of given sequences only: others are not looked up, so they meet no shuffle."""
    return kmers.evidence(kmers.on_list(doc_codes(spark, sf), kmers.allowlist(*sequences, coded=True)), NO_SAMPLE, k=I.K)


# --- k-mers


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_INDEX} SELECT * FROM idx")
def kmer_evidence(spark, sf):
    return doc_index(spark, sf)


@query(f"""WITH {I.SQL_DOCUMENTS} SELECT kmer, count(DISTINCT molecule_id) AS n_molecules, count(DISTINCT molecule_id) FILTER (family_type = 'Duplex') AS n_duplex,
  count(DISTINCT molecule_id) FILTER (family_type IN ('SimplexFwd', 'Singleton')) AS n_simplex_fwd, count(DISTINCT molecule_id) FILTER (family_type = 'SimplexRev') AS n_simplex_rev FROM doc_kmers GROUP BY kmer""")
def kmer_evidence_distinct(spark, sf):
    return kmers.index_of(I.documents(spark, sf), I.K, NO_SAMPLE, distinct=True)


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL} SELECT molecule_id, count(*) AS n FROM doc_kmers WHERE kmer IN (SELECT kmer FROM panel_kmers) GROUP BY molecule_id""")
def kmer_allowlist_semi(spark, sf):
    allowed = kmers.allowlist(I.panel(spark, sf))
    return kmers.on_list(doc_kmers(spark, sf), allowed).groupBy("molecule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL} SELECT kmer, count(*) AS n_molecules FROM doc_kmers WHERE molecule_id IN
  (SELECT molecule_id FROM doc_kmers WHERE kmer IN (SELECT kmer FROM panel_kmers)) GROUP BY kmer""")
def kmer_two_pass(spark, sf):
    rows = kmers.on_target(doc_kmers(spark, sf), kmers.allowlist(I.panel(spark, sf)))
    return kmers.evidence(rows, NO_SAMPLE).select("kmer", "n_molecules")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {I.SQL_INDEX}, p AS (SELECT DISTINCT kmer FROM panel_kmers)
  SELECT (SELECT count(*) FROM p) AS n_target_kmers, count(*) AS n_observed, round(avg(n_molecules), 6) AS mean_depth FROM idx WHERE kmer IN (SELECT kmer FROM p)""")
def kmer_index_qc(spark, sf):
    return rounded(kmers.index_stats(doc_index(spark, sf), kmers.allowlist(I.panel(spark, sf))), "mean_depth")


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_INDEX} SELECT kmer, n_molecules FROM idx WHERE n_molecules >= 2")
def kmer_min_evidence(spark, sf):
    return kmers.frequent(doc_index(spark, sf)).select("kmer", "n_molecules")


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_INDEX} SELECT kmer, n_molecules, n_duplex FROM idx WHERE n_molecules >= 2")
def kmer_sketch_evidence(spark, sf):
    n = I.documents(spark, sf).agg(F.sum(F.greatest(F.length("seq") - I.K + 1, F.lit(0)))).first()[0] or 0
    found = sketch.frequent_evidence(doc_codes(spark, sf), 2, NO_SAMPLE, sketch.fitted_bits(n), sketch.FITTED_ROWS, I.K)
    return found.select("kmer", "n_molecules", "n_duplex")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL} SELECT kmer FROM panel_kmers UNION SELECT kmer FROM doc_kmers""")
def allowlist_union(spark, sf):
    texts = (I.table(spark, sf, name, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0 for name in ("benchmark", "documents"))
    return kmers.allowlist(I.panel(spark, sf), I.documents(spark, sf), letters=sum(texts))  # documents stand for junction sequences


@query("""WITH d AS (SELECT c_custkey AS id, substr(translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 31) AS s FROM customer),
  r AS (SELECT *, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM d)
  SELECT id, rc, least(s, rc) AS canonical, CASE WHEN s <= rc THEN 'Forward' ELSE 'Reverse' END AS strand, s AS decoded,
    list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(strpos('ACGT', c) - 1 AS BIGINT))), lambda a, c: a * 4 + c) AS code FROM r""")
def kmer_codes(spark, sf):
    d = I.table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), F.substring(I.dna(F.col("c_custkey")), 1, 31).alias("s"))
    code = S.encode_kmer(F.col("s"))
    return d.select("id", S.reverse_complement(F.col("s")).alias("rc"), S.canonical(F.col("s")).alias("canonical"), S.canonical_strand(F.col("s")).alias("strand"), S.decode_kmer(code, 31).alias("decoded"), code.alias("code"))


_ENDS = """a AS (SELECT target_id, CASE WHEN length(seq) >= 31 THEN substr(seq, 1, 31) END AS s, CASE WHEN length(seq) >= 31 THEN substr(seq, length(seq) - 30) END AS e FROM panel),
ends AS (SELECT target_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS s, least(e, reverse(translate(e, 'ACGT', 'TGCA'))) AS e FROM a),
seen AS MATERIALIZED (SELECT kmer, count(*) AS n FROM doc_kmers WHERE kmer IN (SELECT s FROM ends UNION SELECT e FROM ends) GROUP BY kmer)"""


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {_ENDS}
  SELECT target_id, CASE WHEN s IS NOT NULL THEN coalesce(i.n, 0) END AS start_count, CASE WHEN s IS NOT NULL THEN coalesce(j.n, 0) END AS end_count,
    CASE WHEN s IS NOT NULL THEN coalesce(i.n, 0) < 5 END AS start_unique, CASE WHEN s IS NOT NULL THEN coalesce(j.n, 0) < 5 END AS end_unique
  FROM ends LEFT JOIN seen i ON i.kmer = s LEFT JOIN seen j ON j.kmer = e""")
def anchor_validation(spark, sf):
    p = I.panel(spark, sf)
    return kmers.validate_anchors(p, listed_index(spark, sf, p), threshold=5).select("target_id", "start_count", "end_count", "start_unique", "end_unique")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, w AS (SELECT DISTINCT target_id, kmer FROM panel_kmers)
  SELECT target_id, w.kmer, coalesce(n, 0) AS n_reads FROM w LEFT JOIN (SELECT kmer, count(DISTINCT molecule_id) AS n FROM doc_kmers GROUP BY kmer) USING (kmer)""")
def junction_read_counts(spark, sf):
    return kmers.junction_reads(I.documents(spark, sf).withColumnRenamed("molecule_id", "read_id"), I.panel(spark, sf))


@query(f"""WITH {I.SQL_PANEL} SELECT a.raw AS src, b.raw AS dst FROM (SELECT DISTINCT raw FROM panel_raw) a JOIN (SELECT DISTINCT raw FROM panel_raw) b ON substr(a.raw, 2) = substr(b.raw, 1, 30)""")
def debruijn_edges(spark, sf):
    nodes = S.explode_kmers(I.panel(spark, sf), "seq", I.K, raw="raw").select(F.col("raw").alias("kmer")).distinct()
    return graph.edges(nodes, I.K)


# --- reads


def parsed(spark, sf):
    return reads.parse_reads(I.reads(spark, sf))


@query(f"""WITH {I.SQL_READS} SELECT sample_id, count(*) AS n_processed, count(*) FILTER (drop_reason IS NULL) AS n_passed, count(*) FILTER (drop_reason = 'ReadTooShort') AS n_too_short,
  CAST(0 AS BIGINT) AS n_template_too_short, count(*) FILTER (drop_reason = 'LowUmiQuality') AS n_low_umi_quality FROM parsed GROUP BY sample_id""")
def parse_drop_stats(spark, sf):
    return reads.parse_stats(parsed(spark, sf))


@query(f"WITH {I.SQL_READS} SELECT sample_id, umi_a, umi_b, count(*) AS n, min(read_ord) AS first_ord FROM good GROUP BY ALL")
def canonical_umi_counts(spark, sf):
    return reads.umi_counts(reads.passed(parsed(spark, sf)))


@query(f"""WITH {I.SQL_READS} SELECT *, CASE WHEN fwd_reads > 0 AND rev_reads > 0 THEN 'Duplex' WHEN fwd_reads + rev_reads = 1 THEN 'Singleton' WHEN fwd_reads > 0 THEN 'SimplexFwd' ELSE 'SimplexRev' END AS family_type FROM fams""")
def family_types(spark, sf):
    rows = reads.passed(parsed(spark, sf)).withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b"), "part": F.lit(0)})
    return reads.families(rows).select("sample_id", F.col("seed_a").alias("umi_a"), F.col("seed_b").alias("umi_b"), "fwd_reads", "rev_reads", "family_type")


@query(f"""WITH {I.SQL_READS}, u AS (SELECT *, fwd_reads + rev_reads AS n FROM fams) SELECT a.sample_id, a.umi_a AS umi_a_1, a.umi_b AS umi_b_1, b.umi_a AS umi_a_2, b.umi_b AS umi_b_2,
  hamming(a.umi_a, b.umi_a) + hamming(a.umi_b, b.umi_b) AS distance FROM u a JOIN u b ON a.sample_id = b.sample_id
  AND (a.umi_a < b.umi_a OR a.umi_a = b.umi_a AND a.umi_b < b.umi_b) WHERE hamming(a.umi_a, b.umi_a) + hamming(a.umi_b, b.umi_b) <= 3""")
def umi_hamming_pairs(spark, sf):
    found = reads.umi_neighbours(reads.umi_counts(reads.passed(parsed(spark, sf))), 3, bucketed=False)
    return found.select("sample_id", "umi_a_1", "umi_b_1", "umi_a_2", "umi_b_2", F.col("distance").cast("bigint").alias("distance"))


def _greedy(rows: str, group: str, distance: int) -> str:
    """SQL of the greedy rule: UMI pairs one by one in their order, each with the seeds so far; ``rows`` has sample_id, umi_a, umi_b, n, first_ord."""
    return f"""ordered AS MATERIALIZED (SELECT *, {group} AS grp, row_number() OVER (PARTITION BY sample_id, {group} ORDER BY n DESC, first_ord) AS r FROM {rows}),
  rec(sample_id, grp, r, umi_a, umi_b, n, first_ord, seeds, seed) AS (
    SELECT sample_id, grp, r, umi_a, umi_b, n, first_ord, [umi_a || umi_b], umi_a || umi_b FROM ordered WHERE r = 1
    UNION ALL
    SELECT sample_id, grp, r, umi_a, umi_b, n, first_ord, CASE WHEN near IS NULL THEN list_append(seeds, umi_a || umi_b) ELSE seeds END, coalesce(near, umi_a || umi_b)
    FROM (SELECT o.*, p.seeds, list_filter(p.seeds, lambda s: hamming(s, o.umi_a || o.umi_b) <= {distance})[1] AS near FROM rec p JOIN ordered o ON o.sample_id = p.sample_id AND o.grp = p.grp AND o.r = p.r + 1))
  SELECT sample_id, umi_a, umi_b, n, first_ord, substr(seed, 1, length(umi_a)) AS seed_a, substr(seed, length(umi_a) + 1) AS seed_b FROM rec"""


@query(f"""WITH RECURSIVE {I.SQL_READS}, u AS (SELECT sample_id, umi_a, umi_b, count(*) AS n, min(read_ord) AS first_ord FROM good GROUP BY ALL), {_greedy("u", "substr(umi_a, 1, 3)", 2)}""")
def umi_directional_clusters(spark, sf):
    return reads.cluster_umis(reads.umi_counts(reads.passed(parsed(spark, sf))), 2)


@query(f"""WITH RECURSIVE {I.SQL_LONG_UMIS}, {_greedy("long_umis", "0", 2)}""")
def umi_long_clusters(spark, sf):
    return umis.cluster_umis(I.long_umis(spark, sf), 2)


@query(f"""WITH {I.SQL_LONG_UMIS}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first_ord) AS r FROM long_umis)
  SELECT a.sample_id, a.umi_a AS umi_a_1, a.umi_b AS umi_b_1, b.umi_a AS umi_a_2, b.umi_b AS umi_b_2, CAST(hamming(a.umi_a || a.umi_b, b.umi_a || b.umi_b) AS INTEGER) AS distance
  FROM o a JOIN o b ON a.sample_id = b.sample_id AND a.r < b.r WHERE hamming(a.umi_a || a.umi_b, b.umi_a || b.umi_b) <= 3""")
def umi_long_pairs(spark, sf):
    return umis.neighbours(I.long_umis(spark, sf), 3).select("sample_id", "umi_a_1", "umi_b_1", "umi_a_2", "umi_b_2", F.col("distance").cast("int").alias("distance"))


def _end(s):
    return f"rpad(translate(substr({s}, 1, 8), 'ACGT', '0123'), 8, '0')"


def _code(digits):
    return f"list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split({digits}, ''), lambda c: CAST(c AS HUGEINT))), lambda a, c: a * 4 + c)"


_FP = f"""fp AS (SELECT sample_id, read_ord, {_code(" || ".join(_end(s) for s in ("template_r1", "substr(template_r1, greatest(length(template_r1) - 7, 1))", "template_r2", "substr(template_r2, greatest(length(template_r2) - 7, 1))")))} AS u FROM parsed)"""


@query(f"WITH {I.SQL_READS}, {_FP} SELECT sample_id, read_ord, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS fingerprint FROM fp")
def endpoint_fingerprints(spark, sf):
    return parsed(spark, sf).select("sample_id", "read_ord", "fingerprint")


@query(f"""WITH {I.SQL_READS}, {_FP}, v AS (SELECT sample_id, read_ord, CAST(u AS UBIGINT) AS u, lead(CAST(u AS UBIGINT)) OVER (PARTITION BY sample_id ORDER BY read_ord) AS w FROM fp)
  SELECT sample_id, read_ord, bit_count(xor(u, w)) <= 4 AS direct, bit_count(xor(u, w)) <= 4 OR bit_count(xor(u, CAST((CAST(w AS HUGEINT) % 4294967296) * 4294967296 + CAST(w AS HUGEINT) // 4294967296 AS UBIGINT))) <= 4 AS either FROM v WHERE w IS NOT NULL""")
def fingerprint_compat(spark, sf):
    rows = written(ranges.ranked(parsed(spark, sf).select("sample_id", "read_ord", "fingerprint"), ["sample_id"], "read_ord"))
    rows = rows.join(rows.select("sample_id", (F.col("rank") - 1).alias("rank"), F.col("fingerprint").alias("w")), ["sample_id", "rank"])
    a, b = F.col("fingerprint"), F.col("w")
    return rows.select("sample_id", "read_ord", S.compatible(a, b).alias("direct"), S.duplex_compatible(a, b).alias("either"))


def family_reads(spark, sf):
    rows = reads.passed(parsed(spark, sf)).withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b")})
    return rows


@query(f"""WITH RECURSIVE {I.SQL_READS}, {_FP}, fr AS MATERIALIZED (SELECT g.sample_id, g.umi_a, g.umi_b, g.read_ord, CAST(fp.u AS UBIGINT) AS u, CAST(CAST(fp.u AS HUGEINT) % 4294967296 * 4294967296 + CAST(fp.u AS HUGEINT) // 4294967296 AS UBIGINT) AS turned,
    row_number() OVER (PARTITION BY g.sample_id, g.umi_a, g.umi_b ORDER BY g.read_ord) AS r FROM good g JOIN fp ON fp.sample_id = g.sample_id AND fp.read_ord = g.read_ord),
  rec(sample_id, umi_a, umi_b, read_ord, r, heads, part) AS (
    SELECT sample_id, umi_a, umi_b, read_ord, r, [u], CAST(0 AS BIGINT) FROM fr WHERE r = 1
    UNION ALL
    SELECT sample_id, umi_a, umi_b, read_ord, r, CASE WHEN hit > 0 THEN heads ELSE list_append(heads, u) END, CAST(CASE WHEN hit > 0 THEN hit - 1 ELSE len(heads) END AS BIGINT)
    FROM (SELECT f.*, p.heads, coalesce(list_position(list_transform(p.heads, lambda h: bit_count(xor(h, f.u)) <= 4 OR bit_count(xor(h, f.turned)) <= 4), true), 0) AS hit
      FROM rec p JOIN fr f ON f.sample_id = p.sample_id AND f.umi_a = p.umi_a AND f.umi_b = p.umi_b AND f.r = p.r + 1))
  SELECT sample_id, read_ord, part FROM rec""")
def family_split(spark, sf):
    return assembly.split_families(family_reads(spark, sf).select(*assembly.FAMILY, "read_ord", "fingerprint")).select("sample_id", "read_ord", "part")


_SSC = """b AS (SELECT sample_id, umi_a, umi_b, strand, pos, substr(CASE WHEN strand = 'Forward' THEN template_r1 ELSE template_r2 END, pos + 1, 1) AS base, 1 - pow(10.0, -q / 10.0) AS w
  FROM (SELECT *, unnest(range(0, length(CASE WHEN strand = 'Forward' THEN template_r1 ELSE template_r2 END))) AS pos FROM good)),
s AS (SELECT sample_id, umi_a, umi_b, strand, pos, base, sum(w) AS w FROM b GROUP BY ALL),
c AS (SELECT sample_id, umi_a, umi_b, strand, pos, arg_max(base, (round(w, 9), -ascii(base))) AS base, greatest(1 - max(w) / sum(w), 1e-6) AS err FROM s GROUP BY ALL),
ssc AS (SELECT sample_id, umi_a, umi_b, strand, string_agg(base, '' ORDER BY pos) AS seq, list(err ORDER BY pos) AS err FROM c GROUP BY ALL)"""


@query(f"WITH {I.SQL_READS}, {_SSC} SELECT sample_id, umi_a, umi_b, strand, seq, round(list_avg(err), 6) AS mean_err FROM ssc")
def ssc_consensus(spark, sf):
    side = lambda s, c: F.struct(F.lit(s).alias("strand"), F.col(c).alias("c"))
    rows = _called(spark, sf).select("sample_id", "umi_a", "umi_b", F.explode(F.array(side("Forward", "consensus_fwd"), side("Reverse", "consensus_rev"))).alias("s"))
    rows = rows.where("s.c is not null").select("sample_id", "umi_a", "umi_b", "s.strand", "s.c.*")
    return rows.select("sample_id", "umi_a", "umi_b", "strand", "seq", F.round(_mean("err"), 6).alias("mean_err"))


def _called(spark, sf):
    """Consensus of whole UMI pairs: no clusters, no parts."""
    return assembly.called(written(family_reads(spark, sf).select(*assembly.COLUMNS)), bits=64).withColumnsRenamed({"seed_a": "umi_a", "seed_b": "umi_b"})


def _mean(err):
    return F.aggregate(err, F.lit(0.0), lambda a, x: a + x) / F.size(err)


@query(f"""WITH {I.SQL_READS}, {_SSC}, p AS (SELECT sample_id, umi_a, umi_b, f.seq AS fs, r.seq AS rs, f.err AS fe, r.err AS re, unnest(range(1, least(length(f.seq), length(r.seq)) + 1)) AS i
    FROM (SELECT * FROM ssc WHERE strand = 'Forward') f JOIN (SELECT * FROM ssc WHERE strand = 'Reverse') r USING (sample_id, umi_a, umi_b)),
  d AS (SELECT sample_id, umi_a, umi_b, i, CASE WHEN substr(fs, i, 1) = substr(rs, i, 1) OR fe[i] <= re[i] THEN substr(fs, i, 1) ELSE substr(rs, i, 1) END AS base,
    CASE WHEN substr(fs, i, 1) = substr(rs, i, 1) THEN fe[i] * re[i] ELSE least(fe[i], re[i]) END AS err FROM p)
  SELECT sample_id, umi_a, umi_b, string_agg(base, '' ORDER BY i) AS seq, round(avg(err), 6) AS mean_err FROM d GROUP BY ALL""")
def duplex_consensus(spark, sf):
    pair = _called(spark, sf).where("consensus_fwd is not null and consensus_rev is not null")
    pair = pair.withColumn("d", reads.duplex_consensus(F.col("consensus_fwd.seq"), F.col("consensus_fwd.err"), F.col("consensus_rev.seq"), F.col("consensus_rev.err")))
    return pair.select("sample_id", "umi_a", "umi_b", "d.seq", F.round(_mean(F.col("d.err")), 6).alias("mean_err"))


@query(f"""WITH {I.SQL_READS}, m AS (SELECT sample_id, count(*) AS n_molecules, count(*) FILTER (fwd_reads > 0 AND rev_reads > 0) AS n_duplex FROM fams GROUP BY sample_id)
  SELECT sample_id, n_molecules, n_duplex, round(n_duplex / n_molecules, 6) AS duplex_fraction, round(p.n / n_molecules, 6) AS mean_family_size FROM m JOIN (SELECT sample_id, count(*) AS n FROM good GROUP BY sample_id) p USING (sample_id)""")
def assembly_stats(spark, sf):
    p = parsed(spark, sf)
    fams = reads.families(reads.passed(p).withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b"), "part": F.lit(0)}))
    out = reads.assembly_stats(p, fams, reads.large_enough(fams))
    return rounded(out, "duplex_fraction", "mean_family_size").select("sample_id", "n_molecules", "n_duplex", "duplex_fraction", "mean_family_size")


@query()
def molecule_table(spark, sf):
    return reads.molecule_dump(assembly.molecules(written(family_reads(spark, sf).select(*assembly.COLUMNS))))


_RK = """rk AS (SELECT kmer, family_type, err FROM (SELECT family_type, err, substr(seq, i, 31) AS raw, least(substr(seq, i, 31), reverse(translate(substr(seq, i, 31), 'ACGT', 'TGCA'))) AS kmer
  FROM (SELECT template_r1 AS seq, ['Duplex', 'SimplexFwd', 'SimplexRev', 'Singleton'][read_ord % 4 + 1] AS family_type, pow(10.0, -q / 10.0) AS err, unnest(range(1, greatest(length(template_r1) - 29, 1))) AS i FROM good)))"""


@query(f"""WITH {I.SQL_READS}, {_RK} SELECT kmer, count(*) AS n_molecules, count(*) FILTER (family_type = 'Duplex') AS n_duplex, round(min(err), 6) AS min_err, round(avg(err), 6) AS mean_err FROM rk GROUP BY kmer""")
def kmer_error_evidence(spark, sf):
    rows = reads.passed(parsed(spark, sf))
    q = F.ascii(F.substring("qual_r1", 1, 1)) - 33
    rows = rows.select(F.col("template_r1").alias("seq"), I.family(F.col("read_ord")).alias("family_type"), F.array_repeat(S.phred_to_prob(q), F.length("template_r1")).alias("err"))
    out = kmers.index_of(rows, I.K, NO_SAMPLE)
    return rounded(out, "min_err", "mean_err").select("kmer", "n_molecules", "n_duplex", "min_err", "mean_err")


@query(f"""WITH {I.SQL_READS}, n AS (SELECT sample_id, count(*) AS n FROM fams GROUP BY sample_id) SELECT sample_id, n, round(524800 * (1 - exp(-n / 524800.0)), 6) AS occupancy,
  round(1 - pow(1 - 1 / 524800.0, n - 1), 9) AS collision, CAST(least(3, greatest(1, floor(floor(sqrt(n)) / 1000))) AS INT) AS threshold FROM n""")
def umi_space(spark, sf):
    counts = reads.umi_counts(reads.passed(parsed(spark, sf))).groupBy("sample_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    return counts.select("sample_id", "n", F.round(stats.umi_occupancy(n), 6).alias("occupancy"), F.round(stats.collision_probability(n), 9).alias("collision"), kmers.frequency_threshold(n).alias("threshold"))


# --- statistics and calls

_LF = "lgamma({} + 1)"


def _lb(n, k):
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


_PMF = f"{_lb('(a + c)', 'k')} + {_lb('(b + d)', '(a + b - k)')} - {_lb('(a + b + c + d)', '(a + b)')}"
_FISHER = f"""p AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM t),
l AS (SELECT *, {_PMF} AS lp, {_PMF.replace("k + 1", "a + 1").replace("- k", "- a")} AS lo FROM p)"""


@query(f"""WITH {I.SQL_2X2}, {_FISHER} SELECT supplier, round(least(1.0, sum(exp(lp)) FILTER (lp <= lo + 1e-10)), 6) AS p FROM l GROUP BY supplier, a, b, c, d""")
def fisher_strand_bias(spark, sf):
    t = I.tables2x2(spark, sf)
    return t.select("supplier", F.round(stats.fisher_exact(*map(F.col, "abcd")), 6).alias("p"))


_CONF = "CASE WHEN n_alt = 0 THEN 0.0 ELSE 1 / (1 + exp(-((n_alt * ln(v) + n_ref * ln(1 - v)) - (n_alt * ln(1e-4) + n_ref * ln(1 - 1e-4))))) END"


def _with_stats(rows):
    n = F.col("n_alt") + F.col("n_ref")
    rows = rows.withColumns({"conf": stats.confidence(F.col("n_alt"), n), "c": F.lit(20), "d": F.lit(20)})
    return stats.with_fisher(rows, "fwd", "rev", "c", "d", "bias").drop("c", "d")


@query(f"WITH {I.SQL_CALLS} SELECT call_id, round({_CONF}, 6) AS confidence FROM (SELECT *, n_alt / (n_alt + n_ref) AS v FROM calls)")
def posterior_confidence(spark, sf):
    return _with_stats(I.call_rows(spark, sf)).select("call_id", F.round("conf", 6).alias("confidence"))


_BIAS = f"""t AS (SELECT DISTINCT fwd AS a, rev AS b, CAST(20 AS BIGINT) AS c, CAST(20 AS BIGINT) AS d FROM calls), {_FISHER},
f AS (SELECT a, b, least(1.0, sum(exp(lp)) FILTER (lp <= lo + 1e-10)) AS bias FROM l GROUP BY a, b)"""
_FILTER = f"""x AS (SELECT calls.*, bias, {_CONF.replace("(v)", "(vaf)").replace("1 - v)", "1 - vaf)")} AS conf, variant_type IN ('LargeDeletion', 'Fusion') AS sv FROM calls JOIN f ON fwd = a AND rev = b),
lab AS (SELECT *, CASE WHEN n_alt < CASE WHEN sv THEN 1 ELSE 2 END AND NOT (n_alt = 1 AND n_duplex >= 1) THEN 'LowConfidence'
  WHEN NOT sv AND bias < 0.01 AND n_duplex < 2 THEN 'StrandBias' WHEN conf < CASE WHEN sv THEN 0.95 ELSE 0.99 END THEN 'LowConfidence' WHEN vaf > 0.05 THEN 'HighVaf' ELSE 'Pass' END AS filter FROM x)"""


def labelled(spark, sf):
    rows = _with_stats(I.call_rows(spark, sf))
    label = alleles.call_filter(F.col("conf"), F.col("bias"), F.col("n_alt"), F.col("n_duplex"), F.col("vaf"), F.col("variant_type"), alleles.CallConfig(max_vaf=0.05))
    return rows.withColumn("filter", label)


@query(f"WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER} SELECT call_id, filter FROM lab")
def call_filter(spark, sf):
    return labelled(spark, sf).select("call_id", "filter")


@query(f"WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER} SELECT count(*) AS n_calls, count(*) FILTER (filter = 'Pass') AS n_pass, count(*) FILTER (filter <> 'Pass') AS n_filtered FROM lab")
def call_qc(spark, sf):
    return calls.call_stats(labelled(spark, sf))


def allele_pairs(spark, sf):
    """Pairs of sequences of one target that differ by a stretch: a base, a deletion, an insertion, or a turned one."""
    c = I.spread(I.table(spark, sf, "customer", "c_custkey"), 20_000)
    k = F.col("c_custkey")
    seq = F.concat(*(I.dna(F.concat(k.cast("string"), F.lit(x))) for x in "abcd"))
    at, n = (k % 40 + 20).cast("int"), (k % 60 + 1).cast("int")
    head, mid, tail = F.substring(seq, F.lit(1), at), F.substring(seq, at + 1, n), F.substring(seq, at + n + 1, F.lit(128))
    kind = k % 4
    alt = F.when(kind == 0, F.concat(head, F.translate(F.substring(seq, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(seq, at + 2, F.lit(128)))).when(kind == 1, F.concat(head, tail)).when(kind == 2, F.concat(head, mid, mid, tail)).otherwise(F.concat(head, S.reverse_complement(mid), tail))
    return c.select(k.alias("id"), F.concat(F.lit("chr"), (k % 9).cast("string"), F.lit(":1000-1127")).alias("target_id"), seq.alias("ref_seq"), alt.alias("alt_seq"))


_ALTS = """alts AS (SELECT target_id, seq AS ref_seq, substr(seq, 1, 39) || translate(substr(seq, 40, 1), 'ACGT', 'CGTA') || substr(seq, 41) AS alt_seq FROM panel WHERE length(seq) >= 31),
k2 AS (SELECT target_id, side, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT target_id, side, substr(s, i, 31) AS raw FROM
  (SELECT target_id, 'alt' AS side, alt_seq AS s, unnest(range(1, length(alt_seq) - 29)) AS i FROM alts UNION ALL SELECT target_id, 'ref', ref_seq, unnest(range(1, length(ref_seq) - 29)) FROM alts))),
own AS (SELECT DISTINCT * FROM k2 x WHERE NOT EXISTS (SELECT 1 FROM k2 y WHERE y.target_id = x.target_id AND y.kmer = x.kmer AND y.side <> x.side)),
pr AS (SELECT target_id, coalesce(min(n_molecules) FILTER (side = 'alt'), 0) AS min_alt_molecules, CAST(coalesce(sum(n_duplex) FILTER (side = 'alt'), 0) AS BIGINT) AS sum_alt_duplex,
  count(n_molecules) FILTER (side = 'alt') AS kmers_found, count(*) FILTER (side = 'alt') AS kmers_total, coalesce(avg(coalesce(n_molecules, 0)) FILTER (side = 'ref'), 0.0) AS mean_ref FROM own LEFT JOIN idx USING (kmer) GROUP BY target_id)"""


def probes(spark, sf):
    p = I.panel(spark, sf).where("length(seq) >= 31")
    alt = F.concat(F.substring("seq", 1, 39), F.translate(F.substring("seq", 40, 1), "ACGT", "CGTA"), F.substring("seq", 41, 1 << 30))
    pairs = p.select("target_id", F.col("seq").alias("ref_seq"), alt.alias("alt_seq"))
    return calls.rescue_probe(pairs, listed_index(spark, sf, p, pairs.select(F.col("alt_seq").alias("seq"))))


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {I.SQL_INDEX}, {_ALTS} SELECT target_id, min_alt_molecules, sum_alt_duplex, kmers_found, kmers_total, round(mean_ref, 6) AS mean_ref_molecules,
  round(coalesce(min_alt_molecules / nullif(min_alt_molecules + mean_ref, 0), 0), 6) AS approx_vaf FROM pr WHERE kmers_total > 0""")
def rescue_probe(spark, sf):
    return rounded(probes(spark, sf), "mean_ref_molecules", "approx_vaf")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {I.SQL_INDEX}, {_ALTS}, cl AS (SELECT 't' || o_orderkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Pass' ELSE 'LowConfidence' END AS filter FROM orders)
  SELECT target_id, filter, 'CALLED' AS call_source FROM cl UNION ALL SELECT target_id, NULL, CASE WHEN target_id IN (SELECT target_id FROM cl) THEN 'SUBTHRESHOLD' WHEN kmers_found > 0 THEN 'RESCUED' ELSE 'NO_EVIDENCE' END
  FROM pr WHERE kmers_total > 0 AND target_id NOT IN (SELECT target_id FROM cl WHERE filter = 'Pass')""")
def rescue_labels(spark, sf):
    o = I.table(spark, sf, "orders", "o_orderkey")
    cl = o.select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, "Pass").otherwise("LowConfidence").alias("filter"), F.lit("CALLED").alias("call_source"))
    return calls.rescued(cl, probes(spark, sf)).select("target_id", "filter", "call_source")


# --- tumour-informed filters and range joins


@query(f"WITH {I.SQL_CALLS}, {I.SQL_TRUTH} SELECT call_id FROM calls WHERE EXISTS (SELECT 1 FROM truth t WHERE (t.chrom, t.pos, t.ref, t.alt) = (calls.chrom, calls.pos, calls.ref, calls.alt))")
def ti_exact(spark, sf):
    return calls.exact_matches(I.call_rows(spark, sf), I.truth_rows(spark, sf)).select("call_id")


@query(f"WITH {I.SQL_CALLS}, {I.SQL_TRUTH} SELECT call_id FROM calls WHERE EXISTS (SELECT 1 FROM truth t WHERE t.chrom = calls.chrom AND abs(t.pos - calls.pos) <= 3)")
def ti_tolerance(spark, sf):
    return calls.near_matches(I.call_rows(spark, sf), I.truth_rows(spark, sf), 3).select("call_id")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL} SELECT molecule_id FROM docs d WHERE EXISTS (SELECT 1 FROM panel p WHERE length(p.seq) >= 31 AND contains(d.seq, p.seq))""")
def ti_sequence(spark, sf):
    found = calls.containing(doc_molecules(spark, sf), I.panel(spark, sf), "molecule_id", I.K)
    return found.select("molecule_id").distinct()


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, d AS (SELECT chrom, pos, count(*) AS depth FROM truth GROUP BY ALL) SELECT call_id, (SELECT arg_min(depth, (abs(d.pos - c.pos), d.pos)) FROM d WHERE d.chrom = c.chrom) AS depth FROM calls c""")
def nearest_partner(spark, sf):
    depth = I.truth_rows(spark, sf).groupBy("chrom", F.col("pos").alias("mid")).agg(F.count("*").alias("depth"))
    return calls.nearest(I.call_rows(spark, sf).select("call_id", "chrom", F.col("pos").alias("mid")), depth, "depth").select("call_id", "depth")


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, d AS (SELECT chrom, pos, count(*) AS depth FROM truth GROUP BY ALL),
  j AS (SELECT call_id, n_alt, chrom AS ca, pos AS ma, 'chr' || (call_id % 5) AS cb, call_id * 3 % 9000 AS mb FROM calls WHERE variant_type = 'Fusion'),
  x AS (SELECT *, ((SELECT arg_min(depth, (abs(d.pos - ma), d.pos)) FROM d WHERE d.chrom = ca) + (SELECT arg_min(depth, (abs(d.pos - mb), d.pos)) FROM d WHERE d.chrom = cb)) / 2 AS partner_depth FROM j)
  SELECT call_id, partner_depth, round(n_alt / partner_depth, 6) AS vaf FROM x""")
def fusion_vaf(spark, sf):
    j = I.call_rows(spark, sf).where("variant_type = 'Fusion'")
    j = j.select(F.col("call_id").alias("target_id"), F.col("n_alt").alias("n_molecules"), F.col("chrom").alias("chrom_a"), F.col("pos").alias("mid_a"), F.concat(F.lit("chr"), (F.col("call_id") % 5).cast("string")).alias("chrom_b"), (F.col("call_id") * 3 % 9000).alias("mid_b"))
    depth = I.truth_rows(spark, sf).groupBy("chrom", F.col("pos").alias("mid")).agg(F.count("*").alias("depth"))
    return rounded(calls.fusion_vaf(j, depth), "vaf").select(F.col("target_id").alias("call_id"), "partner_depth", "vaf")


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, t AS (SELECT DISTINCT target_id, chrom, CAST(split_part(split_part(target_id, ':', 2), '-', 1) AS BIGINT) AS s, CAST(split_part(target_id, '-', 2) AS BIGINT) AS e FROM calls)
  SELECT v.chrom, v.pos, v.ref, v.alt, (SELECT arg_min(t.target_id, (t.s, t.target_id)) FROM t WHERE t.chrom = v.chrom AND v.pos BETWEEN t.s AND t.e) AS target_id FROM (SELECT DISTINCT chrom, pos, ref, alt FROM truth) v""")
def label_intervals(spark, sf):
    t = I.call_rows(spark, sf).select("target_id").distinct().withColumn("r", S.target_region(F.col("target_id"))).select("target_id", "r.*")
    return scoring.label_by_interval(I.truth_rows(spark, sf).select("chrom", "pos", "ref", "alt").distinct(), t).select("chrom", "pos", "ref", "alt", "target_id")


@query("""WITH c AS (SELECT c_custkey AS id, 'chr' || (c_custkey % 9) || ':' || c_custkey || '-' || (c_custkey + 100) AS base, ['', '_DEL_maxpath200', '_MAXPATH150', '_SNV_1bp'][c_custkey % 4 + 1] AS suffix FROM customer)
  SELECT id, CASE WHEN suffix = '' THEN id END AS start, id AS any_start, CASE WHEN suffix = '_DEL_maxpath200' THEN 200 WHEN suffix = '_MAXPATH150' THEN 150 END AS path_limit FROM c""")
def target_ids(spark, sf):
    c = I.table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    name = F.concat(F.lit("chr"), (F.col("id") % 9).cast("string"), F.lit(":"), F.col("id").cast("string"), F.lit("-"), (F.col("id") + 100).cast("string"), F.element_at(F.array(*map(F.lit, ("", "_DEL_maxpath200", "_MAXPATH150", "_SNV_1bp"))), (F.col("id") % 4 + 1).cast("int")))
    return c.select("id", S.target_region(name)["start"].alias("start"), S.labelled_region(name)["start"].alias("any_start"), S.path_limit(name).alias("path_limit"))


# --- paths


def doc_molecules(spark, sf):
    """Documents' letters, written: their texts are dealt to all cores and read through only once.

    The sample stays a constant, which no join needs to sort by.
    """
    return written(I.documents(spark, sf).select("molecule_id", "seq")).select(F.lit("s").alias("sample_id"), "molecule_id", "seq")


@query()
def path_walk(spark, sf):
    molecules = doc_molecules(spark, sf)
    nodes = written(graph.target_nodes(I.panel(spark, sf), S.explode_codes(molecules, "seq", I.K), molecules=molecules))
    return graph.walk_paths(I.panel(spark, sf), nodes)


_PATHS = """paths AS (SELECT target_id, seq AS path_seq, true AS is_reference FROM panel UNION ALL SELECT target_id, substr(seq, 1, 39) || translate(substr(seq, 40, 1), 'ACGT', 'CGTA') || substr(seq, 41), false FROM panel),
pk AS (SELECT target_id, path_seq, is_reference, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT *, substr(path_seq, i, 31) AS raw FROM (SELECT *, unnest(range(1, greatest(length(path_seq) - 29, 1))) AS i FROM paths))),
pe AS (SELECT pk.target_id, path_seq, is_reference, coalesce(n_molecules, 0) AS m, coalesce(n_duplex, 0) AS d, r.kmer IS NULL AS own FROM pk LEFT JOIN idx ON idx.kmer = pk.kmer
  LEFT JOIN (SELECT DISTINCT target_id, kmer FROM pk WHERE is_reference) r ON r.target_id = pk.target_id AND r.kmer = pk.kmer),
ev AS (SELECT target_id, path_seq, is_reference, min(m) AS min_molecules, round(avg(m), 6) AS mean_molecules, min(d) AS min_duplex, coalesce(min(d) FILTER (own), min(d)) AS min_variant_specific_duplex,
  round(coalesce(avg(m) FILTER (own), avg(m)), 6) AS mean_variant_specific_molecules FROM pe GROUP BY ALL)"""
_EV = ("target_id", "path_seq", "is_reference", "min_molecules", "mean_molecules", "min_duplex", "min_variant_specific_duplex", "mean_variant_specific_molecules")


def scored(spark, sf):
    p = I.panel(spark, sf)
    alt = F.concat(F.substring("seq", 1, 39), F.translate(F.substring("seq", 40, 1), "ACGT", "CGTA"), F.substring("seq", 41, 1 << 30))
    paths = p.select("target_id", F.col("seq").alias("path_seq"), F.lit(True).alias("is_reference")).unionByName(p.select("target_id", alt.alias("path_seq"), F.lit(False).alias("is_reference")))
    return graph.path_evidence(paths, listed_index(spark, sf, paths.select(F.col("path_seq").alias("seq"))), keys=NO_SAMPLE)


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {I.SQL_INDEX}, {_PATHS} SELECT * FROM ev")
def path_evidence(spark, sf):
    return rounded(scored(spark, sf), "mean_molecules", "mean_variant_specific_molecules").select(*_EV)


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {I.SQL_INDEX}, {_PATHS} SELECT target_id, path_seq, row_number() OVER (PARTITION BY target_id ORDER BY min_molecules DESC, mean_molecules DESC, path_seq) AS rank FROM ev")
def path_ranking(spark, sf):
    return graph.rank_paths(scored(spark, sf), NO_SAMPLE).select("target_id", "path_seq", F.col("rank").cast("bigint").alias("rank"))


@query()
def variant_calls(spark, sf):
    return calls.call_variants(written(scored(spark, sf)), keys=NO_SAMPLE).drop("ref_seq", "alt_seq")


@query()
def pipeline_calls(spark, sf):
    rows, targets = I.mutated_reads(spark, sf)
    return pipeline.run(rows, targets).calls.drop("ref_seq", "alt_seq")


# --- scoring

_SETS = """t AS (SELECT DISTINCT chrom, pos, ref, alt FROM truth), c AS (SELECT DISTINCT chrom, pos, ref, alt FROM calls WHERE n_alt > 2),
m AS (SELECT count(*) FILTER (t.pos IS NOT NULL AND c.pos IS NOT NULL) AS tp, count(*) FILTER (t.pos IS NULL) AS fp, count(*) FILTER (c.pos IS NULL) AS fn FROM t FULL JOIN c USING (chrom, pos, ref, alt))"""


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, {_SETS} SELECT tp, fp, fn, round(tp / (tp + fn), 6) AS sensitivity, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""")
def set_metrics(spark, sf):
    out = scoring.set_metrics(I.truth_rows(spark, sf), I.call_rows(spark, sf).where("n_alt > 2"))
    return rounded(out, "sensitivity", "precision", "f1").select("tp", "fp", "fn", "sensitivity", "precision", "f1")


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, c AS (SELECT DISTINCT chrom, pos FROM calls WHERE n_alt > 2), h AS (SELECT t.*, EXISTS (SELECT 1 FROM c WHERE c.chrom = t.chrom AND abs(c.pos - t.pos) <= 10) AS hit FROM truth t),
  m AS (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, (SELECT count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE c.chrom = t.chrom AND abs(c.pos - t.pos) <= 10)) AS fp FROM h)
  SELECT tp, fn, fp, round(tp / (tp + fn), 6) AS sensitivity FROM m""")
def tolerance_scores(spark, sf):
    return rounded(scoring.tolerance_scores(I.truth_rows(spark, sf), I.call_rows(spark, sf).where("n_alt > 2"), 10), "sensitivity")


_REPS = "reps AS (SELECT variant_type AS type, n_ref % 4 AS vaf, n_duplex AS param, n_alt / 12.0 AS sensitivity FROM calls)"


def replicates(spark, sf):
    return I.call_rows(spark, sf).select(F.col("variant_type").alias("type"), (F.col("n_ref") % 4).alias("vaf"), F.col("n_duplex").alias("param"), (F.col("n_alt") / F.lit(12.0)).alias("sensitivity"))


@query(f"WITH {I.SQL_CALLS}, {_REPS} SELECT type, vaf, round(avg(sensitivity), 6) AS sensitivity, count(*) AS n FROM reps GROUP BY ALL")
def sensitivity_by_vaf(spark, sf):
    return rounded(scoring.sensitivity(replicates(spark, sf), "type", "vaf"), "sensitivity")


@query(f"WITH {I.SQL_CALLS}, {_REPS} SELECT param, {', '.join(f'round(avg(sensitivity) FILTER (vaf = {v}), 6) AS vaf_{v}' for v in range(4))} FROM reps GROUP BY param")
def sweep_pivot(spark, sf):
    out = scoring.sweep_pivot(replicates(spark, sf), "param", "vaf", [0, 1, 2, 3])
    return out.select("param", *(F.round(str(v), 6).alias(f"vaf_{v}") for v in range(4)))


@query(f"WITH {I.SQL_CALLS}, {_REPS}, m AS (SELECT type, param, round(avg(sensitivity), 9) AS mean FROM reps GROUP BY ALL) SELECT type, arg_max(param, (mean, -param)) AS best, round(max(mean), 6) AS mean FROM m GROUP BY type")
def sweep_best(spark, sf):
    return rounded(scoring.best_parameter(replicates(spark, sf), "type", "param"), "mean")


_CONC = """k AS (SELECT chrom, pos, ref, alt, arg_max(call_id, call_id) AS call_id FROM calls WHERE n_alt > 1 GROUP BY ALL),
tr AS (SELECT *, ['0p1pc', '0p25pc', '1pc', '2pc'][vaf_class + 1] AS vaf_level, ['SNV', 'DEL', 'INDEL', 'MNV'][pos % 4 + 1] AS variant_type, [5, 15, 30][pos % 3 + 1] AS input_ng,
  pos % 7 < 4 AS alignment_detected, CASE WHEN pos % 11 > 0 THEN pos % 500 END AS alignment_depth FROM truth),
conc AS (SELECT tr.*, k.call_id, k.call_id IS NOT NULL AS call_detected, CASE WHEN alignment_detected AND k.call_id IS NOT NULL THEN 'both_detected' WHEN alignment_detected THEN 'alignment_only'
  WHEN k.call_id IS NOT NULL THEN 'call_only' ELSE 'neither' END AS concordance FROM tr LEFT JOIN k USING (chrom, pos, ref, alt))"""


def concordant(spark, sf):
    pos = F.col("pos")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    truth = I.truth_rows(spark, sf).withColumns({
        "vaf_level": pick(("0p1pc", "0p25pc", "1pc", "2pc"), F.col("vaf_class")), "variant_type": pick(("SNV", "DEL", "INDEL", "MNV"), pos % 4), "input_ng": pick((5, 15, 30), pos % 3),
        "alignment_detected": pos % 7 < 4, "alignment_depth": F.when(pos % 11 > 0, pos % 500),
    })
    rows = I.call_rows(spark, sf).where("n_alt > 1").select("chrom", "pos", "ref", "alt", F.col("call_id").alias("ord"), "call_id")
    return scoring.concordance(truth, rows, scoring.ALLELE)


@query(f"WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, {_CONC} SELECT chrom, pos, ref, alt, vaf_level, variant_type, alignment_detected, call_detected, call_id, concordance FROM conc")
def concordance(spark, sf):
    return concordant(spark, sf).select("chrom", "pos", "ref", "alt", "vaf_level", "variant_type", "alignment_detected", "call_detected", "call_id", "concordance")


@query(f"""WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, {_CONC}, n AS (SELECT vaf_level, variant_type, count(*) AS total_calls, count(*) FILTER (concordance = 'both_detected') AS both_detected,
  count(*) FILTER (concordance = 'alignment_only') AS alignment_only, count(*) FILTER (concordance = 'call_only') AS call_only, count(*) FILTER (concordance = 'neither') AS neither FROM conc GROUP BY ALL)
  SELECT *, round((both_detected + alignment_only) / total_calls, 6) AS alignment_sensitivity, round((both_detected + call_only) / total_calls, 6) AS call_sensitivity,
    round(both_detected / nullif(both_detected + alignment_only, 0), 6) AS concordance_rate FROM n""")
def concordance_summary(spark, sf):
    return rounded(scoring.concordance_summary(concordant(spark, sf)), "alignment_sensitivity", "call_sensitivity", "concordance_rate")


_REASON = """dis AS (SELECT *, concordance AS direction, CASE WHEN alignment_depth IS NULL OR alignment_depth < 100 THEN 'low_depth' WHEN vaf_level IN ('0p001pc', '0p01pc', '0p1pc', '0p25pc') THEN 'low_vaf'
  WHEN variant_type IN ('INDEL', 'INS', 'DEL', 'SV', 'INVDEL') THEN 'variant_type' WHEN input_ng = 5 THEN 'input_amount' ELSE 'unknown' END AS reason FROM conc WHERE concordance IN ('alignment_only', 'call_only'))"""


@query(f"WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, {_CONC}, {_REASON} SELECT chrom, pos, ref, alt, vaf_level, input_ng, direction, reason FROM dis")
def discordance_reason(spark, sf):
    return scoring.discordance(concordant(spark, sf)).select("chrom", "pos", "ref", "alt", "vaf_level", "input_ng", "direction", "reason")


@query(f"WITH {I.SQL_CALLS}, {I.SQL_TRUTH}, {_CONC}, {_REASON} SELECT reason, direction, variant_type, count(*) AS count FROM dis GROUP BY ALL")
def discordance_summary(spark, sf):
    return scoring.discordance_summary(scoring.discordance(concordant(spark, sf)))


@query(f"""WITH {I.SQL_CALLS}, e AS (SELECT 's' || (call_id % 50) AS sample_id, count(*) FILTER (variant_type = 'Fusion' AND n_alt > 3) AS calls, CAST(call_id % 50 AS BIGINT) * 2 AS events FROM calls GROUP BY ALL)
  SELECT sample_id, least(events, calls) AS tp, greatest(calls - events, 0) AS fp, greatest(events - calls, 0) AS fn FROM e""")
def fusion_scores(spark, sf):
    rows = I.call_rows(spark, sf).select(F.concat(F.lit("s"), (F.col("call_id") % 50).cast("string")).alias("sample_id"), (F.col("call_id") % 50 * 2).alias("events"), F.when((F.col("variant_type") == "Fusion") & (F.col("n_alt") > 3), "PASS").otherwise("LOW").alias("filter"), F.lit("BND").alias("svtype"))
    return scoring.fusion_scores(rows.select("sample_id", "events").distinct(), rows).select("sample_id", "tp", "fp", "fn")


_ML = "s AS (SELECT CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label, (doc_id * 7919 % 1000) / 1000.0 AS prob FROM labels)"


@query(f"""WITH {_ML}, p AS (SELECT prob, sum(label) AS p, count(*) - sum(label) AS n FROM s GROUP BY prob), c AS (SELECT *, sum(p) OVER (ORDER BY prob DESC) AS tp, sum(n) OVER (ORDER BY prob DESC) AS fp FROM p),
  a AS (SELECT sum(n * (tp - p / 2)) AS area, sum(p * tp / (tp + fp)) AS ap, sum(p) AS pos, sum(n) AS neg, coalesce(sum(p) FILTER (prob >= 0.5), 0) AS tp, coalesce(sum(n) FILTER (prob >= 0.5), 0) AS fp FROM c)
  SELECT round(area / (pos * neg), 6) AS auroc, round(ap / pos, 6) AS auprc, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM a""")
def ml_metrics(spark, sf):
    rows = I.table(spark, sf, "labels", "doc_id", "toxic").select((F.col("toxic") == 1).cast("int").alias("label"), (F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)).alias("prob"))
    return rounded(scoring.ml_metrics(rows), "auroc", "auprc", "precision", "recall", "f1")


_FOLDS = """f AS (SELECT (o_orderkey * 7919 % 1000) / 1000.0 AS prob, CASE WHEN o_orderkey % 13 + o_custkey % 4 > 8 THEN 1 ELSE 0 END AS label, CAST(CAST('0x' || substr(md5('s' || (o_custkey % 40)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders)"""


@query(f"""WITH {_FOLDS}, p AS (SELECT fold, prob, sum(label) AS p, count(*) - sum(label) AS n FROM f GROUP BY fold, prob),
  c AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY prob DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY prob DESC) AS fp FROM p),
  a AS (SELECT fold, sum(n * (tp - p / 2)) AS area, sum(p * tp / (tp + fp)) AS ap, sum(p) AS pos, sum(n) AS neg, coalesce(sum(p) FILTER (prob >= 0.5), 0) AS tp, coalesce(sum(n) FILTER (prob >= 0.5), 0) AS fp FROM c GROUP BY fold)
  SELECT fold, round(area / (pos * neg), 6) AS auroc, round(ap / pos, 6) AS auprc, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1, CAST(pos AS BIGINT) AS n_pos, CAST(pos + neg AS BIGINT) AS n_total FROM a""")
def fold_metrics(spark, sf):
    """Figures by fold of given scores; folds keep samples whole."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = I.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        (k * 7919 % 1000 / F.lit(1000.0)).alias("prob"), (k % 13 + c % 4 > 8).cast("int").alias("label"), scoring.group_fold(F.concat(F.lit("s"), (c % 40).cast("string"))).alias("fold")
    )
    return rounded(scoring.ml_metrics(o, keys=["fold"]), "auroc", "auprc", "precision", "recall", "f1")


@query("""SELECT CAST(CAST('0x' || substr(md5('s' || (o_custkey % 40)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n_rows, count(*) FILTER (o_orderkey % 13 + o_custkey % 4 > 8) AS n_pos, true AS better_than_chance, true AS within_one FROM orders GROUP BY ALL""")
def cross_validation(spark, sf):
    """Boosted trees fitted on the other folds and scored on their own; labels follow counts that the features show."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = I.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.concat(F.lit("s"), (c % 40).cast("string")).alias("sample_id"), (k % 13).cast("double").alias("nalt"), (c % 4).cast("double").alias("ndup"), (k % 13 + c % 4 > 8).cast("int").alias("label")
    )
    scored, metrics = ml.cross_validate(o, ["nalt", "ndup"], "sample_id", rounds=5)
    rows = scored.groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum(F.col("label").cast("bigint")).alias("n_pos"), F.bool_and(F.col("prob").between(0, 1)).alias("within_one"))
    return rows.join(metrics.select("fold", (F.col("auroc") > 0.9).alias("better_than_chance")), "fold")


# --- features


def feature_rows(spark, sf):
    c, k = _with_stats(I.call_rows(spark, sf)), F.col("call_id")
    return c.select("call_id", "variant_type", F.repeat("ref", (k % 5 + 1).cast("int")).alias("ref_seq"), F.repeat("alt", (k % 3 + 1).cast("int")).alias("alt_seq"), "vaf", (F.col("vaf") / 2).alias("vaf_ci_low"), (F.col("vaf") * 2 + k % 10 / 100).alias("vaf_ci_high"),
        F.col("n_ref").alias("n_molecules_ref"), F.col("n_alt").alias("n_molecules_alt"), F.col("n_duplex").alias("n_duplex_alt"), (F.col("n_alt") - F.col("n_duplex")).alias("n_simplex_alt"),
        F.col("fwd").alias("n_simplex_fwd_alt"), F.col("rev").alias("n_simplex_rev_alt"), F.col("bias").alias("strand_bias_p"), F.col("conf").alias("confidence"),
        (k % 11).alias("n_duplex_ref"), (k % 17).alias("n_simplex_ref"), (k % 10 / 1000).alias("mean_alt_error_prob"), (k % 3).alias("min_variant_specific_duplex"))


_FEAT = f"""v AS (SELECT call_id, variant_type, vaf, vaf / 2 AS lo, vaf * 2 + call_id % 10 / 100 AS hi, CAST(n_ref AS DOUBLE) AS nref, CAST(n_alt AS DOUBLE) AS nalt, CAST(n_duplex AS DOUBLE) AS ndupalt, CAST(n_alt - n_duplex AS DOUBLE) AS nsimalt, bias AS sbp, conf,
  CAST(call_id % 5 + 1 AS DOUBLE) AS ref_len, CAST(call_id % 3 + 1 AS DOUBLE) AS alt_len, fwd, rev, call_id % 11 AS dref, call_id % 17 AS sref, call_id % 10 / 1000 AS err, call_id % 3 AS own FROM lab)"""


@query(f"""WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER}, {_FEAT}
  SELECT call_id, round(vaf, 6) AS vaf, nref, nalt, ndupalt, nsimalt, round(sbp, 6) AS sbp, round(conf, 6) AS conf, ref_len, alt_len, round(ndupalt / (nalt + 1e-9), 6) AS duplex_frac, CAST(ndupalt > 0 AS DOUBLE) AS has_duplex, round(hi - lo, 6) AS ci_width, nref + nalt AS alt_depth,
    round(ln(nalt + 1), 6) AS log_nalt, round(ln(nref + 1), 6) AS log_nref, round(ln(nref + nalt + 1), 6) AS log_alt_depth, round(ln(vaf + 1e-6), 6) AS log_vaf, round(vaf * conf, 6) AS vaf_times_conf, round(vaf * nalt, 6) AS vaf_times_nalt,
    round(nalt / (conf + 1e-9), 2) AS nalt_over_conf, round((hi - lo) / (vaf + 1e-9), 2) AS ci_width_rel, round(nalt / (nref + 1), 6) AS snr, round(conf * conf, 6) AS conf_sq, nalt * nalt AS nalt_sq, round(vaf * vaf, 6) AS vaf_sq,
    round(ref_len / (alt_len + 1), 6) AS ref_alt_len_ratio, abs(ref_len - alt_len) AS indel_size, round(ndupalt / (vaf * (nref + nalt) + 1e-9), 6) AS duplex_enrichment, round(nsimalt / (nalt + 1e-9), 6) AS simplex_only_frac,
    CAST(conf > 0.99 AS DOUBLE) AS conf_above_99, CAST(conf > 0.999 AS DOUBLE) AS conf_above_999, CAST(sbp > 0.05 AS DOUBLE) AS sbp_above_05, CAST(CASE variant_type WHEN 'SNV' THEN 1 WHEN 'Deletion' THEN 3 ELSE 0 END AS DOUBLE) AS variant_class_enc FROM v""")
def ml_features_33(spark, sf):
    out = ml.call_features(feature_rows(spark, sf), {"SNV": 1, "Deletion": 3})
    coarse = ("nalt_over_conf", "ci_width_rel")
    return out.select("call_id", *(F.round(c, 2 if c in coarse else 6).alias(c) for c in ml.CALL_FEATURES))


@query(f"""WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER}, {_FEAT}, y AS (SELECT *, ndupalt / (ndupalt + dref + 1e-9) AS dv, nsimalt / (nsimalt + sref + 1e-9) AS sv FROM v)
  SELECT call_id, round(dv, 6) AS duplex_vaf, round(sv, 6) AS simplex_vaf, round(dv - sv, 6) AS duplex_simplex_vaf_delta, round(abs(vaf - dv), 6) AS vaf_duplex_agreement, round(ndupalt / (nalt + 1e-9), 6) AS duplex_enrichment,
    round(least(fwd, rev) / (fwd + rev + 1e-9), 6) AS strand_balance, round((fwd - rev) / (fwd + rev + 1e-9), 6) AS strand_asymmetry, ndupalt + dref AS duplex_depth, round(dref / (dref + ndupalt + 1e-9), 6) AS duplex_ref_frac,
    round(own / (ndupalt + 1e-9), 2) AS variant_specific_duplex_frac, round((1 - err) * conf, 6) AS qual_confidence_interaction, round((1 - err) * vaf, 6) AS qual_vaf_interaction, round(ln(1 + ndupalt + dref), 6) AS log_duplex_depth, round(ln(1 + nsimalt + sref), 6) AS log_simplex_depth,
    round(ref_len / (alt_len + 1e-9), 6) AS ref_alt_len_ratio, CASE WHEN ref_len = 1 AND alt_len = 1 THEN 'SNV' WHEN greatest(ref_len, alt_len) <= 5 THEN 'short_indel' ELSE 'medium_indel' END AS variant_class,
    CASE WHEN sbp < 0.01 THEN 'low' WHEN sbp < 0.05 THEN 'medium' ELSE 'high' END AS sbp_cat, CAST(conf >= 0.99 AS INT) AS conf_above_99, CAST(sbp >= 0.05 AS INT) AS sbp_above_05 FROM y""")
def ml_features_script(spark, sf):
    out = ml.script_features(feature_rows(spark, sf))
    six = ("duplex_vaf", "simplex_vaf", "duplex_simplex_vaf_delta", "vaf_duplex_agreement", "duplex_enrichment", "strand_balance", "strand_asymmetry", "duplex_ref_frac", "qual_confidence_interaction", "qual_vaf_interaction", "log_duplex_depth", "log_simplex_depth", "ref_alt_len_ratio")
    return out.select("call_id", *(F.round(c, 6).alias(c) for c in six), "duplex_depth", F.round("variant_specific_duplex_frac", 2).alias("variant_specific_duplex_frac"), "variant_class", "sbp_cat", "conf_above_99", "sbp_above_05")


_WIN = "w AS (SELECT c_custkey AS id, translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') || translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'AACCAACCGGTTGGTT') AS s FROM customer)"


def windows(spark, sf):
    k = F.col("c_custkey").cast("string").cast("binary")
    return I.spread(I.table(spark, sf, "customer", "c_custkey"), 20_000).select(F.col("c_custkey").alias("id"), F.concat(F.translate(F.md5(k), "0123456789abcdef", "ACGTACGTACGTACGT"), F.translate(F.md5(k), "0123456789abcdef", "AACCAACCGGTTGGTT")).alias("s"))


_DUST = "SELECT id, round(sum(c * (c - 1) / 2) / (any_value(n) - 2), 6) AS dust FROM (SELECT id, n, tri, count(*) AS c FROM (SELECT id, length(x) AS n, substr(x, i, 3) AS tri FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM {})) GROUP BY ALL) GROUP BY id"
_RUNS = "regexp_extract_all(s, 'A+|C+|G+|T+')"
#: Share of bases that some homopolymer of 3 or dinucleotide repeat of 6 bases covers.
_REPEATS = """round(len(list_filter(range(1, length(s) + 1), lambda i: len(list_filter(range(greatest(i - 2, 1), i + 1), lambda j: length(substr(s, j, 3)) = 3 AND substr(s, j, 3) = repeat(substr(s, j, 1), 3))) > 0
  OR len(list_filter(range(greatest(i - 5, 1), i + 1), lambda j: length(substr(s, j, 6)) = 6 AND substr(s, j, 6) = repeat(substr(s, j, 2), 3))) > 0)) / length(s), 6)"""


@query(f"""WITH {_WIN}, v AS (SELECT id, s, CASE id % 5 WHEN 0 THEN substr(s, 1, id % 64) || substr(s, id % 64 + 2) WHEN 1 THEN substr(s, 1, id % 64) || 'AC' || substr(s, id % 64 + 1)
    ELSE substr(s, 1, id % 64) || substr('ACGT', CAST(id % 4 + 1 AS INT), 1) || substr(s, id % 64 + 2) END AS a FROM w),
  p AS (SELECT *, length(s) AS n, length(a) AS m, len(list_filter(range(1, 65), lambda i: i <= length(a) AND substr(s, 1, i) = substr(a, 1, i))) AS pre, len(list_filter(range(1, 65), lambda i: i <= length(a) AND right(s, i) = right(a, i))) AS tail FROM v),
  q AS (SELECT *, n = m AND pre + tail = n - 1 AS snv, substr(s, pre + 1, 1) || '>' || substr(a, pre + 1, 1) AS change, greatest(n - least(tail, least(n, m) - pre), pre) AS stop, substr(s, greatest(pre - 31, 1), 64) AS x FROM p),
  d AS ({_DUST.format("q")})
  SELECT id, CASE WHEN snv THEN list_position(['C>A', 'C>G', 'C>T', 'T>A', 'T>C', 'T>G', 'G>T', 'G>C', 'G>A', 'A>T', 'A>G', 'A>C'], change) - 1 ELSE 12 END AS subst_type,
    CASE WHEN snv AND pre BETWEEN 1 AND 62 THEN (strpos('ACGT', substr(s, pre, 1)) - 1) * 16 + (strpos('ACGT', substr(s, pre + 1, 1)) - 1) * 4 + strpos('ACGT', substr(s, pre + 2, 1)) - 1 ELSE 64 END AS trinuc_context,
    CASE WHEN snv AND (change = 'C>T' AND substr(s, pre + 2, 1) = 'G' OR change = 'G>A' AND pre > 0 AND substr(s, pre, 1) = 'C') THEN 1 ELSE 0 END AS is_cpg, round(length(regexp_replace(s, '[^GC]', '', 'g')) / 64.0, 6) AS gc_content_ref,
    greatest(length(regexp_extract(substr(s, 1, pre), '(A+|C+|G+|T+)$')), length(regexp_extract(substr(s, stop + 1), '^(A+|C+|G+|T+)'))) AS homopolymer_run,
    CAST(id % 7 AS DOUBLE) AS n_simplex_fwd_alt, CAST(id % 5 AS DOUBLE) AS n_simplex_rev_alt, CAST(id % 11 AS DOUBLE) AS n_duplex_ref, 0.0 AS n_simplex_ref, id % 10 / 1000 AS mean_alt_error_prob, CAST(id % 3 AS DOUBLE) AS min_variant_specific_duplex, id % 9 / 2 AS mean_variant_specific_molecules,
    round((id % 7 - id % 5) / (id % 7 + id % 5 + 1e-9), 6) AS strand_asymmetry_alt, round(id % 4 / (id % 4 + id % 11 + 1e-9), 6) AS duplex_vaf, round(id % 6 / (id % 6 + 1e-9), 6) AS simplex_vaf,
    round(id % 4 / (id % 4 + id % 11 + 1e-9) - id % 6 / (id % 6 + 1e-9), 6) AS duplex_simplex_vaf_delta, dust AS dust_score, {_REPEATS} AS repeat_fraction FROM q JOIN d USING (id)""")
def ml_features_16(spark, sf):
    k, s, at = F.col("id"), F.col("s"), (F.col("id") % 64).cast("int")
    head, rest = F.substring(s, F.lit(1), at), lambda n: F.substring(s, at + n, F.lit(64))
    alt = F.when(k % 5 == 0, F.concat(head, rest(2))).when(k % 5 == 1, F.concat(head, F.lit("AC"), rest(1))).otherwise(F.concat(head, F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)), rest(2)))
    rows = windows(spark, sf).select(
        "id", s.alias("ref_seq"), alt.alias("alt_seq"), (k % 7).alias("n_simplex_fwd_alt"), (k % 5).alias("n_simplex_rev_alt"), (k % 11).alias("n_duplex_ref"), (k % 10 / 1000).alias("mean_alt_error_prob"),
        (k % 3).alias("min_variant_specific_duplex"), (k % 9 / 2).alias("mean_variant_specific_molecules"), (k % 4).alias("n_duplex_alt"), (k % 6).alias("n_simplex_alt"),
    )
    names = (*ml.CONTEXT_FEATURES, *ml.LOCUS_FEATURES)
    return rounded(ml.context_features(rows).select("id", *names), "gc_content_ref", *names[12:])


@query(f"WITH {_WIN}, y AS (SELECT id, s AS x FROM w) {_DUST.format('y')}")
def dust_score(spark, sf):
    return windows(spark, sf).select("id", F.round(S.dust_score(F.col("s")), 6).alias("dust"))


@query(f"""WITH {_WIN} SELECT id, {_REPEATS} AS repeat_fraction, CAST(list_max(list_transform({_RUNS}, lambda x: length(x))) AS INT) AS longest FROM w""")
def repeat_fraction(spark, sf):
    return windows(spark, sf).select("id", F.round(S.repeat_fraction(F.col("s")), 6).alias("repeat_fraction"), S.longest_homopolymer(F.col("s")).alias("longest"))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8])) AS q FROM orders) SELECT o_orderkey, len(list_filter(q, lambda x: o_totalprice > x)) AS quintile FROM orders, e""")
def quintiles(spark, sf):
    out = ml.quintile(I.table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice")
    return out.select("o_orderkey", F.col("quintile").cast("bigint").alias("quintile"))


# --- explorer


def explorer(spark, sf):
    return explore.Explorer(I.table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F' OR o_orderpriority LIKE '%URGENT%' AND o_totalprice < 50000")
def explore_filter(spark, sf):
    return explorer(spark, sf).filter("o_totalprice >= 100000 AND o_orderstatus == F OR o_orderpriority contains URGENT AND o_totalprice < 50000").select("o_orderkey")


@query("""SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders WHERE o_orderstatus <> 'P'""")
def explore_stats(spark, sf):
    x = explorer(spark, sf)
    x.filter("o_orderstatus != P")
    return rounded(x.stats("o_totalprice"), "mean", "median", "std", "p5", "p95", places=4)


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS total FROM orders), b AS (SELECT CAST(least(4, floor((o_totalprice - lo) / ((hi - lo) / 5))) AS INT) AS bin, lo, hi, total FROM orders, e)
  SELECT bin, round(lo + bin * (hi - lo) / 5, 4) AS low, round(lo + (bin + 1) * (hi - lo) / 5, 4) AS high, count(*) AS n, round(100.0 * count(*) / total, 4) AS percent FROM b GROUP BY bin, lo, hi, total""")
def explore_histogram(spark, sf):
    return rounded(explorer(spark, sf).histogram("o_totalprice"), "low", "high", "percent", places=4)


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, (SELECT count(*) FROM orders) AS total, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY ALL")
def explore_summary(spark, sf):
    return rounded(rounded(explorer(spark, sf).summary("o_orderstatus", "o_totalprice"), "mean", "median", places=4), "share")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def explore_top(spark, sf):
    return explorer(spark, sf).top(10, "o_totalprice").select("o_orderkey")


# --- sinks


@query(f"""WITH {I.SQL_CALLS} SELECT chrom, pos, CASE WHEN variant_type = 'LargeDeletion' THEN '<DEL>' ELSE alt END AS alt, CASE WHEN variant_type = 'LargeDeletion' THEN 'SVTYPE=DEL;SVLEN=-60' ELSE '' END AS sv, count(*) AS n FROM calls GROUP BY ALL""")
def vcf_records(spark, sf):
    c = I.call_rows(spark, sf)
    zero = {x: F.lit(0.0) for x in ("vaf_ci_low", "vaf_ci_high", "strand_bias_p", "confidence")}
    rows = c.withColumns({**zero, "allele": F.struct("chrom", "pos", "ref", "alt"), "ref_seq": F.concat("ref", F.repeat(F.lit("A"), F.lit(60))), "alt_seq": F.col("ref"), "n_molecules_ref": F.col("n_ref"), "n_molecules_alt": F.col("n_alt"), "n_duplex_alt": F.col("n_duplex"), "n_simplex_alt": F.col("fwd"), "filter": F.lit("Pass")})
    out = writers.vcf_records(rows)
    return out.groupBy("chrom", "pos", "alt", F.regexp_extract("info", "(SVTYPE.*)$", 1).alias("sv")).agg(F.count("*").alias("n"))


@query(f"""WITH {I.SQL_CALLS}, f AS (SELECT 'e' || call_id AS event, chrom AS ca, pos AS pa, ref AS ba, fwd % 2 = 1 AS ta, 'chr' || (call_id % 5) AS cb, call_id * 3 % 9000 AS pb, alt AS bb, rev % 2 = 1 AS tb FROM calls WHERE variant_type = 'Fusion'),
  x AS (SELECT *, cb || ':' || pb AS qa, ca || ':' || pa AS qb FROM f)
  SELECT ca AS chrom, pa AS pos, event || '_a' AS id, ba AS ref, CASE WHEN NOT ta AND NOT tb THEN ba || '[' || qa || '[' WHEN NOT ta THEN ba || ']' || qa || ']' WHEN NOT tb THEN ']' || qa || ']' || ba ELSE '[' || qa || '[' || ba END AS alt FROM x
  UNION ALL SELECT cb, pb, event || '_b', bb, CASE WHEN NOT ta AND NOT tb THEN ']' || qb || ']' || bb WHEN NOT ta THEN bb || ']' || qb || ']' WHEN NOT tb THEN bb || '[' || qb || '[' ELSE '[' || qb || '[' || bb END FROM x""")
def bnd_pairs(spark, sf):
    f = I.call_rows(spark, sf).where("variant_type = 'Fusion'").select(F.concat(F.lit("e"), F.col("call_id").cast("string")).alias("event"), F.col("chrom").alias("chrom_a"), F.col("pos").alias("pos_a"), F.col("ref").alias("base_a"), (F.col("fwd") % 2 == 1).alias("turned_a"),
        F.concat(F.lit("chr"), (F.col("call_id") % 5).cast("string")).alias("chrom_b"), (F.col("call_id") * 3 % 9000).alias("pos_b"), F.col("alt").alias("base_b"), (F.col("rev") % 2 == 1).alias("turned_b"))
    return writers.breakend_pair(f).select("chrom", "pos", "id", "ref", "alt")


# --- streaming


@query(f"WITH {I.SQL_DOCUMENTS}, {I.SQL_INDEX} SELECT kmer, n_molecules, n_duplex, n_simplex_fwd, n_simplex_rev FROM idx")
def stream_index(spark, sf):
    from ..streaming.incremental import IncrementalIndex

    path, table = new_path(spark, "stream"), f"{sf}/documents.parquet"
    schema = spark.read.parquet(table).schema
    # A table of one file is named by its folder and a pattern, one of many by itself.
    one = spark._jvm.org.apache.hadoop.fs.Path(table)
    one = one.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(one).isFile()
    source = spark.readStream.schema(schema).parquet(sf, pathGlobFilter="documents.parquet") if one else spark.readStream.schema(schema).parquet(table)
    rows = source.select(F.col("doc_id").alias("molecule_id"), I.letters(F.col("text")).alias("seq"), I.family(F.col("doc_id")).alias("family_type"))
    index = IncrementalIndex(spark, f"{path}/index", keys=NO_SAMPLE)
    index.start(rows, f"{path}/checkpoint").awaitTermination()
    return index.read()


@query(f"""WITH {I.SQL_READS}, o AS (SELECT sample_id, umi_a, umi_b, min(read_ord) AS first_ord FROM good GROUP BY ALL)
  SELECT sample_id, umi_a, umi_b, fwd_reads, rev_reads, first_ord, CASE WHEN fwd_reads > 0 AND rev_reads > 0 THEN 'Duplex' WHEN fwd_reads + rev_reads = 1 THEN 'Singleton' WHEN fwd_reads > 0 THEN 'SimplexFwd' ELSE 'SimplexRev' END AS family_type
  FROM fams JOIN o USING (sample_id, umi_a, umi_b)""")
def stream_families(spark, sf):
    """Reads arrive in two parts; the stream ends after the first, and is started again from its checkpoint for the second."""
    from ..streaming.incremental import RunningFamilies

    path = new_path(spark, "families")
    rows = reads.passed(parsed(spark, sf)).select("sample_id", "umi_a", "umi_b", "strand", "read_ord")
    families = RunningFamilies(spark, f"{path}/state")
    for part in (0, 1):
        rows.where(F.col("read_ord") % 2 == part).write.mode("append").parquet(f"{path}/reads")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/reads")
        families.start(stream, f"{path}/checkpoint").awaitTermination()
    return families.read()


@query(f"""WITH RECURSIVE {I.SQL_LONG_UMIS}, {_greedy("long_umis", "0", 2).replace("umi_b, n, first_ord, substr(", "umi_b, n, substr(")} WHERE seed <> umi_a || umi_b""")
def log_umi_merges(spark, sf):
    """UMI pairs that joined another one's cluster."""
    return logs.umi_merges(umis.cluster_umis(I.long_umis(spark, sf), 2))


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {_ENDS} SELECT target_id, coalesce(i.n, 0) AS start_count, coalesce(j.n, 0) AS end_count
  FROM ends LEFT JOIN seen i ON i.kmer = s LEFT JOIN seen j ON j.kmer = e WHERE s IS NOT NULL AND (coalesce(i.n, 0) >= 5 OR coalesce(j.n, 0) >= 5)""")
def log_anchors_flagged(spark, sf):
    """Targets whose first or last k-mer occurs too often to begin or end a walk."""
    p = I.panel(spark, sf)
    return logs.anchors_flagged(kmers.validate_anchors(p, listed_index(spark, sf, p), threshold=5)).select("target_id", "start_count", "end_count")
