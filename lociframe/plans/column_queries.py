"""Queries of columns, read filters, logs and records over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles, stats
from ..functions import sequence as S
from ..operators import assembly, calls, graph, kmers, logs, reads
from ..sources import writers
from . import inputs as I
from .queries import _BIAS, _ENDS, _FILTER, _SSC, allele_pairs, labelled, listed_index, parsed, query, rounded


def _md5(name: str, suffix: str = "") -> str:
    value = f"CAST({name} AS VARCHAR)" + (f" || '{suffix}'" if suffix else "")
    return f"translate(md5({value}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def customers(spark, sf):
    return I.table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")


def _dna(suffix: str = ""):
    return I.dna(F.concat(F.col("id").cast("string"), F.lit(suffix)))


# --- bases, k-mers, sequences


@query("""WITH b AS (SELECT c_custkey AS id, substr('ACGTacgtNX-', CAST(c_custkey % 11 + 1 AS INT), 1) AS base FROM customer)
  SELECT id, base, CASE WHEN upper(base) IN ('A', 'C', 'G', 'T') THEN CAST(strpos('ACGT', upper(base)) - 1 AS INT) END AS code, CASE WHEN id % 6 < 4 THEN substr('ACGT', CAST(id % 6 + 1 AS INT), 1) END AS letter FROM b""")
def base_codes(spark, sf):
    c = customers(spark, sf).withColumn("base", F.substring(F.lit("ACGTacgtNX-"), (F.col("id") % 11 + 1).cast("int"), F.lit(1)))
    return c.select("id", "base", S.encode_base(F.col("base")).alias("code"), S.decode_base((F.col("id") % 6).cast("int")).alias("letter"))


@query(f"""WITH c AS (SELECT c_custkey AS id, substr({_md5('c_custkey')}, 1, CAST(c_custkey % 31 + 1 AS INT)) AS s FROM customer),
  d AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(strpos('ACGT', x) - 1 AS BIGINT))), lambda a, x: a * 4 + x) AS code FROM c)
  SELECT id, code, CASE WHEN code = 0 THEN 1 ELSE CAST(ceil(length(format('{{:b}}', code)) / 2.0) AS INT) END AS k FROM d""")
def kmer_size_inferred(spark, sf):
    code = S.encode_kmer(F.substring(_dna(), F.lit(1), (F.col("id") % 31 + 1).cast("int")))
    return customers(spark, sf).select("id", code.alias("code")).select("id", "code", S.infer_k(F.col("code")).alias("k"))


@query(f"WITH {I.SQL_PANEL} SELECT target_id, seq FROM panel WHERE length(seq) >= 31")
def sequence_rebuilt(spark, sf):
    """Target sequences from their k-mers in order; a target's k-mers are no more than its bases."""
    rows = S.explode_kmers(I.panel(spark, sf), "seq", I.K, raw="raw").groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("ks"))
    return rows.select("target_id", S.reconstruct(F.col("ks.raw")).alias("seq"))


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS s FROM documents),
  w AS (SELECT doc_id, substr(s, i, 5) AS raw FROM (SELECT *, unnest(range(1, greatest(length(s) - 3, 1))) AS i FROM d))
  SELECT doc_id, count(*) AS n, count(DISTINCT upper(raw)) AS kinds FROM w WHERE regexp_full_match(raw, '[ACGTacgt]+') GROUP BY doc_id""")
def kmers_around_gaps(spark, sf):
    d = I.spread(I.table(spark, sf, "documents", "doc_id", "text")).select("doc_id", F.regexp_replace("text", "[^ACGTNacgtn]", "").alias("s"))
    per = S.explode_kmers(d, "s", 5, canonical=None, raw="raw").groupBy("doc_id", "raw").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


_ALT_WINDOW = f"""w AS (SELECT c_custkey AS id, {_md5('c_custkey')} AS s, c_custkey % 40 - 2 AS off, ['A', 'ac', 'G', 'tt', 'CGT'][c_custkey % 5 + 1] AS ref, ['C', 'G', 'TTA', 'A'][c_custkey % 4 + 1] AS alt FROM customer),
v AS (SELECT *, CASE WHEN id % 2 = 0 AND off BETWEEN 0 AND 31 THEN lower(substr(s, CAST(off + 1 AS INT), length(ref))) ELSE ref END AS r FROM w)"""


@query(f"""WITH {_ALT_WINDOW} SELECT id, r AS ref, CASE WHEN off >= 0 AND length(r) > 0 AND off + length(r) <= 32 AND upper(substr(s, CAST(off + 1 AS INT), length(r))) = upper(r)
  THEN substr(s, 1, CAST(off AS INT)) || alt || substr(s, CAST(off + length(r) + 1 AS INT)) END AS alt_seq FROM v""")
def alt_windows(spark, sf):
    at = F.col("id") % 40 - 2
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % n + 1).cast("int"))
    c = customers(spark, sf).withColumns({"s": _dna(), "at": at, "ref": pick(("A", "ac", "G", "tt", "CGT"), 5), "alt": pick(("C", "G", "TTA", "A"), 4)})
    own = F.lower(F.substring(F.col("s"), F.col("at").cast("int") + 1, F.length("ref")))
    c = c.withColumn("ref", F.when((F.col("id") % 2 == 0) & F.col("at").between(0, 31), own).otherwise(F.col("ref")))
    return c.select("id", "ref", S.build_alt(F.col("s"), F.lit(1000), F.lit(1000) + F.col("at"), F.col("ref"), F.col("alt")).alias("alt_seq"))


@query("""WITH h AS (SELECT c_custkey AS id, c_custkey % 5 AS k FROM customer)
  SELECT id, CASE WHEN k < 3 THEN 'G' || id || '_H' END AS name, CASE WHEN k < 3 THEN 'chr' || (id % 22) END AS chrom_a, CASE WHEN k < 3 THEN id END AS start_a, CASE WHEN k < 3 THEN 'chrX' END AS chrom_b,
    CASE WHEN k < 3 THEN id * 2 END AS start_b, CASE WHEN k < 3 THEN id % 70 + 1 END AS breakpoint FROM h""")
def fusion_headers(spark, sf):
    i = F.col("id")
    text = lambda x: x.cast("string")
    end = F.when(i % 5 == 3, F.lit("x")).otherwise(text(i * 2 + 50))
    name = F.concat(F.lit("G"), text(i), F.lit("_H__chr"), text(i % 22), F.lit(":"), text(i), F.lit("-"), text(i + i % 70 + 1), F.lit("__chrX:"), text(i * 2), F.lit("-"), end, F.when(i % 5 == 4, "").otherwise("__fusion"))
    h = customers(spark, sf).select("id", S.fusion_header(name).alias("h"))
    return h.select("id", "h.name", "h.chrom_a", "h.start_a", "h.chrom_b", "h.start_b", "h.breakpoint")


@query(f"""WITH p AS (SELECT c_custkey AS id, {_md5('c_custkey', 'l')} AS l, {_md5('c_custkey', 'r')} AS r, ['DEL', 'DUP', 'INV'][c_custkey % 3 + 1] AS kind, ['FF', 'FR', 'RF', 'RR'][c_custkey % 4 + 1] AS o FROM customer)
  SELECT id, CASE kind WHEN 'DEL' THEN right(l, 10) || left(r, 10) WHEN 'DUP' THEN right(r, 10) || left(l, 10) ELSE right(l, 10) || {_rc('right(r, 10)')} END AS junction,
    right(CASE WHEN o IN ('RF', 'RR') THEN {_rc('l')} ELSE l END, 10) || left(CASE WHEN o IN ('FR', 'RR') THEN {_rc('r')} ELSE r END, 10) AS fusion FROM p""")
def junction_sequences(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))
    left, right = _dna("l"), _dna("r")
    return customers(spark, sf).select("id", S.junction(left, right, pick(("DEL", "DUP", "INV")), 10).alias("junction"), S.fusion_junction(left, right, pick(("FF", "FR", "RF", "RR")), 10).alias("fusion"))


@query("""WITH v AS (SELECT c_custkey AS id, ['vaf0050', 'vaf1', 'x', 'vaf10000'][c_custkey % 4 + 1] AS tag, ['0.5%', '2pc', '0p25', 'none', '12%'][c_custkey % 5 + 1] AS label FROM customer)
  SELECT id, CASE tag WHEN 'vaf0050' THEN 0.005 WHEN 'vaf1' THEN 0.0001 WHEN 'vaf10000' THEN 1.0 END AS by_tag, CASE label WHEN '0.5%' THEN 0.005 WHEN '2pc' THEN 0.02 WHEN '0p25' THEN 0.0025 WHEN '12%' THEN 0.12 END AS by_label FROM v""")
def vaf_labels(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))
    c = customers(spark, sf).select("id", S.vaf_tag(pick(("vaf0050", "vaf1", "x", "vaf10000"))).alias("by_tag"), S.vaf_label(pick(("0.5%", "2pc", "0p25", "none", "12%"))).alias("by_label"))
    return rounded(c, "by_tag", "by_label")


@query("""SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS n, CASE WHEN c_custkey % 3 = 0 THEN 'SNV' END AS kind, c_custkey % 3 = 1 AS flagged FROM customer""")
def info_fields(spark, sf):
    i = F.col("id")
    info = F.concat(F.lit("N="), i.cast("string"), F.when(i % 3 == 0, ";TYPE=SNV").when(i % 3 == 1, ";NOVEL").otherwise(""))
    c = customers(spark, sf).withColumn("m", S.info_map(info))
    return c.select("id", F.col("m")["N"].alias("n"), F.col("m")["TYPE"].alias("kind"), F.map_contains_key("m", F.lit("NOVEL")).alias("flagged"))


@query("""SELECT c_custkey AS id, round(pow(10.0, -(c_custkey % 60) / 10.0), 9) AS p, CAST(c_custkey % 60 AS DOUBLE) AS q FROM customer""")
def phred_scale(spark, sf):
    p = S.phred_to_prob(F.col("id") % 60)
    return customers(spark, sf).select("id", F.round(p, 9).alias("p"), F.round(S.prob_to_phred(p), 6).alias("q"))


_CUT = f"""x AS (SELECT c_custkey AS id, {_md5('c_custkey')} AS a, substr({_md5('c_custkey')}, 1, CAST(c_custkey % 20 AS INT)) || substr({_md5('c_custkey', 'v')}, 1, CAST(c_custkey % 7 AS INT)) || substr({_md5('c_custkey')}, CAST(c_custkey % 25 + 1 AS INT)) AS b FROM customer),
y AS (SELECT *, len(list_filter(range(1, length(a) + 1), lambda i: i <= length(b) AND left(a, i) = left(b, i))) AS pre, len(list_filter(range(1, length(a) + 1), lambda i: i <= length(b) AND right(a, i) = right(b, i))) AS suf FROM x)"""


def cut_pairs(spark, sf):
    i, s = F.col("id"), _dna()
    b = F.concat(F.substring(s, F.lit(1), (i % 20).cast("int")), F.substring(_dna("v"), F.lit(1), (i % 7).cast("int")), F.substring(s, (i % 25 + 1).cast("int"), F.lit(64)))
    return customers(spark, sf).select("id", s.alias("a"), b.alias("b"))


@query(f"WITH {_CUT} SELECT id, CAST(pre AS INT) AS prefix, CAST(suf AS INT) AS suffix FROM y")
def prefix_suffix(spark, sf):
    return cut_pairs(spark, sf).select("id", S.common_prefix(F.col("a"), F.col("b")).alias("prefix"), S.common_suffix(F.col("a"), F.col("b")).alias("suffix"))


@query(f"""WITH {_CUT} SELECT id, CASE WHEN suf < length(a) THEN left(a, length(a) - suf) ELSE left(a, 1) END AS ref, CASE WHEN suf < length(b) THEN left(b, length(b) - suf) ELSE left(b, 1) END AS alt FROM y""")
def alleles_trimmed(spark, sf):
    return cut_pairs(spark, sf).withColumn("t", alleles.trimmed(F.col("a"), F.col("b"))).select("id", "t.ref", "t.alt")


@query("""WITH v AS (SELECT c_custkey AS id, repeat('A', CAST(c_custkey % 30 + 1 AS INT)) AS r, repeat('C', CAST(c_custkey % 7 + 1 AS INT)) AS a FROM customer)
  SELECT id, CASE WHEN length(r) = 1 AND length(a) = 1 THEN 'SNV' ELSE 'INDEL' END AS simple, CASE WHEN length(r) = 1 AND length(a) = 1 THEN 'SNV' WHEN abs(length(r) - length(a)) <= 5 THEN 'short_indel' WHEN abs(length(r) - length(a)) <= 20 THEN 'medium_indel' ELSE 'SV' END AS size FROM v""")
def allele_classes(spark, sf):
    r, a = F.repeat(F.lit("A"), (F.col("id") % 30 + 1).cast("int")), F.repeat(F.lit("C"), (F.col("id") % 7 + 1).cast("int"))
    return customers(spark, sf).select("id", alleles.simple_class(r, a).alias("simple"), alleles.size_class(r, a).alias("size"))


_PAIRS = f"""c AS (SELECT c_custkey AS id, {" || ".join(_md5('c_custkey', x) for x in 'abcd')} AS ref_seq, CAST(c_custkey % 40 + 20 AS INT) AS off, CAST(c_custkey % 60 + 1 AS INT) AS n FROM customer),
pairs AS (SELECT id, ref_seq, CASE id % 4 WHEN 0 THEN left(ref_seq, off) || translate(substr(ref_seq, off + 1, 1), 'ACGT', 'CGTA') || substr(ref_seq, off + 2) WHEN 1 THEN left(ref_seq, off) || substr(ref_seq, off + n + 1)
  WHEN 2 THEN left(ref_seq, off) || substr(ref_seq, off + 1, n) || substr(ref_seq, off + 1, n) || substr(ref_seq, off + n + 1) ELSE left(ref_seq, off) || {_rc('substr(ref_seq, off + 1, n)')} || substr(ref_seq, off + n + 1) END AS alt_seq FROM c),
ends AS (SELECT *, CASE WHEN id % 4 = 2 AND starts_with(alt_seq, ref_seq) THEN 128 ELSE len(list_filter(range(1, 129), lambda i: i <= length(alt_seq) AND left(ref_seq, i) = left(alt_seq, i))) END AS p,
  len(list_filter(range(1, 129), lambda i: i <= length(alt_seq) AND right(ref_seq, i) = right(alt_seq, i))) AS suf FROM pairs),
cores AS (SELECT *, substr(ref_seq, p + 1, length(ref_seq) - p - s) AS cr, substr(alt_seq, p + 1, length(alt_seq) - p - s) AS ca FROM (SELECT *, least(suf, least(length(ref_seq), length(alt_seq)) - p) AS s FROM ends))"""


@query(f"""WITH RECURSIVE {_PAIRS}, moved AS (SELECT id, ref_seq, p, cr, ca FROM cores WHERE ref_seq <> alt_seq UNION ALL
    SELECT id, ref_seq, p - 1, CASE WHEN cr <> '' THEN right(cr, 1) || left(cr, length(cr) - 1) ELSE '' END, CASE WHEN ca <> '' THEN right(ca, 1) || left(ca, length(ca) - 1) ELSE '' END FROM moved
    WHERE p > 0 AND (cr = '' OR ca = '') AND right(cr || ca, 1) = substr(ref_seq, p, 1)),
  last AS (SELECT id, arg_min(p, p) AS p, arg_min(cr, p) AS cr, arg_min(ca, p) AS ca, any_value(ref_seq) AS ref_seq FROM moved GROUP BY id)
  SELECT pairs.id, CASE WHEN l.id IS NOT NULL THEN 'chr' || (pairs.id % 9) END AS chrom, CASE WHEN cr <> '' AND ca <> '' THEN 1000 + p WHEN p > 0 THEN 999 + p WHEN l.id IS NOT NULL THEN 1000 END AS pos,
    CASE WHEN cr <> '' AND ca <> '' THEN cr WHEN p > 0 THEN substr(l.ref_seq, p, 1) || cr ELSE cr || substr(l.ref_seq, length(cr) + 1, 1) END AS ref,
    CASE WHEN cr <> '' AND ca <> '' THEN ca WHEN p > 0 THEN substr(l.ref_seq, p, 1) || ca ELSE ca || substr(l.ref_seq, length(cr) + 1, 1) END AS alt FROM pairs LEFT JOIN last l ON l.id = pairs.id""")
def minimal_alleles(spark, sf):
    p = allele_pairs(spark, sf).withColumn("a", alleles.minimal_allele(F.col("target_id"), F.col("ref_seq"), F.col("alt_seq")))
    return p.select("id", "a.chrom", F.col("a.pos").cast("bigint").alias("pos"), "a.ref", "a.alt")


@query(f"""WITH {_PAIRS}, k AS (SELECT *, length(alt_seq) - length(ref_seq) AS d, CAST(ceil(length(ca) * 0.8) AS INT) AS need, len(list_filter(range(1, greatest(length(cr), 1) + 1), lambda i: substr(cr, i, 1) <> substr(ca, i, 1))) AS diff FROM cores)
  SELECT id, CASE WHEN ref_seq = alt_seq THEN 'SNV' WHEN d = 0 AND ({_rc('ref_seq')} = alt_seq OR length(cr) >= 50 AND {_rc('cr')} = ca) THEN 'Inversion' WHEN d = 0 AND diff = 1 THEN 'SNV' WHEN d = 0 THEN 'MNV'
      WHEN d < 0 AND length(cr) >= 50 AND length(ca) >= 50 AND contains({_rc('cr')}, ca) THEN 'InvDel' WHEN d <= -50 THEN 'LargeDeletion' WHEN d < 0 THEN 'Deletion' WHEN d < 50 THEN 'Insertion'
      WHEN len(list_filter(range(1, length(ca) - need + 2), lambda i: contains(ref_seq || ref_seq, substr(ca, i, need)))) > 0 THEN 'TandemDuplication' ELSE 'NovelInsertion' END AS variant_type,
    CASE WHEN abs(d) <= 5 THEN 'short_indel' WHEN abs(d) <= 20 THEN 'medium_indel' ELSE 'SV' END AS size_class FROM k""")
def variant_classes(spark, sf):
    p = allele_pairs(spark, sf)
    return p.select("id", alleles.classify(F.col("ref_seq"), F.col("alt_seq")).alias("variant_type"), alleles.size_class(F.col("ref_seq"), F.col("alt_seq")).alias("size_class"))


@query(f"""WITH {I.SQL_2X2} SELECT supplier, round(lgamma(a + b + 1), 6) AS log_factorial, round(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1), 6) AS log_binom,
  round(lgamma(a + c + 1) - lgamma(a + 1) - lgamma(c + 1) + lgamma(b + d + 1) - lgamma(b + 1) - lgamma(d + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1), 6) AS log_pmf FROM t""")
def log_masses(spark, sf):
    t = I.tables2x2(spark, sf)
    a, b, c, d = map(F.col, "abcd")
    out = t.select("supplier", stats.log_factorial(a + b).alias("log_factorial"), stats.log_binom(a + b, a).alias("log_binom"), stats.hypergeometric_log_pmf(a, a + c, b + d, a + b).alias("log_pmf"))
    return rounded(out, "log_factorial", "log_binom", "log_pmf")


#: The interval's ends halve a bracket; with whole numbers, Beta(k + 1, n - k + 1) below x is the chance of over k hits in n + 1 trials.
_BETA = """n AS (SELECT DISTINCT n_alt AS k, n_alt + n_ref AS n FROM calls), w AS (SELECT k, n, [exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j)) FOR j IN range(0, k + 1)] AS c FROM n),
b AS (SELECT k, n, c, q, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM w, (VALUES (0.025), (0.975)) t(q) UNION ALL
  SELECT k, n, c, q, CASE WHEN below < q THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below < q THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM
  (SELECT *, 1 - list_sum(list_transform(range(0, k + 1), lambda j: c[j + 1] * pow((lo + hi) / 2, j) * pow(1 - (lo + hi) / 2, n + 1 - j))) AS below FROM b WHERE i < 50))"""


@query(f"""WITH RECURSIVE {I.SQL_CALLS}, {_BETA} SELECT k AS n_alt, n, k / n AS vaf, round(max((lo + hi) / 2) FILTER (q < 0.5), 8) AS low, round(max((lo + hi) / 2) FILTER (q > 0.5), 8) AS high FROM b WHERE i = 50 GROUP BY k, n""")
def vaf_beta_ci(spark, sf):
    rows = I.call_rows(spark, sf).select("n_alt", (F.col("n_alt") + F.col("n_ref")).alias("n")).distinct()
    return rows.select("n_alt", "n", stats.vaf_interval(F.col("n_alt"), F.col("n")).alias("i")).select("n_alt", "n", "i.vaf", F.round("i.low", 8).alias("low"), F.round("i.high", 8).alias("high"))


# --- reads and families


@query(f"""WITH {I.SQL_READS} SELECT sample_id, CASE WHEN least(length(r1_seq), length(r2_seq)) < 7 THEN 'ReadTooShort' WHEN least(length(r1_seq), length(r2_seq)) - 7 < 120 THEN 'TemplateTooShort' WHEN q < 20 THEN 'LowUmiQuality' END AS drop_reason, count(*) AS n
  FROM (SELECT sample_id, q, CASE WHEN read_ord % 5 = 0 THEN substr(r1_seq, 1, 100) ELSE r1_seq END AS r1_seq, r2_seq FROM reads) GROUP BY ALL""")
def short_templates(spark, sf):
    cut = F.col("read_ord") % 5 == 0
    r = I.reads(spark, sf)
    r = r.withColumns({c: F.when(cut, F.substring(c, 1, 100)).otherwise(F.col(c)) for c in ("r1_seq", "r1_qual")})
    return reads.parse_reads(r, min_template=120).groupBy("sample_id", "drop_reason").agg(F.count("*").alias("n"))


def _families(spark, sf):
    return reads.families(reads.passed(parsed(spark, sf)).withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b"), "part": F.lit(0)}))


@query(f"WITH {I.SQL_READS} SELECT sample_id, umi_a, umi_b, fwd_reads + rev_reads AS size FROM fams WHERE fwd_reads + rev_reads >= 40")
def large_families(spark, sf):
    return reads.large_enough(_families(spark, sf), 40).select("sample_id", F.col("seed_a").alias("umi_a"), F.col("seed_b").alias("umi_b"), (F.col("fwd_reads") + F.col("rev_reads")).alias("size"))


@query(f"WITH {I.SQL_READS} SELECT sample_id, umi_a, umi_b, n, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first_ord) AS INT) AS rank FROM (SELECT sample_id, umi_a, umi_b, count(*) AS n, min(read_ord) AS first_ord FROM good GROUP BY ALL)")
def umi_ranking(spark, sf):
    return reads.ranked_by_count(reads.umi_counts(reads.passed(parsed(spark, sf)))).select("sample_id", "umi_a", "umi_b", "n", "rank")


def _molecules(spark, sf):
    """Molecules of whole UMI pairs: no clusters, no parts, so that SQL can follow."""
    return assembly.molecules(reads.passed(parsed(spark, sf)).withColumns({"seed_a": F.col("umi_a"), "seed_b": F.col("umi_b")}), bits=64)


_MOLS = f"""{_SSC}, p AS (SELECT sample_id, umi_a, umi_b, f.seq AS fs, r.seq AS rs, f.err AS fe, r.err AS re, unnest(range(1, least(length(f.seq), length(r.seq)) + 1)) AS i
  FROM (SELECT * FROM ssc WHERE strand = 'Forward') f JOIN (SELECT * FROM ssc WHERE strand = 'Reverse') r USING (sample_id, umi_a, umi_b)),
d AS (SELECT sample_id, umi_a, umi_b, string_agg(CASE WHEN substr(fs, i, 1) = substr(rs, i, 1) OR fe[i] <= re[i] THEN substr(fs, i, 1) ELSE substr(rs, i, 1) END, '' ORDER BY i) AS seq FROM p GROUP BY ALL),
mols AS (SELECT fams.*, f.seq AS fs, f.err AS fe, r.seq AS rs, r.err AS re, d.seq AS ds FROM fams LEFT JOIN (SELECT * FROM ssc WHERE strand = 'Forward') f USING (sample_id, umi_a, umi_b)
  LEFT JOIN (SELECT * FROM ssc WHERE strand = 'Reverse') r USING (sample_id, umi_a, umi_b) LEFT JOIN d USING (sample_id, umi_a, umi_b))"""


@query(f"""WITH {I.SQL_READS}, {_MOLS} SELECT umi_a AS umi_fwd, umi_b AS umi_rev, CAST(ds IS NOT NULL AS VARCHAR) AS has_duplex, CAST(CASE WHEN fs IS NULL THEN 0 ELSE fwd_reads END AS VARCHAR) AS fwd_n_reads, CAST(CASE WHEN rs IS NULL THEN 0 ELSE rev_reads END AS VARCHAR) AS rev_n_reads,
  CAST(CASE WHEN ds IS NULL THEN 0 ELSE fwd_reads + rev_reads END AS VARCHAR) AS duplex_n_reads, coalesce(fs, '.') AS fwd_seq, coalesce(rs, '.') AS rev_seq, coalesce(ds, '.') AS duplex_seq, round(list_avg(fe), 6) AS fwd_mean_error, round(list_avg(re), 6) AS rev_mean_error FROM mols""")
def molecule_columns(spark, sf):
    out = reads.molecule_dump(_molecules(spark, sf)).drop("molecule_id", "duplex_mean_error")
    return out.withColumns({c: F.col(c).try_cast("double") for c in ("fwd_mean_error", "rev_mean_error")})


@query(f"""WITH {I.SQL_READS}, {_MOLS}, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS of_sample FROM mols), sk AS (SELECT sample_id, umi_a, umi_b, arg_min('TT', read_ord) AS skip FROM good GROUP BY ALL)
  SELECT 'RX:Z:' || umi_a || '-' || umi_b AS rx, 'FS:i:' || (fwd_reads + rev_reads) || ',DS:i:' || CASE WHEN fwd_reads > 0 AND rev_reads > 0 THEN fwd_reads + rev_reads ELSE 0 END || ',SF:i:' || fwd_reads || ',SR:i:' || rev_reads AS counts,
    'FT:Z:' || CASE WHEN fwd_reads > 0 AND rev_reads > 0 THEN 'DUPLEX' WHEN fwd_reads + rev_reads = 1 THEN 'SINGLETON' WHEN fwd_reads > 0 THEN 'SIMPLEX_FWD' ELSE 'SIMPLEX_REV' END AS ft,
    'CP:f:' || printf('%.6f', 1 - pow(1 - 1 / 524800.0, of_sample - 1)) AS cp, 'SK:Z:' || skip AS sk, coalesce(ds, fs, rs) AS seq, length(coalesce(ds, fs, rs)) AS n_quality FROM m JOIN sk USING (sample_id, umi_a, umi_b)""")
def annotated_reads(spark, sf):
    t = writers.annotated_fastq(_molecules(spark, sf)).select(F.split("value", "\n").alias("l"))
    h = F.split(F.col("l")[0], "\t")
    return t.select(h[2].alias("rx"), F.concat_ws(",", *(h[i] for i in (3, 4, 5, 6))).alias("counts"), h[7].alias("ft"), h[9].alias("cp"), h[10].alias("sk"), F.col("l")[1].alias("seq"), F.length(F.col("l")[3]).cast("bigint").alias("n_quality"))


# --- logs and records


@query(f"""WITH {I.SQL_READS}, {I.SQL_CALLS}, {_BIAS}, {_FILTER} SELECT 'families' AS log, count(*) AS n FROM fams UNION ALL SELECT 'reads_dropped', count(*) FROM parsed WHERE drop_reason IS NOT NULL UNION ALL SELECT 'variants_filtered', count(*) FROM lab WHERE filter <> 'Pass'""")
def log_summary(spark, sf):
    return logs.summary(reads_dropped=logs.reads_dropped(parsed(spark, sf)), families=logs.family_log(_families(spark, sf)), variants_filtered=logs.variants_filtered(_labelled_calls(spark, sf)))


def _labelled_calls(spark, sf):
    return labelled(spark, sf).withColumnsRenamed({"conf": "confidence", "bias": "strand_bias_p", "n_alt": "n_molecules_alt", "n_duplex": "n_duplex_alt"})


@query(f"WITH {I.SQL_READS}, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS m FROM fams) SELECT sample_id, umi_a AS seed_a, umi_b AS seed_b, fwd_reads + rev_reads AS size, fwd_reads, rev_reads, round(1 - pow(1 - 1 / 524800.0, m - 1), 9) AS collision_probability FROM m")
def log_families(spark, sf):
    return rounded(logs.family_log(_families(spark, sf)), "collision_probability", places=9).select("sample_id", "seed_a", "seed_b", "size", "fwd_reads", "rev_reads", "collision_probability")


@query(f"WITH {I.SQL_READS} SELECT sample_id, read_ord, drop_reason FROM parsed WHERE drop_reason IS NOT NULL")
def log_reads_dropped(spark, sf):
    return logs.reads_dropped(parsed(spark, sf))


@query(f"""WITH {I.SQL_READS}, {_SSC} SELECT sample_id, strand, umi_a, umi_b, i - 1 AS pos, substr(seq, CAST(i AS INT), 1) AS base, round(err[i], 6) AS err FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM ssc) WHERE err[i] > 0.02""")
def log_consensus_conflicts(spark, sf):
    m = _molecules(spark, sf)
    found = logs.consensus_conflicts(m, 0.02).join(m.select("molecule_id", F.col("seed_a").alias("umi_a"), F.col("seed_b").alias("umi_b")), "molecule_id")
    return found.select("sample_id", "strand", "umi_a", "umi_b", F.col("pos").cast("bigint").alias("pos"), "base", F.round("err", 6).alias("err"))


@query(f"""WITH {I.SQL_DOCUMENTS} SELECT molecule_id, length(seq) AS length FROM docs WHERE length(seq) < 31""")
def log_kmers_skipped(spark, sf):
    d = I.documents(spark, sf).withColumn("sample_id", F.lit("s"))
    return logs.kmers_skipped(d).select("molecule_id", F.col("length").cast("bigint").alias("length"))


@query(f"WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER} SELECT call_id, filter, CASE filter WHEN 'StrandBias' THEN 'strand_bias_threshold' WHEN 'HighVaf' THEN 'max_vaf' ELSE CASE WHEN n_alt < CASE WHEN sv THEN 1 ELSE 2 END THEN 'min_alt_molecules' ELSE 'min_confidence' END END AS option, sv FROM lab WHERE filter <> 'Pass'")
def log_variants_filtered(spark, sf):
    found = logs.variants_filtered(_labelled_calls(spark, sf), alleles.CallConfig(max_vaf=0.05))
    option = F.regexp_extract("reason", "see (\\S+)$", 1)
    return found.select("call_id", "filter", F.regexp_replace(option, "^sv_", "").alias("option"), F.col("variant_type").isin(*alleles.STRUCTURAL).alias("sv"))


@query(f"""WITH {I.SQL_READS}, m AS (SELECT sample_id, count(*) AS m, count(*) FILTER (fwd_reads > 0 AND rev_reads > 0) AS d FROM fams GROUP BY sample_id), p AS (SELECT sample_id, count(*) AS n, count(*) FILTER (drop_reason IS NULL) AS ok FROM parsed GROUP BY sample_id)
  SELECT sample_id, 'molecule_assembly' AS stage, n AS n_input_read_pairs, m AS n_molecules, d AS n_duplex, round(d / m, 6) AS duplex_fraction, round(ok / m, 6) AS mean_family_size, n - ok AS n_dropped_reads, true AS passed FROM m JOIN p USING (sample_id)""")
def qc_assembly(spark, sf):
    fams = _families(spark, sf)
    record = writers.qc_record(reads.assembly_stats(parsed(spark, sf), fams, reads.large_enough(fams)), "assembly")
    return rounded(record, "duplex_fraction", "mean_family_size").select("sample_id", "stage", "n_input_read_pairs", "n_molecules", "n_duplex", "duplex_fraction", "mean_family_size", "n_dropped_reads", "passed")


@query(f"WITH {I.SQL_CALLS}, {_BIAS}, {_FILTER} SELECT 'variant_calling' AS stage, '0.1.0' AS version, count(*) AS n_variants_called, count(*) FILTER (filter = 'Pass') AS n_pass, count(*) FILTER (filter <> 'Pass') AS n_filtered, true AS passed FROM lab")
def qc_calls(spark, sf):
    return writers.qc_record(calls.call_stats(labelled(spark, sf)), "call")


@query(f"""WITH {I.SQL_DOCUMENTS}, {I.SQL_PANEL}, {_ENDS}, w AS (SELECT ends.target_id, s IS NULL AS none, s IS NOT NULL AND NOT (coalesce(i.n, 0) < 5 AND coalesce(j.n, 0) < 5) AS often FROM ends LEFT JOIN seen i ON i.kmer = s LEFT JOIN seen j ON j.kmer = e),
  p AS (SELECT target_id, CAST(substr(target_id, 2) AS BIGINT) AS n FROM w)
  SELECT 'graph_walking' AS stage, count(*) AS n_targets_queried, count(*) FILTER (n % 3 = 0) AS n_targets_with_variants, count(*) FILTER (often) AS n_anchors_non_unique, count(*) FILTER (n % 3 < 2 AND n % 5 = 0) AS n_targets_walk_budget_exceeded, true AS passed FROM w JOIN p USING (target_id)""")
def qc_pathfind(spark, sf):
    p = I.panel(spark, sf)
    anchors = kmers.validate_anchors(p, listed_index(spark, sf, p), threshold=5)
    n = F.substring("target_id", 2, 20).cast("bigint")
    paths = p.where(n % 3 < 2).select("target_id", F.explode(F.when(n % 3 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("is_reference"), (n % 5 == 0).alias("budget_hit"))
    return writers.qc_record(graph.pathfind_stats(anchors, paths), "pathfind").drop("version")


@query(f"""WITH {I.SQL_READS}, m AS (SELECT sample_id, count(*) AS library_molecules FROM fams GROUP BY sample_id) SELECT o_orderkey AS id, 's' || (o_orderkey % 3) AS sample_id, library_molecules FROM orders LEFT JOIN m ON m.sample_id = 's' || (o_orderkey % 3)""")
def library_depth(spark, sf):
    j = I.table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("sample_id"))
    return calls.library_depth(j, _families(spark, sf)).select("id", "sample_id", "library_molecules")


@query(f"""WITH {I.SQL_PANEL} SELECT target_id, CASE WHEN CAST(substr(target_id, 2) AS BIGINT) % 3 = 0 THEN 'Pass' ELSE 'NotTargeted' END AS filter FROM panel WHERE length(seq) >= 31""")
def ti_sequence_listed(spark, sf):
    """Calls that only their whole sequence can match: no region, so no allele."""
    p = I.panel(spark, sf).where("length(seq) >= 31")
    alt = F.concat(F.substring("seq", 1, 9), F.translate(F.substring("seq", 10, 1), "ACGT", "CGTA"), F.substring("seq", 11, 1 << 30))
    found = p.select("target_id", F.col("seq").alias("ref_seq"), alt.alias("alt_seq"), F.lit("Pass").alias("filter"))
    listed = found.where(F.substring("target_id", 2, 20).cast("bigint") % 3 == 0).select("target_id", F.lower("alt_seq").alias("alt_seq"))
    none = I.truth_rows(spark, sf).where("chrom = 'none'")
    return calls.targeted(found, none, alternatives=listed).select("target_id", "filter")
