"""How the driver's tables stand in for reads, targets, variants and calls, in Spark and in SQL.

Sequences are the letters A, C, G and T of a text; reads are drawn from events
by digests, which both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.shared import written

K = 31


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` over all cores and at most some ``rows`` a task: a table of one small file is one task's scan, and what follows here multiplies rows.

    Tables of enough splits stay as they are. A condition that is not
    deterministic keeps Spark from moving later, costly ones before the shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df if 2 * df.rdd.getNumPartitions() >= tasks else df.repartition(tasks).where(F.spark_partition_id() >= 0)


def worked_out(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once a row: Spark else copies what makes them into each condition that follows.

    No condition moves below a column that is not deterministic.
    """
    return df.withColumn("__at", F.spark_partition_id()).where("__at >= 0").drop("__at")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def family(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Duplex", "SimplexFwd", "SimplexRev", "Singleton"))), (n % 4 + 1).cast("int"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(molecule_id, seq, family_type) of documents."""
    d = spread(table(spark, sf, "documents", "doc_id", "text"), 2000)
    return d.select(F.col("doc_id").alias("molecule_id"), letters(F.col("text")).alias("seq"), family(F.col("doc_id")).alias("family_type"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(target_id, seq) of benchmark passages."""
    b = table(spark, sf, "benchmark", "item_id", "text")
    return b.select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("target_id"), letters(F.col("text")).alias("seq"))


SQL_DOCUMENTS = """docs AS (
  SELECT doc_id AS molecule_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq,
         ['Duplex', 'SimplexFwd', 'SimplexRev', 'Singleton'][doc_id % 4 + 1] AS family_type FROM documents),
doc_raw AS (SELECT molecule_id, family_type, pos, substr(seq, pos + 1, 31) AS raw
  FROM (SELECT *, unnest(range(0, greatest(length(seq) - 30, 0))) AS pos FROM docs)),
doc_kmers AS (SELECT molecule_id, family_type, pos, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM doc_raw)"""
SQL_PANEL = """panel AS (SELECT 't' || item_id AS target_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark),
panel_raw AS (SELECT target_id, pos, substr(seq, pos + 1, 31) AS raw
  FROM (SELECT *, unnest(range(0, greatest(length(seq) - 30, 0))) AS pos FROM panel)),
panel_kmers AS (SELECT target_id, pos, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM panel_raw)"""
SQL_INDEX = """idx AS (SELECT kmer, count(*) AS n_molecules, count(*) FILTER (family_type = 'Duplex') AS n_duplex,
  count(*) FILTER (family_type IN ('SimplexFwd', 'Singleton')) AS n_simplex_fwd, count(*) FILTER (family_type = 'SimplexRev') AS n_simplex_rev
  FROM doc_kmers GROUP BY kmer)"""


def dna(value: Column) -> Column:
    return F.translate(F.md5(value.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Read pairs: a user is a molecule, an event one of its reads; some have a changed base, a low quality or too few bases."""
    e = spread(table(spark, sf, "events", "event_id", "user_id"))
    user = F.col("user_id").cast("string")
    e = e.withColumns({"umi": dna(F.concat(user, F.lit("u"))), "whole": F.concat(*(dna(F.concat(user, F.lit(x))) for x in "abcd"))})
    umi, template = F.col("umi"), F.col("whole")
    at = (F.col("event_id") % 128).cast("int")
    changed = F.concat(F.substring(template, F.lit(1), at), F.translate(F.substring(template, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(template, at + 2, F.lit(128)))
    template = F.when(F.col("event_id") % 97 == 0, changed).otherwise(template)
    odd = F.col("event_id") % 2 == 1
    one, two = F.substring(umi, 1, 5), F.substring(umi, 6, 5)
    e = e.withColumns({"t": template, "u1": F.when(odd, two).otherwise(one), "u2": F.when(odd, one).otherwise(two)})
    r1, r2 = F.concat("u1", F.lit("TT"), "t"), F.concat("u2", F.lit("TT"), S.reverse_complement(F.col("t")))
    r1 = F.when(F.col("event_id") % 53 == 0, F.substring(r1, 1, 4)).otherwise(r1)
    quality = F.char(F.lit(38) + F.col("event_id") % 36)
    e = e.select(F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("sample_id"), F.col("event_id").alias("read_ord"), r1.alias("r1_seq"), r2.alias("r2_seq"), quality.alias("q"))
    return worked_out(e.select("sample_id", "read_ord", "r1_seq", F.repeat("q", F.length("r1_seq")).alias("r1_qual"), "r2_seq", F.repeat("q", F.length("r2_seq")).alias("r2_qual")))


def mutated_reads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Read pairs and targets for a whole run: users are molecules of ten targets, every third of them with a base changed."""
    e = spread(table(spark, sf, "events", "event_id", "user_id"))
    target = lambda g: F.concat(*(dna(F.concat(F.lit("g"), g.cast("string"), F.lit(x))) for x in "abcd"))
    template = target(F.col("user_id") % 10)
    changed = F.concat(F.substring(template, 1, 60), F.translate(F.substring(template, 61, 1), "ACGT", "CGTA"), F.substring(template, 62, 128))
    umi, odd = dna(F.concat(F.col("user_id").cast("string"), F.lit("u"))), F.col("event_id") % 2 == 1
    e = e.select("event_id", F.when(F.col("user_id") % 3 == 0, changed).otherwise(template).alias("t"), F.when(odd, F.substring(umi, 6, 5)).otherwise(F.substring(umi, 1, 5)).alias("u1"), F.when(odd, F.substring(umi, 1, 5)).otherwise(F.substring(umi, 6, 5)).alias("u2"), odd.alias("odd"))
    turned = S.reverse_complement(F.col("t"))
    one, two = F.concat("u1", F.lit("TT"), F.when(F.col("odd"), turned).otherwise(F.col("t"))), F.concat("u2", F.lit("TT"), F.when(F.col("odd"), F.col("t")).otherwise(turned))
    e = e.select(F.lit("s").alias("sample_id"), F.col("event_id").alias("read_ord"), one.alias("r1_seq"), two.alias("r2_seq"))
    reads = e.select("sample_id", "read_ord", "r1_seq", F.repeat(F.lit("I"), F.length("r1_seq")).alias("r1_qual"), "r2_seq", F.repeat(F.lit("I"), F.length("r2_seq")).alias("r2_qual"))
    g = spark.range(10).select(F.concat(F.lit("chr1:"), (F.col("id") * 1000).cast("string"), F.lit("-"), (F.col("id") * 1000 + 127).cast("string")).alias("target_id"), target(F.col("id")).alias("seq"), F.lit("chr1").alias("chrom"), (F.col("id") * 1000).alias("start"))
    return reads, g


_T = "translate(md5(CAST(user_id AS VARCHAR) || '{}'), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SQL_READS = f"""ev AS (SELECT event_id, user_id, {_T.format("u")} AS umi, {" || ".join(_T.format(x) for x in "abcd")} AS t0, event_id % 128 AS mpos FROM events),
ev2 AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN substr(t0, 1, mpos) || translate(substr(t0, mpos + 1, 1), 'ACGT', 'CGTA') || substr(t0, mpos + 2) ELSE t0 END AS t,
  CASE WHEN event_id % 2 = 1 THEN substr(umi, 6, 5) ELSE substr(umi, 1, 5) END AS u1, CASE WHEN event_id % 2 = 1 THEN substr(umi, 1, 5) ELSE substr(umi, 6, 5) END AS u2 FROM ev),
reads AS (SELECT 's' || (user_id % 2) AS sample_id, event_id AS read_ord, 5 + event_id % 36 AS q,
  CASE WHEN event_id % 53 = 0 THEN substr(u1 || 'TT' || t, 1, 4) ELSE u1 || 'TT' || t END AS r1_seq, u2 || 'TT' || reverse(translate(t, 'ACGT', 'TGCA')) AS r2_seq FROM ev2),
parsed AS (SELECT sample_id, read_ord, q, substr(r1_seq, 1, 5) AS umi_r1, substr(r2_seq, 1, 5) AS umi_r2, substr(r1_seq, 8) AS template_r1, substr(r2_seq, 8) AS template_r2,
  least(substr(r1_seq, 1, 5), substr(r2_seq, 1, 5)) AS umi_a, greatest(substr(r1_seq, 1, 5), substr(r2_seq, 1, 5)) AS umi_b,
  CASE WHEN substr(r1_seq, 1, 5) <= substr(r2_seq, 1, 5) THEN 'Forward' ELSE 'Reverse' END AS strand,
  CASE WHEN least(length(r1_seq), length(r2_seq)) < 7 THEN 'ReadTooShort' WHEN q < 20 THEN 'LowUmiQuality' END AS drop_reason FROM reads),
good AS (SELECT * FROM parsed WHERE drop_reason IS NULL),
fams AS (SELECT sample_id, umi_a, umi_b, count(*) FILTER (strand = 'Forward') AS fwd_reads, count(*) FILTER (strand = 'Reverse') AS rev_reads FROM good GROUP BY ALL)"""


def tables2x2(spark: SparkSession, sf: str) -> DataFrame:
    """(supplier, a, b, c, d): line items by return flag and status."""
    li = table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    of = lambda cond: F.count_if(F.expr(cond))
    return li.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        of("l_returnflag = 'A' and l_linenumber = 1").alias("a"), of("l_returnflag = 'R' and l_linenumber = 2").alias("b"),
        of("l_returnflag = 'N' and l_linenumber = 3").alias("c"), of("l_returnflag <> 'N' and l_linenumber = 4").alias("d"),
    )


SQL_2X2 = """t AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_returnflag = 'A' AND l_linenumber = 1) AS a, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 2) AS b,
  count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 3) AS c, count(*) FILTER (l_returnflag <> 'N' AND l_linenumber = 4) AS d FROM lineitem GROUP BY l_suppkey)"""


def call_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls drawn from orders: counts, shares and a class."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*map(F.lit, ("SNV", "Insertion", "Deletion", "LargeDeletion", "Fusion")))
    rows = o.select(
        F.concat(F.lit("chr"), (c % 5).cast("string"), F.lit(":"), (k % 9000).cast("string"), F.lit("-"), (k % 9000 + 100).cast("string")).alias("target_id"), k.alias("call_id"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("variant_type"), (k % 13).alias("n_alt"), (c % 900 + 100).alias("n_ref"), F.least(c % 4, k % 13).alias("n_duplex"),
        (k % 7).alias("fwd"), (c % 7).alias("rev"), F.concat(F.lit("chr"), (c % 5).cast("string")).alias("chrom"), (k % 9000).alias("pos"),
        F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(F.lit("CGTAG"), (k % 5 + 1).cast("int"), F.lit(1)).alias("alt"),
    )
    return rows.withColumn("vaf", F.col("n_alt") / (F.col("n_alt") + F.col("n_ref")))


SQL_CALLS = """c0 AS (SELECT 'chr' || (o_custkey % 5) || ':' || (o_orderkey % 9000) || '-' || (o_orderkey % 9000 + 100) AS target_id, o_orderkey AS call_id,
  ['SNV', 'Insertion', 'Deletion', 'LargeDeletion', 'Fusion'][o_orderkey % 5 + 1] AS variant_type, o_orderkey % 13 AS n_alt, o_custkey % 900 + 100 AS n_ref,
  least(o_custkey % 4, o_orderkey % 13) AS n_duplex, o_orderkey % 7 AS fwd, o_custkey % 7 AS rev, 'chr' || (o_custkey % 5) AS chrom, o_orderkey % 9000 AS pos,
  substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS ref, substr('CGTAG', CAST(o_orderkey % 5 + 1 AS INT), 1) AS alt FROM orders),
calls AS (SELECT *, n_alt / (n_alt + n_ref) AS vaf FROM c0)"""


def truth_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Variants known to be there, drawn from line items: places by part, chromosomes by supplier."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_quantity")
    p = F.col("l_partkey")
    return li.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), (p * 7 % 9000).alias("pos"), F.substring(F.lit("ACGT"), (p * 7 % 4 + 1).cast("int"), F.lit(1)).alias("ref"),
        F.substring(F.lit("CGTAG"), (p * 7 % 5 + 1).cast("int"), F.lit(1)).alias("alt"), (F.col("l_quantity").cast("int") % 4).alias("vaf_class"),
    ).distinct()


SQL_TRUTH = """truth AS (SELECT DISTINCT 'chr' || (l_suppkey % 5) AS chrom, l_partkey * 7 % 9000 AS pos, substr('ACGT', CAST(l_partkey * 7 % 4 + 1 AS INT), 1) AS ref,
  substr('CGTAG', CAST(l_partkey * 7 % 5 + 1 AS INT), 1) AS alt, CAST(l_quantity AS INT) % 4 AS vaf_class FROM lineitem)"""


def user_molecules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Molecules (sample_id, target_id, molecule_id, seq), one per event, and targets (target_id, seq), one per user.

    Every 23rd molecule differs from its target by a base, of these every other one by a base that is missing.
    """
    e, user = table(spark, sf, "events", "event_id", "user_id"), F.col("user_id").cast("string")
    # A user's digests are worked out once and meet the events, which are many.
    users = written(e.select("user_id").distinct().select("user_id", F.concat(F.lit("u"), user).alias("target_id"), F.concat(*(dna(F.concat(user, F.lit(x))) for x in "abcd")).alias("t")))
    t, at = F.col("t"), ((F.col("event_id") * 29 + F.col("user_id")) % 128).cast("int")
    base = F.when(F.col("event_id") % 46 == 0, F.lit("")).otherwise(F.translate(F.substring(t, at + 1, F.lit(1)), "ACGT", "CGTA"))
    changed = F.concat(F.substring(t, F.lit(1), at), base, F.substring(t, at + 2, F.lit(128)))
    e = e.join(users.hint("merge"), "user_id").select("target_id", F.col("event_id").alias("molecule_id"), F.when(F.col("event_id") % 23 == 0, changed).otherwise(t).alias("seq"))
    return e.select(F.lit("s").alias("sample_id"), "target_id", "molecule_id", "seq"), users.select("target_id", F.col("t").alias("seq"))


SQL_USER_MOLECULES = f"""um0 AS (SELECT event_id, 'u' || user_id AS target_id, {" || ".join(_T.format(x) for x in "abcd")} AS t, (event_id * 29 + user_id) % 128 AS p FROM events),
um AS (SELECT target_id, event_id, t, CASE WHEN event_id % 23 = 0 THEN substr(t, 1, p) || CASE WHEN event_id % 46 = 0 THEN '' ELSE translate(substr(t, p + 1, 1), 'ACGT', 'CGTA') END || substr(t, p + 2) ELSE t END AS seq FROM um0),
targets AS MATERIALIZED (SELECT DISTINCT target_id, t AS seq FROM um),
nodes AS MATERIALIZED (SELECT target_id, raw, substr(raw, 1, 30) AS front, count(*) AS n FROM (SELECT target_id, substr(seq, i, 31) AS raw FROM (SELECT *, unnest(range(1, greatest(length(seq) - 29, 1))) AS i FROM um)) GROUP BY ALL)"""


def long_umis(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, umi_a, umi_b, n, first_ord): UMI pairs of twice 12 bases, one per user; every fifth event has a base changed, every 15th two."""
    e = spread(table(spark, sf, "events", "event_id", "user_id"))
    change = lambda s, at: F.concat(F.substring(s, F.lit(1), at), F.translate(F.substring(s, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(s, at + 2, F.lit(24)))
    p = (F.col("event_id") % 24).cast("int")
    u = F.substring(dna(F.concat(F.col("user_id").cast("string"), F.lit("u"))), 1, 24)
    e = e.select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("sample_id"), F.when(F.col("event_id") % 5 == 0, change(u, p)).otherwise(u).alias("u"), p.alias("p"))
    e = e.withColumn("u", F.when(F.col("event_id") % 15 == 0, change(F.col("u"), (F.col("p") + 7) % 24)).otherwise(F.col("u")))
    return e.groupBy("sample_id", F.substring("u", 1, 12).alias("umi_a"), F.substring("u", 13, 12).alias("umi_b")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_ord"))


def _changed(s: str, at: str) -> str:
    return f"substr({s}, 1, {at}) || translate(substr({s}, {at} + 1, 1), 'ACGT', 'CGTA') || substr({s}, {at} + 2)"


SQL_LONG_UMIS = f"""lu AS (SELECT event_id, 's' || (user_id % 2) AS sample_id, event_id % 24 AS p, substr({_T.format("u")}, 1, 24) AS u FROM events),
lu1 AS (SELECT event_id, sample_id, p, CASE WHEN event_id % 5 = 0 THEN {_changed("u", "p")} ELSE u END AS u FROM lu),
lu2 AS (SELECT event_id, sample_id, CASE WHEN event_id % 15 = 0 THEN {_changed("u", "(p + 7) % 24")} ELSE u END AS u FROM lu1),
long_umis AS MATERIALIZED (SELECT sample_id, substr(u, 1, 12) AS umi_a, substr(u, 13, 12) AS umi_b, count(*) AS n, min(event_id) AS first_ord FROM lu2 GROUP BY ALL)"""
