"""K-mer evidence: the index of molecules per k-mer, its filters and its quality figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.codes import dealt_codes, met_codes, spelled_codes

#: K-mers that meet at once at most, about: 64 MB of codes.
A_PART = 8_000_000


def allowlist(*sequences: DataFrame, k: int = 31, seq: str = "seq", coded: bool = False, letters: int | None = None) -> DataFrame:
    """Distinct canonical k-mers of several sequence tables: targets, junctions, fusions, alternatives; ``coded`` leaves them numbers.

    They meet in blocks of codes instead of row by row, in as many parts as
    keep each at ``A_PART`` k-mers at most, however large the tables are.
    ``letters`` is how many they have or a larger number; without it they are counted.
    """
    if not 0 < k <= S.MAX_K:
        raise ValueError(f"k must be 1 to {S.MAX_K}")
    if letters is None:
        letters = sum(s.agg(F.sum(F.length(seq))).first()[0] or 0 for s in sequences)
    parts = max(1, -(-letters // A_PART))
    blocks = reduce(DataFrame.unionByName, [dealt_codes(s, seq, k, parts) for s in sequences])
    if parts > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        blocks = blocks.repartition(parts, "part")
    return met_codes(blocks, None if coded else k)


def is_coded(kmers: DataFrame) -> bool:
    """Whether k-mers are codes instead of letters."""
    return kmers.schema["kmer"].dataType.typeName() == "long"


def on_list(kmers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only k-mers of the list; reads are unaffected. Spark sends the list to every task if it is small enough."""
    return kmers.join(allowed.select("kmer"), "kmer", "left_semi")


def on_target(kmers: DataFrame, allowed: DataFrame, molecule: str = "molecule_id") -> DataFrame:
    """All k-mers of the molecules that have any k-mer of the list, so that new variants' k-mers stay."""
    keys = ["sample_id", molecule] if "sample_id" in kmers.columns else [molecule]
    hits = on_list(kmers, allowed).select(*keys).distinct()
    return kmers.join(hits.hint("merge"), keys, "left_semi")


def family_counts() -> list[Column]:
    """Molecules, and those by family type; singletons count as simplex forward."""
    of = lambda *t: F.count_if(F.col("family_type").isin(*t))
    return [F.count("*").alias("n_molecules"), of("Duplex").alias("n_duplex"), of("SimplexFwd", "Singleton").alias("n_simplex_fwd"), of("SimplexRev").alias("n_simplex_rev")]


def evidence(kmers: DataFrame, keys: list[str] | None = None, distinct: bool = False, k: int | None = None) -> DataFrame:
    """The index: counts by family type and errors per k-mer.

    ``kmers`` has kmer, family_type and optionally err (a window's mean error)
    per occurrence; each occurrence counts, or with ``distinct`` each molecule
    once. Singletons count as simplex forward. The sum of errors is kept
    besides the mean, so that indexes merge. With ``k``, their length, k-mers of
    A, C, G and T meet as numbers of 8 bytes; those of ``S.explode_codes`` are.
    """
    keys = [*(keys if keys is not None else ["sample_id"]), "kmer"]
    if k is not None and not is_coded(kmers):
        kmers = kmers.withColumn("kmer", S.packed(F.col("kmer")))
    if distinct:
        best = [F.min("err").alias("err")] if "err" in kmers.columns else []
        kmers = kmers.groupBy(*keys, "molecule_id").agg(F.first("family_type").alias("family_type"), *best)
    aggs = family_counts()
    if "err" in kmers.columns:
        aggs += [F.min("err").alias("min_err"), F.sum("err").alias("sum_err")]
    out = kmers.groupBy(*keys).agg(*aggs)
    if k is not None:
        out = out.withColumn("kmer", spelled_codes(F.col("kmer"), k))
    return out.withColumn("mean_err", F.col("sum_err") / F.col("n_molecules")) if "err" in kmers.columns else out


def spelled(index: DataFrame, k: int) -> DataFrame:
    """An index with its k-mers' letters for their codes."""
    return index.withColumn("kmer", spelled_codes(F.col("kmer"), k))


def index_of(sequences: DataFrame, k: int = 31, keys: list[str] | None = None, distinct: bool = False, coded: bool = False) -> DataFrame:
    """The index of sequences (molecule_id, family_type, seq and optionally err, an array per base), by codes from the first row to the last.

    With ``distinct`` and no errors a molecule's sequences meet before they are
    cut, N between them, so that only they and not their k-mers are shuffled to
    be counted once. ``coded`` leaves k-mers numbers.
    """
    spell = None if coded else k
    if "err" in sequences.columns:
        return evidence(S.explode_codes(sequences, "seq", k, "err"), keys, distinct, spell)
    if distinct:
        by = [*(keys if keys is not None else ["sample_id"]), "molecule_id"]
        sequences = sequences.groupBy(*by).agg(F.first("family_type").alias("family_type"), F.concat_ws("N", F.collect_list("seq")).alias("seq"))
    return evidence(S.explode_codes(sequences, "seq", k, distinct=distinct), keys, k=spell)


def merge(*indexes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One index of several: counts and error sums add up, minima meet."""
    keys = [*(keys if keys is not None else ["sample_id"]), "kmer"]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), indexes)
    sums = [F.sum(c).alias(c) for c in ("n_molecules", "n_duplex", "n_simplex_fwd", "n_simplex_rev")]
    if "sum_err" not in out.columns:
        return out.groupBy(*keys).agg(*sums)
    out = out.groupBy(*keys).agg(*sums, F.min("min_err").alias("min_err"), F.sum("sum_err").alias("sum_err"))
    return out.withColumn("mean_err", F.col("sum_err") / F.col("n_molecules"))


def read_kmers(reads: DataFrame, k: int = 31) -> DataFrame:
    """Occurrences of canonical (``kmer``) and raw (``raw``) k-mers of consensus reads with their window's mean error."""
    rows = S.explode_kmers(reads, "seq", k, raw="raw")
    if "err" not in reads.columns:
        return rows
    return rows.withColumn("err", S.window_error(F.col("err"), F.col("pos"), k))


def frequent(index: DataFrame, least: int = 2) -> DataFrame:
    return index.where(F.col("n_molecules") >= least)


def frequency_threshold(n: Column) -> Column:
    """Smallest count worth keeping, by the number of molecules: 1 to 3."""
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.floor(F.sqrt(n)) / 1000))).cast("int")


def index_stats(index: DataFrame, allowed: DataFrame) -> DataFrame:
    """Listed k-mers, those of them observed, and their mean depth."""
    seen = index.join(allowed.select("kmer"), "kmer", "left_semi").agg(F.count("*").alias("n_observed"), F.avg("n_molecules").alias("mean_depth"))
    return allowed.agg(F.count("*").alias("n_target_kmers")).crossJoin(seen)  # one row each


def lookup(kmers: DataFrame, index: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Evidence for each k-mer; what isn't in the index counts as 0.

    Spark takes the size of what an index comes from for its own, which may be a
    hundredth of it; so it is not sent whole.
    """
    keys = [*(keys if keys is not None else ["sample_id"]), "kmer"]
    out = kmers.join(index.hint("merge"), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_molecules", "n_duplex", "n_simplex_fwd", "n_simplex_rev") if c in index.columns})


def junction_reads(reads: DataFrame, junctions: DataFrame, k: int = 31) -> DataFrame:
    """Reads that contain each canonical junction k-mer."""
    wanted = S.explode_kmers(junctions.select("target_id", "seq"), "seq", k).select("target_id", "kmer").distinct()
    found = S.explode_kmers(reads.select("read_id", "seq"), "seq", k).select("read_id", "kmer").distinct()
    n = found.join(wanted.select("kmer").distinct(), "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("n_reads"))
    return wanted.join(n, "kmer", "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))


def validate_anchors(targets: DataFrame, index: DataFrame, k: int = 31, threshold: int = 100) -> DataFrame:
    """First and last k-mer of each target with their counts, by sample if the index has ``sample_id``.

    Rarer than ``threshold`` is unique. Null for short targets and those with N there.
    """
    keys = ["sample_id"] if "sample_id" in index.columns else []
    ends = targets.withColumns({"start_kmer": F.upper(F.substring("seq", 1, k)), "end_kmer": F.upper(F.right("seq", F.lit(k)))})
    ok = (F.length("seq") >= k) & F.col("start_kmer").rlike("^[ACGT]+$") & F.col("end_kmer").rlike("^[ACGT]+$")
    out = ends.withColumns({c: F.when(ok, F.col(c)) for c in ("start_kmer", "end_kmer")})
    if keys:  # a row for each sample and target is what is asked for
        out = out.crossJoin(index.select(*keys).distinct())
    for end in ("start", "end"):
        n = index.select(*keys, F.col("kmer").alias(f"__{end}"), F.col("n_molecules").alias(f"{end}_count"))
        out = out.withColumn(f"__{end}", S.canonical(F.col(f"{end}_kmer"))).join(n, [*keys, f"__{end}"], "left").drop(f"__{end}")
        out = out.withColumn(f"{end}_count", F.when(F.col(f"{end}_kmer").isNotNull(), F.coalesce(f"{end}_count", F.lit(0))))
        out = out.withColumn(f"{end}_unique", F.col(f"{end}_count") < threshold)
    return out.withColumn("warning", F.when(~(F.col("start_unique") & F.col("end_unique")), F.lit("anchor occurs too often")))
