"""Columns over nucleotide strings, k-mers, UMI pairs and identifiers.

Two-bit codes follow the order of the letters, so comparing upper-case
strings of one length is comparing codes; strings stay in transit and become
``bigint`` only where a table keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import kmer_codes, kmer_codes_with_error


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Fixed value: longest k-mer whose code fits a signed 64-bit integer.
MAX_K = 31
CLEAN = "^[ACGT]*$"


def encode_base(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case; null for anything else."""
    return F.when(F.upper(base).rlike("^[ACGT]$"), F.translate(F.upper(base), "ACGT", "0123").cast("int"))


def decode_base(code: Column) -> Column:
    return F.when(code.between(0, 3), F.translate(code.cast("string"), "0123", "ACGT"))


def encode_kmer(kmer: Column) -> Column:
    """Code of a k-mer as bigint; null with a letter outside ACGT, when empty or longer than 31."""
    ok = F.upper(kmer).rlike("^[ACGT]+$") & (F.length(kmer) <= MAX_K)
    return F.when(ok, F.conv(F.translate(F.upper(kmer), "ACGT", "0123"), 4, 10).cast("bigint"))


def packed(kmer: Column) -> Column:
    """``encode_kmer`` of what is known to be upper-case A, C, G and T, at most 31 of them."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def decode_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(F.upper(kmer), reverse_complement(kmer))


def canonical_strand(kmer: Column) -> Column:
    """Which of the two the canonical form is; a palindrome counts as forward."""
    return F.when(F.upper(kmer) <= reverse_complement(kmer), "Forward").otherwise("Reverse")


def explode_kmers(df: DataFrame, seq: str, k: int, pos: str = "pos", canonical: str | None = "kmer", raw: str | None = None) -> DataFrame:
    """One row per k-mer of ``seq`` without letters outside ACGT: its 0-based position and its canonical and/or raw form.

    The reverse complement is taken once per sequence and both are cut as
    bytes, which costs the same at any position of a long sequence; all of it
    stays inside generated code. The other columns of ``df`` are kept.
    """
    if not 0 < k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    up = F.upper(seq)
    rows = df.withColumn("__f", up.cast("binary")).withColumn("__r", reverse_complement(up).cast("binary"))
    rows = rows.withColumn("__ok", up.rlike(CLEAN)).where(F.length(up) >= k)
    rows = rows.withColumn("__n", F.octet_length("__f")).withColumn("__p", F.explode(F.sequence(F.lit(1), F.octet_length("__f") - k + 1)))
    fwd = F.substring(F.col("__f"), F.col("__p"), F.lit(k))
    rev = F.substring(F.col("__r"), F.col("__n") - F.col("__p") - k + 2, F.lit(k))
    out = rows.where(F.col("__ok") | fwd.cast("string").rlike("^[ACGT]+$"))
    cols = [F.col(c) for c in df.columns] + [(F.col("__p") - 1).alias(pos)]
    if canonical:
        cols.append(F.least(fwd, rev).cast("string").alias(canonical))
    if raw:
        cols.append(fwd.cast("string").alias(raw))
    return out.select(*cols)


def explode_codes(df: DataFrame, seq: str, k: int, err: str | None = None, distinct: bool = False) -> DataFrame:
    """``explode_kmers`` with the canonical k-mer as its code (``kmer``, bigint), without places.

    ``err``, an array per base, becomes the window's mean; with ``distinct`` (and no ``err``) a row's k-mers are given once.
    """
    if not 0 < k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    rest = [c for c in df.columns if c not in (seq, err, "kmer")]
    if err is None:
        return df.select(*rest, F.explode(kmer_codes(F.col(seq), k, distinct)).alias("kmer")).where("kmer is not null")
    rows = df.select(*rest, F.explode(kmer_codes_with_error(F.col(seq), F.coalesce(F.col(err).cast("array<double>"), F.array().cast("array<double>")), k)).alias("__w"))
    return rows.where("__w is not null").select(*rest, "__w.kmer", F.col("__w.err").alias(err))


def infer_k(max_code: Column) -> Column:
    """Fallback only: half the significant bits of the largest code, rounded up. Too small if every k-mer starts with A."""
    return F.when(max_code > 0, F.ceil(F.length(F.bin(max_code)) / 2).cast("int")).otherwise(F.lit(1))


def reconstruct(kmers: Column) -> Column:
    """The sequence of consecutive k-mers: the first one and each next one's last letter."""
    tail = F.array_join(F.transform(F.slice(kmers, 2, F.greatest(F.size(kmers) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1))), "")
    return F.when(F.size(kmers) > 0, F.concat(F.element_at(kmers, 1), tail)).otherwise("")


# --- UMI pairs


def umi_pair(r1: Column, r2: Column) -> Column:
    """struct<umi_a, umi_b> in order, whichever read came first."""
    return F.struct(F.least(r1, r2).alias("umi_a"), F.greatest(r1, r2).alias("umi_b"))


def umi_strand(r1: Column, r2: Column) -> Column:
    """Forward if read 1 carries the smaller UMI; equal UMIs are forward."""
    return F.when(r1 <= r2, "Forward").otherwise("Reverse")


def hamming(a: Column, b: Column) -> Column:
    """Differing letters of two strings, as far as the shorter one goes."""
    pairs = F.zip_with(F.split(a, "(?!$)"), F.split(b, "(?!$)"), lambda x, y: F.when(x != y, 1).otherwise(0))
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.aggregate(F.slice(pairs, 1, F.greatest(n, F.lit(1))), F.lit(0), lambda acc, d: acc + d))


#: Characters of a text that one number holds.
WORD = 8


def text_words(text: Column, words: int) -> Column:
    """The bytes of the first ``words`` * 8 characters of an ASCII text as numbers; null for others and longer ones."""
    word = lambda i: F.coalesce(F.conv(F.hex(F.rpad(F.substring(text, WORD * i + 1, WORD), WORD, " ").cast("binary")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    plain = (F.octet_length(text) == F.length(text)) & (F.length(text) <= WORD * words)
    return F.when(plain, F.array(*map(word, range(words))))


def differing_bytes(a: Column, b: Column, words: int) -> Column:
    """Places at which two texts of one length differ, by their ``text_words``."""

    def one(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return F.bit_count(x.bitwiseAND(0x0101010101010101))

    out = one(0)
    for i in range(1, words):
        out = out + one(i)
    return out


def umi_distance(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return hamming(a1, a2) + hamming(b1, b2)


def family_type(forward: Column, reverse: Column) -> Column:
    return (
        F.when((forward > 0) & (reverse > 0), "Duplex").when(forward + reverse == 1, "Singleton").when(forward > 0, "SimplexFwd").when(reverse > 0, "SimplexRev")
    )


def stable_hash(*parts: Column) -> Column:
    """A 64-bit id that any session computes alike."""
    return F.xxhash64(*parts)


# --- endpoint fingerprints


def encode_endpoint(end: Column) -> Column:
    """Eight bases as 16 bits; missing bases and others than ACGT count as A."""
    digits = F.translate(F.regexp_replace(F.upper(F.substring(end, 1, 8)), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(F.rpad(digits, 8, "0"), 4, 10).cast("bigint")


def endpoint_fingerprint(r1: Column, r2: Column) -> Column:
    """First and last eight bases of both templates, 16 bits each, from high to low."""
    tail = lambda s: F.when(F.length(s) > 8, F.right(s, F.lit(8))).otherwise(s)
    parts = [encode_endpoint(r1), encode_endpoint(tail(r1)), encode_endpoint(r2), encode_endpoint(tail(r2))]
    out = F.lit(0).cast("bigint")
    for i, p in enumerate(parts):
        out = out.bitwiseOR(F.shiftleft(p, 48 - 16 * i))
    return out


def compatible(a: Column, b: Column, bits: int = 4) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def swapped(fp: Column) -> Column:
    """The fingerprint with its two reads exchanged."""
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def duplex_compatible(a: Column, b: Column, bits: int = 4) -> Column:
    return compatible(a, b, bits) | compatible(a, swapped(b), bits)


# --- identifiers


def target_region(target_id: Column, suffix: bool = False) -> Column:
    """struct<chrom, start, end> of ``chr:start-end``; null unless both are numbers.

    ``suffix`` allows text after the end, as in ``chr1:399-699_DUP_100bp``.
    """
    pattern = r"^([^:]*):([0-9]+)-([0-9]+)" + ("" if suffix else "$")
    part = lambda i: F.regexp_extract(target_id, pattern, i)
    return F.when(target_id.rlike(pattern), F.struct(part(1).alias("chrom"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end")))


def path_limit(target_id: Column) -> Column:
    """N of the last ``_maxpathN`` in an id, in any case; null without one."""
    return F.regexp_extract(F.lower(target_id), r".*_maxpath([0-9]+)", 1).try_cast("int")


def labelled_region(name: Column) -> Column:
    """struct<chrom, start, end> of names like ``chr1:49-250_SNV_1bp``."""
    return target_region(name, suffix=True)


def alt_header(header: Column) -> Column:
    """struct<target_id, ref, alt> of ``id REF=… ALT=…``; null if a token is missing."""
    token = lambda t: F.regexp_extract(header, rf"(?:^|\s){t}=(\S+)", 1)
    ok = (token("REF") != "") & (token("ALT") != "")
    return F.when(ok, F.struct(F.regexp_extract(header, r"^(\S+)", 1).alias("target_id"), F.upper(token("REF")).alias("ref"), F.upper(token("ALT")).alias("alt")))


def build_alt(window: Column, start: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The window with ref replaced by alt; null unless ref lies in it and agrees, in either case."""
    at = (pos - start).cast("int")
    ok = (at >= 0) & (at + F.length(ref) <= F.length(window)) & (F.upper(F.substring(window, at + 1, F.length(ref))) == F.upper(ref))
    return F.when(ok, F.concat(F.substring(window, F.lit(1), at), alt, F.substring(window, at + F.length(ref) + 1, F.length(window))))


def fusion_header(name: Column) -> Column:
    """struct of ``GENES__chrA:s-e__chrB:s-e__fusion``: the partners' regions and the breakpoint within the sequence."""
    parts = F.split(name, "__")
    a, b = target_region(F.get(parts, F.lit(1))), target_region(F.get(parts, F.lit(2)))
    fields = F.struct(
        F.get(parts, F.lit(0)).alias("name"), a["chrom"].alias("chrom_a"), a["start"].alias("start_a"), a["end"].alias("end_a"),
        b["chrom"].alias("chrom_b"), b["start"].alias("start_b"), b["end"].alias("end_b"), (a["end"] - a["start"]).alias("breakpoint"),
    )
    return F.when((F.get(parts, F.lit(3)) == "fusion") & a.isNotNull() & b.isNotNull(), fields)


def junction(left: Column, right: Column, kind: Column, flank: int) -> Column:
    """Junction sequence of ``flank`` bases from each side of a breakpoint.

    ``left`` ends at the first breakpoint, ``right`` begins at the second.
    DEL joins them; DUP joins the end of the copy to its beginning; INV turns
    the second side over.
    """
    tail, head = F.right(left, F.lit(flank)), F.substring(right, 1, flank)
    return F.when(kind == "DEL", F.concat(tail, head)).when(kind == "DUP", F.concat(F.right(right, F.lit(flank)), F.substring(left, 1, flank))).when(
        kind == "INV", F.concat(tail, reverse_complement(F.right(right, F.lit(flank))))
    )


def fusion_junction(a: Column, b: Column, orientation: Column, flank: int) -> Column:
    """Junction of two partners: the end of ``a`` and the beginning of ``b``, each turned over if its letter of FF, FR, RF or RR is R; else null."""
    side = lambda s, at: F.when(F.substring(orientation, at, 1) == "R", reverse_complement(s)).otherwise(F.upper(s))
    return F.when(orientation.isin("FF", "FR", "RF", "RR"), F.concat(F.right(side(a, 1), F.lit(flank)), F.substring(side(b, 2), 1, flank)))


def info_map(info: Column) -> Column:
    """VCF INFO as a map."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def vaf_tag(tag: Column) -> Column:
    """Fraction of a tag like ``vaf0050`` (hundredths of a percent)."""
    return F.regexp_extract(tag, "([0-9]+)", 1).try_cast("double") / 10_000


def vaf_label(label: Column) -> Column:
    """Fraction of a label like ``0.5%``, ``2pc`` or ``0p5``."""
    number = F.regexp_replace(F.regexp_extract(F.lower(label), r"([0-9]+(?:[.p][0-9]+)?)", 1), "p", ".")
    return number.try_cast("double") / 100


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def prob_to_phred(p: Column, cap: int = 60) -> Column:
    return F.when(p <= 0, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), -10 * F.log10(p)))


# --- windows over a sequence


def window_error(err: Column, pos: Column, k: int) -> Column:
    """Mean error over k bases from a 0-based position; bases without a value count as 0."""
    return F.coalesce(F.aggregate(F.slice(err, pos + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0)) / k


def longest_homopolymer(seq: Column) -> Column:
    runs = F.regexp_extract_all(F.upper(seq), F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def repeat_fraction(seq: Column, run: int = 3, units: int = 3) -> Column:
    """Share of bases in homopolymers of at least ``run`` bases or dinucleotide repeats of at least ``units`` units."""

    def starts(s: Column, unit: int, times: int) -> Column:
        """At each place, whether the unit there occurs so many times in a row."""
        size = unit * times
        places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.transform(places, lambda i: (F.length(F.substring(s, i, F.lit(size))) == size) & (F.substring(s, i, F.lit(size)) == F.repeat(F.substring(s, i, F.lit(unit)), F.lit(times))))

    def covered(x: Column) -> Column:
        near = lambda flags, i, size: F.exists(F.slice(flags, F.greatest(i - size + 1, F.lit(1)), F.least(i, F.lit(size))), lambda f: f)
        return F.size(F.filter(F.sequence(F.lit(1), F.size(x.one)), lambda i: near(x.one, i, run) | near(x.two, i, 2 * units)))

    flags = let(F.upper(seq), lambda s: F.struct(starts(s, 1, run).alias("one"), starts(s, 2, units).alias("two")))
    return F.when(F.length(seq) > 0, let(flags, covered) / F.length(seq)).otherwise(0.0)


def dust_score(seq: Column, centre: Column | None = None, window: int = 64) -> Column:
    """DUST score of the window around a place: sum of c (c - 1) / 2 over trinucleotide counts, over the window's length less two.

    Sorted, equal trinucleotides are neighbours: each adds the number of its kind before it.
    """
    seq = F.upper(seq)
    if centre is not None:
        seq = F.substring(seq, F.greatest(centre - window // 2 + 1, F.lit(1)).cast("int"), F.lit(window))
    else:
        seq = F.substring(seq, 1, window)

    def score(s: Column) -> Column:
        n = F.length(s) - 2
        tri = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"))

        def step(acc: Column, t: Column) -> Column:
            run = F.when(t == acc.last, acc.run + 1).otherwise(0)
            return F.struct(t.alias("last"), run.alias("run"), (acc.total + run).alias("total"))

        return F.when(n > 0, F.aggregate(tri, start, step, lambda acc: acc.total) / n).otherwise(0.0)

    return let(seq, score)


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")) / F.length(seq)).otherwise(0.0)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    differs = F.zip_with(F.split(a, "(?!$)"), F.split(b, "(?!$)"), lambda x, y: F.coalesce(x != y, F.lit(True)))
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(let(F.array_position(differs, True).cast("int"), lambda first: F.when(first == 0, n).otherwise(F.least(first - 1, n))))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))
