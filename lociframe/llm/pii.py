"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans; a validator (ranges, Luhn, mod 97) confirms or drops
each; for the added kinds, words nearby raise or lower a score that has to reach
``ACCEPT``. Positions come from the pieces between matches, so each text is
matched by the engine's own linear scan. Patterns are written so that no match
is tried again from within a run of characters that has just failed: very long
runs cost no more than their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: Kinds in the order of the results, and their patterns.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "shortcard")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "shortcard": r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])(?![\x20-][0-9])",
}
#: A text that a cheap search shows to have no match isn't scanned.
GATES = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "shortcard": r"[0-9](?:[\x20-]?[0-9]){12}",
}
#: Score of a confirmed proposal without context, and what words within ``NEAR`` characters add or take.
SCORES = {"iban": 0.7, "ssn": 0.3, "shortcard": 0.3}
FOR = {"iban": r"iban|account|bank|konto|compte|cuenta", "ssn": r"ssn|social|security", "shortcard": r"card|visa|amex|credit|karte|carte|tarjeta"}
AGAINST = r"order|invoice|isbn|version|serial|part no"
NEAR, ACCEPT = 40, 0.5


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    double = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, double(i)).otherwise(value(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an IBAN's check digits hold."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) >= 65, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.split(turned, "(?!$)"), F.lit(0), step) == 1


def _n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return _n_digits(match).between(16, 19) & luhn(match)
    if kind == "phone":
        return _n_digits(match).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, r"\x20", "")).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "shortcard":
        return luhn(match)
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of the confirmed matches, leftmost and non-overlapping, in code points.

    ``text`` is not null. Matches that fail are dropped without another try.
    """
    pattern = PATTERNS[kind]
    found = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.coalesce(F.length(gap), F.lit(0)).alias("gap"), m.alias("m"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def accepted(acc: Column, x: Column) -> Column:
        if kind in BASE:
            return _confirmed(kind, x.m)
        start, end = acc.at + x.gap, acc.at + x.gap + F.length(x.m)
        before = F.substring(text, F.greatest(start - NEAR + 1, F.lit(1)), F.least(start, F.lit(NEAR)))
        near = F.lower(F.concat_ws(" ", before, F.substring(text, end + 1, F.lit(NEAR))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(FOR[kind]), 0.3).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)
        return _confirmed(kind, x.m) & (score >= ACCEPT)

    def step(acc: Column, x: Column) -> Column:
        start, end = acc.at + x.gap, acc.at + x.gap + F.length(x.m)
        new = F.array(F.struct(start.alias("start"), end.alias("end")))
        out = F.when(x.m.isNotNull() & accepted(acc, x), F.concat(acc.out, new)).otherwise(acc.out)
        return F.struct(F.coalesce(end, acc.at).alias("at"), out.alias("out"))

    all_spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc.out)
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
    return F.when(gate, all_spans).otherwise(none)


def found(text: Column, kinds=BASE + ADDED) -> Column:
    """array<struct<kind, start, end>> of all kinds, in their order, then by start; null text is empty."""
    text = F.coalesce(text, F.lit(""))
    named = lambda kind: F.transform(spans(text, kind), lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return F.concat(*map(named, kinds))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span as [KIND]; of overlapping spans the one that starts first (then the longer) counts."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus"), s.kind.alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, s.start - acc.at)
        new = F.struct((-s.minus).alias("at"), F.concat(acc.out, F.array(gap, F.concat(F.lit("["), F.upper(s.kind), F.lit("]")))).alias("out"))
        return F.when(s.start >= acc.at, new).otherwise(F.struct(F.greatest(acc.at, -s.minus).alias("at"), acc.out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(text, acc.at + 1))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(order, start, step, end))


def detect(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): counts and span lists.

    Null and empty texts have no spans. Ids may be null or repeat: each row is
    judged by itself. An empty table gives no rows.
    """
    docs = docs.select("doc_id", found(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s.kind.isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` (where it is a column) set anew.

    All rows and columns stay. A null text stays null.
    """
    name = free_name(docs, "found")
    out = docs.withColumn(name, F.when(F.col("text").isNotNull(), found(F.col("text"))))
    out = out.withColumn("text", redacted(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents", "doc_id", "text"))
