"""SpotSigs fingerprints: chains of content words that follow common words.

A signature is a run of common words (the anchor) with the two content words
after it. A document's fingerprint is its set of signatures; the likeness of
two is their Jaccard similarity, which the smaller set's size over the larger's
bounds. So pairs are only looked for between neighbouring classes of set size,
and a pair whose sizes are too far apart isn't compared. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Anchors of the four languages.
ANCHORS = "the a an is of to and der die das und ist le la les des et el los de que y".split()
_NOT = r"[^\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """array<long>: the sorted set of a text's signature hashes.

    Words are runs of letters and digits, lower-cased. Anchors at the end, with
    no content word after them, don't count; a text of nothing else has its
    anchors as content. A text without signatures has its chains of two content
    words instead, a single content word itself, and a text without words none.
    """
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    anchors = F.array(*map(F.lit, ANCHORS))

    def hashes(w: Column, c: Column) -> Column:
        before = lambda k: F.when(k == 0, -1).otherwise(F.get(c, k - 1))
        chains = upto(F.size(c) - 1)
        words = lambda k: (F.get(w, F.get(c, k)), F.get(w, F.get(c, k + 1)))
        spots = F.filter(chains, lambda k: F.get(c, k) - before(k) > 1)
        found = F.transform(spots, lambda k: F.xxhash64(F.slice(w, before(k) + 2, F.get(c, k) - before(k) - 1), *words(k)))
        other = F.when(F.size(c) == 1, F.array(F.xxhash64(F.get(w, F.get(c, F.lit(0)))))).otherwise(F.transform(chains, lambda k: F.xxhash64(*words(k))))
        return _let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(other))

    def of_words(w: Column) -> Column:
        content = F.filter(upto(F.size(w)), lambda i: ~F.array_contains(anchors, F.get(w, i)))
        return _let(_let(content, lambda x: F.when(F.size(x) > 0, x).otherwise(upto(F.size(w)))), lambda c: hashes(w, c))

    return F.sort_array(F.array_distinct(_let(F.filter(F.split(F.lower(text), _NOT), lambda t: t != ""), of_words)))


def fingerprint(sigs: Column) -> Column:
    """A set's size and the hash of its members, as text."""
    return F.concat_ws(":", F.size(sigs).cast("string"), F.lower(F.lpad(F.hex(F.xxhash64(sigs)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    of = F.size(a) + F.size(b) - both
    return F.when(of == 0, 1.0).otherwise(both / of)


def similar_pairs(signed: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal sets, at a likeness of ``least`` or more.

    ``signed`` has (doc_id, sigs). Rows of equal sets are one class, named by
    its smallest ``doc_id``; ``class_members`` lists them. Sets are dealt out by
    the class of their size, each to its own and the next one, and meet through
    the rarest of their signatures, as many as two sets of that likeness cannot
    both miss. Empty sets pair with nothing.
    """
    sets = materialise(signed.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("id")), "sets")
    each = sets.select("id", F.explode("sigs").alias("sig"))
    counts = materialise(each.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    rare = each.join(counts, "sig").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("shared"))
    size = F.size("sigs")
    rare = sets.join(rare, "id").withColumn("single", size - F.size("shared"))
    # Signatures that no other set has come first in the order of rarity; of the rest, those within the prefix.
    prefix = size - F.ceil(size * least).cast("int") + 1 - F.col("single")
    step = -math.log(least)
    level = F.floor(F.log(size.cast("double")) / step).cast("int")
    rare = rare.where(prefix > 0).select("id", "sigs", level.alias("level"), F.explode(F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("p"))
    rare = rare.select("id", "sigs", "level", F.col("p.sig").alias("sig"))
    one = rare.select("id", "level", "sig")
    other = rare.select(F.col("id").alias("id2"), "sig", F.explode(F.array(F.col("level"), F.col("level") + 1, F.col("level") - 1)).alias("level"))
    pairs = one.join(other, ["sig", "level"]).where("id < id2").select("id", "id2").distinct()
    a, b = sets.toDF("sigs_a", "id"), sets.toDF("sigs_b", "id2")
    found = pairs.join(a, "id").join(b, "id2").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    return found.where(F.col("likeness") >= least).select(F.col("id").alias("a"), F.col("id2").alias("b"), "likeness")


def class_members(signed: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest ``doc_id`` with the same set."""
    ids = materialise(signed.select("doc_id", F.xxhash64("sigs").alias("h"), F.md5(F.array_join(F.transform("sigs", lambda x: x.cast("string")), ",").cast("binary")).alias("m")), "members")
    least = materialise(ids.groupBy("h", "m").agg(F.min("doc_id").alias("class_id")), "classes")
    return ids.join(least, ["h", "m"]).select("doc_id", "class_id")


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, prev, n): each id, the id before it (the last one for the first), and that one's characters.

    ``docs`` has (key, n_chars). Ids are dealt out by range; within a range the
    id before is the row before, and the ranges' ends, one row each, fill in the rest.
    """
    ids = docs.groupBy("key").agg(F.max("n_chars").alias("n"))
    ids = materialise(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy("key")
    ids = ids.withColumn("before", F.lag(F.struct("key", "n")).over(within))
    ends = ids.groupBy("part").agg(F.max(F.struct("key", "n")).alias("last"))
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(every)).alias("end"))
    ids = ids.join(ends, "part").withColumn("before", F.coalesce("before", "end"))
    return materialise(ids.select("key", F.col("before.key").alias("prev"), F.col("before.n").alias("n")), "neighbours")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited versions, one row for each row of ``docs`` (``doc_id``, ``text``).

    The edited text has its last quarter replaced by the beginning of the next
    document's. Null texts are empty, null ids come first, a lone id follows
    itself. Of several rows with the next id, the one with the smallest text
    counts. An empty table gives no rows.
    """
    lowest = F.lit(-(1 << 63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = materialise(docs.select("key", F.length("text").alias("n_chars")), "lengths")
    twice = not ids.groupBy("key").count().where("count > 1").isEmpty()
    near = neighbours(ids)
    # Both joins deal texts out by the same columns, so that texts are shuffled once.
    heads = docs.join(near, "key").select(F.col("prev").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"), "text")
    if twice:
        heads = heads.groupBy("key").agg(F.min(F.struct("text", "head")).alias("x")).select("key", "x.head", "x.text")
    heads = heads.select("key", "head", signatures(F.col("text")).alias("next_sigs"))
    out = docs.join(heads, "key").withColumn("doc_id", F.nullif("key", lowest))
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("head", F.lit(1), tail))
    out = out.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_sigs")
    out = out.select("doc_id", "n_chars", "edited", "next_sigs", signatures(F.col("text")).alias("sigs"), signatures(F.col("edited")).alias("edited_sigs"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
