"""Count-min sketch: nothing frequent is lost, most of the rest is dropped."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import kmers, sketch


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("ab"), f"k{rng.randrange(n)}" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.choice(["Duplex", "SimplexRev"])) for _ in range(n)]


@pytest.mark.parametrize(("bits", "least"), [(12, 2), (6, 3), (22, 2), (12, 1)])
def test_same_as_counting(spark, bits, least):
    df = spark.createDataFrame(rows(bits, 1500), "sample_id string, kmer string, family_type string").repartition(5)
    got = sorted(map(tuple, sketch.frequent_evidence(df, least, bits=bits).collect()))
    assert got == sorted(map(tuple, kmers.frequent(kmers.evidence(df), least).collect()))
    assert sketch.frequent_evidence(df.limit(0), least, bits=bits).count() == 0


def test_rare_keys_are_dropped(spark):
    df = spark.createDataFrame(rows(3, 2000), "sample_id string, kmer string, family_type string").repartition(4)
    left = sketch.maybe_frequent_rows(df, ["sample_id", "kmer"], 2, bits=16)
    n = df.groupBy("sample_id", "kmer").count()
    frequent = n.where("count > 1").agg(F.sum("count")).first()[0]
    once = n.where("count = 1").count()
    assert frequent <= left.count() <= frequent + once * 0.02


def test_sketches_add_up(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(3000)], "k long")
    one, two = df.where("k < 4"), df.where("k >= 3")
    whole = sketch.merged(sketch.sketch(one, "k", bits=8).union(sketch.sketch(two, "k", bits=8)))
    test = sketch.maybe_frequent(whole, 255, bits=8)
    assert spark.createDataFrame([(i,) for i in range(7)], "k long").where(test(F.xxhash64("k"))).count() == 7
    with pytest.raises(ValueError, match="255"):
        sketch.maybe_frequent(whole, 256, bits=8)
