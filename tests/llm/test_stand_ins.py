"""Which rows stay of components of near duplicates."""

from lociframe.llm import simhash


def test_rows_are_judged_one_by_one(spark):
    text = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(5)]
    # A copy without id, a clean row without id, and an id with two texts of which the second is a later copy.
    data = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[1] + " "), (5, text[2]), (5, text[0]), (6, text[2]), (7, text[3]), (7, text[3])]
    kept = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([data[i] for i in (0, 2, 3, 4, 7)], key=repr)
