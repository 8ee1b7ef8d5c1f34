"""Quality features look at whole texts."""

from lociframe.llm import quality


def test_distinct_share_sees_the_tail():
    share = lambda words: quality.statistics(" ".join(words))[5][quality.FEATURES.index("distinct_share")]
    head = [f"w{i}" for i in range(2000)]
    assert share(head) == 1 and share([]) == 0 and share(["a", "b", "a", "a"]) == 0.5
    assert share(head + ["a", "b"] * 9000) == (2000 + 9 * 2) / 20_000
    assert share(head + [f"v{i}" for i in range(1500)]) == 1
