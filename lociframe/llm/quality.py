"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are fitted here, on a bounded sample of labelled documents, by
histograms of quantile bins with the logistic loss. Features named in
``MONOTONE`` may only lower (-1) or raise (+1) the score: a split that would go
the other way is not taken, and the two sides' later values are kept apart by
their middle. A fitted model is a few numpy arrays (feature, threshold, left,
right, value), walked for many documents at once, level by level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled documents that are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 4000
#: Fixed values of the query.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT = "#*$%&|<>", 5, 10, 20
FEATURES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "bang_share", "dup_line_share",
    "repeat_share", "distinct_share", "line_words", "ended_lines", "long_word_share",
)
MONOTONE = {"symbol_share": -1, "upper_share": -1, "bang_share": -1, "dup_line_share": -1, "repeat_share": -1}
#: Words in a block; distinct words are counted in each, so that long texts don't have a lower share by their length.
BLOCK = 2000
#: Documents with a lower estimated chance of good quality are rejected.
THRESHOLD = 0.5
TREES, DEPTH, BINS, RATE, RIDGE, LEAF = 60, 3, 32, 0.15, 1.0, 20

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_digit = re.compile("[0-9]")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more, exactly."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    if len(number) ** window < 1 << 62:
        key = np.zeros(n, np.int64)
        for k in range(window):
            key = key * len(number) + ids[k : k + n]
    else:  # pairs are numbered anew before a further word joins
        key = ids[:n]
        for k in range(1, window):
            key = np.unique(key * len(number) + ids[k : k + n], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, tuple[float, ...]]:
    """Words, their characters, symbols, repeated lines, words in repeated windows; and the features."""
    import math

    text = text or ""
    words = _words(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = ended = lines = 0
    for line in text.split("\n"):
        if _words(line[:1]) or _words(line):
            lines += 1
            again += line in seen
            seen.add(line)
            ended += line.rstrip()[-1:] in ".!?\"'"
    repeat = repeated_words(words)
    c, w = max(chars, 1), max(n, 1)
    distinct = sum(len(set(words[at : at + BLOCK])) for at in range(0, n, BLOCK))
    features = (
        math.log1p(n), chars / w, symbols / c, len(_upper.findall(text)) / c, len(_digit.findall(text)) / c, text.count("!") / c,
        again / max(lines, 1), repeat / w, distinct / w, n / max(lines, 1), ended / max(lines, 1),
        sum(len(x) > 15 for x in words) / w,
    )
    return n, chars, symbols, again, repeat, features


@dataclass
class Trees:
    """Flattened trees: a leaf points at itself."""

    feature: object
    threshold: object
    left: object
    right: object
    value: object
    roots: object
    base: float

    def score(self, x):
        """Log odds for the rows of a matrix."""
        import numpy as np

        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x, y, monotone: dict[str, int] | None = None, names=FEATURES) -> Trees | None:
    """Trees for features ``x`` and labels ``y`` of 0 and 1; None unless both labels occur."""
    import numpy as np

    x, y = np.asarray(x, float).reshape(-1, len(names)), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return None
    sign = np.array([(MONOTONE if monotone is None else monotone).get(n, 0) for n in names])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(len(names))]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), base)
    nodes: list[list] = []
    roots = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def best(rows, low, high):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
            gain_of = lambda a, b, v: -(a * v + 0.5 * (b + RIDGE) * v * v)
            whole, found = gain_of(total_g, total_h, value(total_g, total_h)), None
            for f in range(len(names)):
                k = len(cuts[f]) + 1
                gs, hs, ns = (np.bincount(binned[rows, f], w, k).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = value(gs, hs), value(total_g - gs, total_h - hs)
                gain = gain_of(gs, hs, vl) + gain_of(total_g - gs, total_h - hs, vr) - whole
                gain[(ns < LEAF) | (len(rows) - ns < LEAF) | (sign[f] * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > 1e-6 and (found is None or gain.max() > found[0]):
                    c = int(gain.argmax())
                    found = (gain[c], f, c, (vl[c] + vr[c]) / 2)
            return found, float(value(total_g, total_h))

        def grow(rows, depth, low, high):
            me = len(nodes)
            found, v = best(rows, low, high)
            nodes.append([0, np.inf, me, me, RATE * v])
            if depth and found:
                _, f, c, middle = found
                goes = binned[rows, f] <= c
                bounds = [(low, high)] * 2 if not sign[f] else [(low, middle), (middle, high)] if sign[f] > 0 else [(middle, high), (low, middle)]
                left = grow(rows[goes], depth - 1, *bounds[0])
                right = grow(rows[~goes], depth - 1, *bounds[1])
                nodes[me] = [f, float(cuts[f][c]), left, right, 0.0]
            return me

        roots.append(grow(np.arange(len(y)), DEPTH, -np.inf, np.inf))
        tree = Trees(*_flat(nodes), np.array([roots[-1]]), 0.0)
        score = score + tree.score(x)
    return Trees(*_flat(nodes), np.array(roots), base)


def _flat(nodes):
    import numpy as np

    return [np.array(c, t) for c, t in zip(zip(*nodes), (np.int64, float, np.int64, np.int64, float))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most ``sample`` labelled documents, chosen by a hash of their ids.

    Labels without id or quality don't count; of several for one id the lowest does.
    """
    import numpy as np

    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "labelled")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "quality")

    def batch(batches):
        import pyarrow as pa

        for b in batches:
            x = [statistics(t.as_py())[5] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "quality"])

    found = rows.mapInArrow(batch, "doc_id long, x array<double>, quality int")
    found = found.dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).collect()
    return fit([r.x for r in found], np.array([r.quality > 0 for r in found], float))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def judge(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, statistics, base_failed, kept, quality), one for each row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no words and fails. Without a model (no labels,
    or one kind only) documents that pass the base rules are kept, with null
    quality. Ids may be null or repeat; an empty table gives no rows.
    """
    names = [f.split()[0] for f in STATS.split(", ")]

    def batch(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            numbers = np.array([r[:5] for r in rows], np.int64).reshape(-1, 5)
            failed = (numbers[:, 0] < MIN_WORDS) | (100 * numbers[:, 4] > MAX_REPEAT * numbers[:, 0])
            if model is None or not rows:
                quality, kept = pa.nulls(len(rows), pa.float64()), ~failed
            else:
                chance = 1 / (1 + np.exp(-model.score(np.array([r[5] for r in rows]))))
                quality, kept = pa.array(chance), ~failed & (chance >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, numbers.T), pa.array(failed), pa.array(kept), quality], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batch, f"doc_id long, {STATS}")


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; judged row by row where they lie."""

    def verdicts(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column("text")]
            ok = np.array([r[0] >= MIN_WORDS and 100 * r[4] <= MAX_REPEAT * r[0] for r in rows], bool)
            if model is not None and rows:
                ok &= 1 / (1 + np.exp(-model.score(np.array([r[5] for r in rows])))) >= threshold
            yield b.filter(pa.array(ok))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(verdicts, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
