"""Centroid clustering of integer vectors by kd-tree filtering.

Each task orders its vectors by kd-trees, which are written once, a row per
leaf with its count, component sums and box. A round puts the leaves it reads
together to trees again, neighbours by pairs, and walks down from the roots
with the centroids that may own a node: one that is strictly farther than
another from every point of the node's box is dropped. A node with one owner
left adds its stored count and sums, and only the vectors of leaves with
several are compared. All sums are integers, so results depend neither on the
trees nor on how rows are spread over tasks.
"""

from __future__ import annotations

from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Fixed values of the query: components, centroids, rounds, steps of a unit.
WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Vectors of a leaf, vectors of a tree, leaves read at once.
LEAF, TREE, LEAVES = 32, 8192, 512
#: Integer components go no further, so that squared distances fit 64 bits.
LARGEST = 1 << 26
#: Components up to here have distances that doubles hold exactly.
EXACT = 1 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for the jobs run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def integers(df: DataFrame, key: str, vector: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(key, q): vectors of ``width`` finite components, each as floor(scale * x), within ``LARGEST``; other rows go."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    most = float(LARGEST) / scale
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double"), F.lit(most)), F.lit(-most)) * scale).cast("int"))
    return df.where((F.size(x) == width) & finite).select(F.col(key).cast("long").alias("key"), whole.alias("q"))


def kd_order(x):
    """The vectors' order and the leaves' starts: each part is halved at the median of its widest component until it fits a leaf."""
    import numpy as np

    order, starts, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        part = x[order[a:b]]
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, widest], half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.array(starts)


NODES = "keys array<long>, vectors array<int>, n long, sums array<long>, lo array<int>, hi array<int>"


def trees(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """The leaves of the kd-trees of (key, q), in their order, written."""

    def lists(values, starts, size):
        import numpy as np
        import pyarrow as pa

        offsets = pa.array(np.concatenate([starts, [size]]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values)

    def leaves(held):
        import numpy as np
        import pyarrow as pa

        keys = pa.concat_arrays([b.column(0) for b in held])
        x = np.concatenate([b.column(1).flatten().to_numpy() for b in held]).reshape(-1, width).astype(np.int64)
        order, starts = kd_order(x)
        x = x[order]
        counts = np.diff(np.concatenate([starts, [len(x)]]))
        each = np.arange(len(starts)) * width
        flat = lambda v, kind: lists(pa.array(v.astype(kind).ravel()), each, len(starts) * width)
        columns = [
            lists(keys.take(pa.array(order)), starts, len(x)), lists(pa.array(x.astype(np.int32).ravel()), starts * width, x.size), pa.array(counts),
            flat(np.add.reduceat(x, starts), np.int64), flat(np.minimum.reduceat(x, starts), np.int32), flat(np.maximum.reduceat(x, starts), np.int32),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")])

    def build(batches):
        held, waiting = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, TREE - waiting)
                b = b.slice(part.num_rows)
                held.append(part)
                waiting += part.num_rows
                if waiting == TREE:
                    yield leaves(held)
                    held, waiting = [], 0
        if held:
            yield leaves(held)

    with batches_of(vectors.sparkSession, TREE):
        return materialise(vectors.mapInArrow(build, NODES), "kd")


def owners(lo, hi, centroids):
    """Which centroids may own a point of each leaf's box: walks down the tree of the leaves, neighbours by pairs."""
    import numpy as np

    levels = [(lo, hi)]
    while len(levels[-1][0]) > 1:
        a, b = levels[-1]
        pairs = np.arange(0, len(a), 2)
        levels.append((np.minimum.reduceat(a, pairs), np.maximum.reduceat(b, pairs)))
    alive = np.ones((1, len(centroids)), bool)
    for a, b in reversed(levels):
        alive = alive[np.arange(len(a)) // 2] if len(a) > 1 else alive
        shared = np.flatnonzero(alive.sum(axis=1) > 1)
        for s in np.array_split(shared, -(-len(shared) // 256)) if len(shared) else []:
            low, high = a[s], b[s]
            middle = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            best = np.where(alive[s], middle, np.iinfo(np.int64).max).argmin(axis=1)
            by = centroids[best][:, None]
            away = centroids[None] - by
            corner = np.where(away > 0, high[:, None], low[:, None])  # the box's point that favours a centroid most
            alive[s] &= (away * (centroids[None] + by - 2 * corner)).sum(axis=2) <= 0
    return alive


def nearest(x, centroids, alive):
    """The nearest of the centroids that are alive for each vector, and the squared distance; of equal ones the first."""
    import numpy as np

    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= EXACT:
        f, c = x.astype(np.float64), centroids.astype(np.float64)
        d = ((f**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * (f @ c.T)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    d = np.where(alive, d, np.iinfo(np.int64).max)
    own = d.argmin(axis=1)
    return own, d[np.arange(len(x)), own]


def _read(b, width):
    """A batch of leaves as arrays."""
    import numpy as np

    flat = lambda i, kind: b.column(i).flatten().to_numpy().astype(kind).reshape(-1, width)
    return flat(1, np.int64), b.column(2).to_numpy(), flat(3, np.int64), flat(4, np.int64), flat(5, np.int64)


def means(leaves: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floors of the means of the vectors nearest to each centroid; one without vectors stays."""
    width = len(centroids[0])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centroids, np.int64)
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, count, total, lo, hi = _read(b, width)
            alive = owners(lo, hi, c)
            whole = alive.sum(axis=1) == 1
            own = alive.argmax(axis=1)[whole]
            np.add.at(n, own, count[whole])
            np.add.at(sums, own, total[whole])
            each = np.repeat(~whole, count)
            x = x[each]
            own, _ = nearest(x, c, np.repeat(alive[~whole], count[~whole], axis=0))
            for k in np.unique(own):
                n[k] += (own == k).sum()
                sums[k] += x[own == k].sum(axis=0)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(list(sums[has]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = leaves.mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = [list(c) for c in centroids]
    for r in added.collect():  # one row per centroid
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def assigned(leaves: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(key, cluster, distance) of every vector, written."""
    width = len(centroids[0]) if centroids else WIDTH

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centroids, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, count, _, lo, hi = _read(b, width)
            own, d = nearest(x, c, np.repeat(owners(lo, hi, c), count, axis=0))
            yield pa.RecordBatch.from_arrays([b.column(0).flatten(), pa.array(own.astype(np.int32)), pa.array(d)], ["key", "cluster", "distance"])

    return materialise(leaves.mapInArrow(run, "key long, cluster int, distance long"), "assigned")


def first_centroids(vectors: DataFrame, seed: str, k: int = CENTROIDS) -> list[list[int]]:
    """The vectors whose keys have the smallest hex SHA-256 of seed, colon and key; equal keys by their components. ``k`` rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return [list(r.q) for r in vectors.where("key is not null").select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()]


def cluster(df: DataFrame, key: str, vector: str, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Rows whose vector is null, of another length, or has a null, NaN or infinite
    component are left out. Components beyond ``LARGEST / scale`` count as that.
    Rows without a key are clustered but never chosen as first centroids; equal
    keys are rows of their own. With fewer rows than ``k`` there are as many
    centroids as rows with a key; with none, or an empty table, no rows result.
    An inertia beyond 64 bits is null. Columns but the two named aren't read.
    """
    spark = df.sparkSession
    vectors = integers(df, key, vector, width, scale)
    centroids = first_centroids(vectors, seed, k)
    if not centroids:
        vectors = vectors.limit(0)
    leaves = trees(vectors, width)
    with batches_of(spark, LEAVES):
        for _ in range(rounds if centroids else 0):
            centroids = means(leaves, centroids)
        found = assigned(leaves, centroids)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # at most k rows
    known = all(s is not None for s in sums.values()) and sum(sums.values()) < 1 << 63
    rows = [(i, sums.get(i), sum(sums.values()) if known else None, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(stats), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return found.withColumnRenamed("key", "vec_id")


def _round(r: int) -> str:
    return f"""a{r} AS MATERIALIZED (
  SELECT rid, CAST(m % 64 AS INTEGER) AS c, m // 64 AS d FROM (
    SELECT rid, min(d * 64 + c) AS m FROM (
      SELECT e.rid, k.c, CAST(sum((e.x - k.x) * (e.x - k.x)) AS BIGINT) AS d FROM e JOIN c{r} k ON k.j = e.j GROUP BY e.rid, k.c) GROUP BY rid)),
c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.j, CASE WHEN s.n IS NULL THEN k.x ELSE (s.t - (s.t % s.n + s.n) % s.n) // s.n END AS x
  FROM c{r} k LEFT JOIN (SELECT a.c, e.j, CAST(sum(e.x) AS BIGINT) AS t, count(*) AS n FROM a{r} a JOIN e ON e.rid = a.rid GROUP BY a.c, e.j) s ON s.c = k.c AND s.j = k.j)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
e AS MATERIALIZED (SELECT rid, j, q[j] AS x FROM v CROSS JOIN range(1, {WIDTH + 1}) r(j)),
f AS (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS k, q FROM v WHERE vec_id IS NOT NULL ORDER BY k, q LIMIT {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, j, q[j] AS x FROM (SELECT row_number() OVER (ORDER BY k, q) - 1 AS c, q FROM f) CROSS JOIN range(1, {WIDTH + 1}) r(j)),
{", ".join(map(_round, range(ROUNDS + 1)))},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS sha FROM c{ROUNDS} GROUP BY c)
SELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.rid = a.rid JOIN h ON h.c = a.c
"""
