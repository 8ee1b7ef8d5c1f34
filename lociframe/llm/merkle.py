"""Merkle manifest of a dataset: a tree over its rows, a proof for each row, and their verification.

Rows are leaves, ordered within their group; subroots of the groups are the
leaves of one tree more. Trees are cut into aligned blocks of ``BLOCK`` leaves.
Within a block a traversal gives the authentication paths leaf by leaf: each
level keeps one sibling and one stack on which its next sibling is built, and a
schedule spreads that work evenly, always to the stack whose lowest node is
lowest, so memory is logarithmic beside the block's leaves. Tops of blocks are
the leaves of the next blocks, until one node remains; what lies above a block
is shared by its rows and appended to their paths.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .numbering import numbered

#: Levels within a block, and its leaves.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Columns of the query's leaves.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lower-case hex SHA-256 of the parts, run together."""
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(*columns: Column) -> Column:
    """A row's digest: of each value its length in bytes, a colon and its text; a dash for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)), 256)


class Builder:
    """Builds node ``index`` of ``level`` from the leaves below it, one leaf or one digest per step."""

    def __init__(self, level: int, index: int, leaves: list[bytes]):
        self.level, self.leaves, self.stack = level, leaves, []
        self.next, self.stop = index << level, min((index + 1) << level, len(leaves))
        self.done = self.next >= self.stop

    def low(self) -> int:
        """Level of the lowest node on the stack; the node's own before it is begun."""
        return self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            at, right = s.pop()
            s[-1] = (at + 1, digest(s[-1][1], right))
        elif self.next < self.stop:
            s.append((0, self.leaves[self.next]))
            self.next += 1
        else:  # the tree's last run is short: a lone node is digested by itself
            s[-1] = (s[-1][0] + 1, digest(s[-1][1]))
        self.done = len(s) == 1 and s[0][0] == self.level and self.next == self.stop

    def node(self) -> bytes | None:
        """The node; None where the tree has none."""
        while not self.done:
            self.step()
        return self.stack[0][1] if self.stack else None


def traverse(leaves: list[bytes], height: int):
    """The siblings of each leaf, one per level, None where it has none; then the top as the last item."""
    siblings = [Builder(h, 1, leaves).node() for h in range(height)]
    builders = [Builder(h, 0, leaves) for h in range(height)]
    for b in builders:
        b.node()
    for at in range(1, len(leaves) + 1):
        yield siblings
        h = 0
        while h < height and at % (1 << h) == 0:
            siblings[h] = builders[h].node()
            builders[h] = Builder(h, ((at >> h) + 1) ^ 1, leaves)
            h += 1
        for _ in range(2 * height - 1):
            open_ = [b for b in builders if not b.done]
            if not open_:
                break
            min(open_, key=Builder.low).step()
    yield Builder(height, 0, leaves).node()


def path_of(place: int, siblings: list[bytes | None]) -> bytes:
    """A path as text: L or R for the sibling's side and its digest, a dash for a level without one."""
    return b"".join(b"-" if s is None else (b"L" if place >> h & 1 else b"R") + s for h, s in enumerate(siblings))


def steps(path: bytes):
    """(side, sibling) of each level of a path."""
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        n = 0 if side == b"-" else 64
        yield side, path[at + 1 : at + 1 + n]
        at += 1 + n


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for side, sibling in steps(path):
        node = digest(sibling, node) if side == b"L" else digest(node, sibling)
    return node


CLIMBED = "g string, place long, total long, key long, leaf string, folded string, path string, top string"


def climb(rows: DataFrame) -> DataFrame:
    """Rows (g, place, total, key, leaf, altered) with their paths within their blocks, what they fold to, and the block's top.

    A group of several blocks is raised by ``LEVELS`` in each of them; one of a single block to its root.
    """

    def block(t):
        import pyarrow as pa

        t = t.sort_by("place")
        place, leaves = t["place"].to_pylist(), [x.encode() for x in t["leaf"].to_pylist()]
        total = t["total"][0].as_py()
        height = LEVELS if total > BLOCK else (total - 1).bit_length()
        paths = traverse(leaves, height)
        found = [path_of(p, next(paths)) for p in place]
        top = next(paths).decode()
        folded = [fold(leaf if x is None else x.encode(), p).decode() for leaf, x, p in zip(leaves, t["altered"].to_pylist(), found)]
        columns = [t[c].combine_chunks() for c in ("g", "place", "total", "key", "leaf")]
        return pa.table([*columns, pa.array(folded), pa.array([p.decode() for p in found]), pa.array([top] * len(place))], names=[c.split()[0] for c in CLIMBED.split(", ")])

    keyed = rows.withColumn("block", F.shiftright("place", LEVELS))
    return materialise(keyed.groupBy("g", "block").applyInArrow(block, CLIMBED), "climbed")


def tops(climbed: DataFrame) -> DataFrame:
    """The blocks of ``climbed`` as rows of the next level."""
    first = climbed.where(F.col("place") % BLOCK == 0)
    total = F.shiftright(F.col("total") + (BLOCK - 1), LEVELS)
    return first.select("g", F.shiftright("place", LEVELS).alias("place"), total.alias("total"), F.lit(None).cast("long").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("altered"))


def tower(rows: DataFrame) -> list[DataFrame]:
    """``climb`` level by level, until each group has one node; at most one level for each factor of ``BLOCK``."""
    levels = [climb(rows)]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        levels.append(climb(tops(levels[-1])))
    return levels


def proofs(leaves: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root) of rows (g, key, leaf, altered).

    ``g`` is the group's name in the order of groups and not null, ``altered``
    the digest to verify instead of ``leaf``, if any. Leaves go by key, nulls
    first, equal keys by digest, so that repeated rows have one order. A single
    leaf is its group's subroot; an empty table gives no rows.
    """
    own = tower(numbered(leaves, "g", ["key", "leaf", "altered"]).select("g", "place", "total", "key", "leaf", "altered"))
    last = tops(own[-1])
    one = last.select(F.lit("").alias("one"), "g", "leaf")
    groups = numbered(one, "one", ["g"])
    groups = groups.select(F.col("one").alias("g"), "place", "total", F.lit(None).cast("long").alias("key"), "leaf", F.lit(None).cast("string").alias("altered"), F.col("g").alias("name"))
    groups = materialise(groups, "groups")
    shared = tower(groups.drop("name"))

    def above(levels: list[DataFrame], up: DataFrame, *more: str) -> DataFrame:
        """Paths of the rows of ``levels`` but the first, from their place up; ``up`` has those of the groups."""
        for climbed in reversed(levels[1:]):
            block = F.shiftright("place", LEVELS)
            rows = climbed.select("g", "place", block.alias("block"), F.col("path").alias("own"))
            up = rows.join(up.withColumnRenamed("place", "block"), ["g", "block"]).select("g", "place", F.concat("own", "path").alias("path"), *more)
        return up

    root = tops(shared[-1]).select("g", "place", F.lit("").alias("path"), F.col("leaf").alias("root"))
    up = above(shared, root, "root").withColumnRenamed("place", "block")
    up = shared[0].select("g", "place", F.shiftright("place", LEVELS).alias("block"), F.col("path").alias("own")).join(up, ["g", "block"])
    up = up.select("g", "place", F.concat("own", "path").alias("path"), "root").join(groups, ["g", "place"])
    up = up.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("place"), "path", F.col("leaf").alias("subroot"), "root")
    up = materialise(above(own, materialise(up, "shared"), "subroot", "root"), "above")
    rows = own[0].withColumn("block", F.shiftright("place", LEVELS)).withColumnRenamed("path", "own")
    rows = rows.join(up.withColumnRenamed("place", "block"), ["g", "block"])
    rows = rows.select("key", "leaf", "subroot", "root", "own", "path", "folded")

    def finish(batches):
        import pyarrow as pa

        for b in batches:
            paths = list(zip(*(b.column(i).to_pylist() for i in (4, 5, 6))))
            folded = [fold(f.encode(), p.encode()).decode() for _, p, f in paths]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([o + p for o, p, _ in paths], pa.string()), pa.array(folded, pa.string())], ["key", "leaf", "subroot", "root", "path", "folded_root"])

    return rows.mapInArrow(finish, "key long, leaf string, subroot string, root string, path string, folded_root string")


def group_name(column: Column) -> Column:
    """A group's name that is not null and sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def manifest(df: DataFrame, key: str, group: str, columns: list[str], altered: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root) for each row of ``df``.

    Leaves are digests of ``columns``. ``altered`` is a digest to verify in the
    place of the leaf, null for none. Further columns are not looked at.
    """
    rows = df.select(group_name(F.col(group)).alias("g"), F.col(key).cast("long").alias("key"), leaf(*map(F.col, columns)).alias("leaf"), (F.lit(None) if altered is None else altered).cast("string").alias("altered"))
    return proofs(rows)


def verify(df: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, valid): rows of ``df`` against a manifest's paths and root.

    A row is valid if its digest and a path of its key give the root. A row
    whose key has no path, or is null, is not.
    """

    def check(batches):
        import pyarrow as pa

        for b in batches:
            key_, leaf_, path, root = (b.column(i).to_pylist() for i in range(4))
            ok = [p is not None and fold(x.encode(), p.encode()).decode() == r for x, p, r in zip(leaf_, path, root)]
            yield pa.RecordBatch.from_arrays([pa.array(key_, pa.int64()), pa.array(leaf_, pa.string()), pa.array(ok, pa.bool_())], ["key", "leaf", "valid"])

    rows = df.select(F.col(key).cast("long").alias("key"), leaf(*map(F.col, columns)).alias("leaf")).groupBy("key", "leaf").agg(F.count("*").alias("n"))
    paths = found.select(F.col("key").alias("k"), "path", "root")
    tried = rows.join(paths, F.col("key") == F.col("k"), "left").select("key", "leaf", "path", "root").mapInArrow(check, "key long, leaf string, valid boolean")
    tried = tried.groupBy("key", "leaf").agg(F.bool_or("valid").alias("valid"))
    same = rows.key.eqNullSafe(tried.key) & (rows.leaf == tried.leaf)
    return rows.join(tried, same).select(rows.key, "valid", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their proofs; where 7 divides the id's CRC-32, a row with one more in n_chars is verified, which must fail."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.expr("try_add(cast(n_chars as bigint), 1L)")
    altered = F.when(hit, leaf(*(more if c == "n_chars" else F.col(c) for c in COLUMNS)))
    found = manifest(docs, "doc_id", "lang", list(COLUMNS), altered)
    siblings = F.translate("path", "LR-", "")
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _encoded(**instead: str) -> str:
    text = [f"CAST({instead.get(c, c)} AS VARCHAR)" for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')" for t in text) + ")"


#: CRC-32 of the ids, byte by byte; nodes level by level in each group, then of the subroots; siblings by level; folds step by step.
OP11_SQL = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE k < 8),
crc(id, pos, c) AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, pos + 1, xor(c >> 8, v) FROM crc JOIN bits ON k = 8 AND i = xor(c, ascii(substr(id, pos + 1, 1))) & 255 WHERE pos < length(id)),
hit AS (SELECT id FROM crc WHERE pos = length(id) AND xor(c, 4294967295) % 7 = 0),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_encoded()} AS leaf, CASE WHEN id IS NULL THEN {_encoded()} ELSE {_encoded(n_chars="n_chars + 1")} END AS other
  FROM documents LEFT JOIN hit ON id = CAST(doc_id AS VARCHAR)),
docs AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM leaves),
low(g, level, place, total, d) AS (
  SELECT g, 0, place, total, leaf FROM docs
  UNION ALL
  SELECT g, level + 1, place // 2, (total + 1) // 2, sha256(string_agg(d, '' ORDER BY place)) FROM low WHERE total > 1 GROUP BY g, level, place // 2, total),
subroots AS (SELECT g, level AS height, d, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM low WHERE total = 1),
high(level, place, total, d) AS (
  SELECT 0, place, total, d FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (total + 1) // 2, sha256(string_agg(d, '' ORDER BY place)) FROM high WHERE total > 1 GROUP BY level, place // 2, total),
tops AS (SELECT level AS height, d AS root FROM high WHERE total = 1),
ways AS (
  SELECT q.g, q.place, s.level AS step, (q.place >> s.level) & 1 AS is_right, n.d AS sibling
  FROM docs q JOIN subroots u ON u.g = q.g JOIN range(64) s(level) ON s.level < u.height
  LEFT JOIN low n ON n.g = q.g AND n.level = s.level AND n.place = xor(q.place >> s.level, 1)
  UNION ALL
  SELECT q.g, q.place, u.height + s.level, (u.place >> s.level) & 1, n.d
  FROM docs q JOIN subroots u ON u.g = q.g CROSS JOIN tops t JOIN range(64) s(level) ON s.level < t.height
  LEFT JOIN high n ON n.level = s.level AND n.place = xor(u.place >> s.level, 1)),
proofs AS (SELECT g, place, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof FROM ways GROUP BY g, place),
folds(g, place, step, d) AS (
  SELECT g, place, 0, other FROM docs
  UNION ALL
  SELECT f.g, f.place, f.step + 1, sha256(CASE WHEN w.sibling IS NULL THEN f.d WHEN w.is_right = 1 THEN w.sibling || f.d ELSE f.d || w.sibling END)
  FROM folds f JOIN ways w ON w.g = f.g AND w.place = f.place AND w.step = f.step),
folded AS (SELECT g, place, arg_max(d, step) AS folded_root FROM folds GROUP BY g, place)
SELECT q.doc_id, q.leaf, u.d AS subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.root AS verified
FROM docs q JOIN subroots u ON u.g = q.g CROSS JOIN tops t LEFT JOIN proofs p ON p.g = q.g AND p.place = q.place JOIN folded f ON f.g = q.g AND f.place = q.place
"""
