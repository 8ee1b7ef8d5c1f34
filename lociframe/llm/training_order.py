"""Training-order materialisation: fixed-length sequences at keyed random slots.

Texts become token ids, which each task runs together and cuts at a fixed
length. Sequences are numbered by task and place, and a keyed Feistel network
over the smallest even number of bits, walked along its cycle until it falls
below the count, gives each number its own slot; no table of the order exists
anywhere. Ranges of slots are shards: one file each, a fixed number of bytes
per record, in the order of slots, so record k of the run is at one computable
place and a reader resumes by seeking there.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, table
from .tokens import default_vocabulary, tokenizer

#: Fixed values of the query: tokens in a sequence, the id after each document (and in padding), the order's key.
LENGTH, END, KEY = 2048, 2, 20_240_229
ROUNDS = 6
#: Sequences in a shard.
SHARD = 4096
#: Rows of task offsets, 16 bytes each, that are sent to every task; more are joined by a shuffle.
MOST_TASKS = 200_000

SEQUENCES = "task long, place long, doc_ids array<long>, n_tokens long, ids_crc32 long, ids binary"


def slots(numbers, count: int, key: int = KEY):
    """The slot of each number below ``count``: a permutation that depends on the key."""
    import numpy as np

    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def network(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        return (left << np.uint64(half)) | right

    x = network(np.asarray(numbers, np.uint64))
    while (out := x >= count).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Sequences of ``length`` ids: each document's ids and the end id, run together within a task.

    A task's last sequence is padded with the end id; ``n_tokens`` counts ids
    before the padding. Ids take 2 bytes if the vocabulary allows, else 4, and
    each sequence's are compressed until its shard is written.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        small = zstandard.ZstdCompressor(3).compress
        tok, task, place = tokenizer(path), TaskContext.get().partitionId(), 0
        kind = "<u2" if tok.size <= 1 << 16 else "<u4"
        names = [f.split()[0] for f in SEQUENCES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
        held, owners, waiting = [], [], 0

        def rows(last):
            nonlocal held, owners, waiting, place
            ids = np.concatenate(held) if held else np.zeros(0, kind)
            n = -(-len(ids) // length) if last else len(ids) // length
            edges = np.cumsum([0, *map(len, held)])
            out = []
            for k in range(n):
                part = ids[k * length : (k + 1) * length]
                a, b = np.searchsorted(edges, k * length, "right") - 1, np.searchsorted(edges, k * length + len(part), "left")
                raw = np.concatenate([part, np.full(length - len(part), end, kind)]).tobytes()
                out.append((task, place + k, owners[a:b], len(part), zlib.crc32(raw), small(raw)))
            place += n
            first = np.searchsorted(edges, n * length, "right") - 1
            rest = ids[n * length :]
            held, owners, waiting = ([rest], owners[first:], len(rest)) if len(rest) else ([], [], 0)
            if len(rest) and len(owners) > 1:  # the rest of several documents keeps its edges
                held = np.split(rest, (edges[first + 1 : -1] - n * length).tolist())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.concatenate([np.frombuffer(tok.encode(text.as_py()), "<u4").astype(kind), np.array([end], kind)]))
                owners.append(doc)
                waiting += len(held[-1])
                if waiting >= 512 * length:
                    yield rows(False)
        yield rows(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, SEQUENCES)


def ordered(seqs: DataFrame, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """``seqs`` (materialised) with ``number``, ``slot``, ``shard`` and ``record``."""
    counts = seqs.groupBy("task").agg(F.count("*").alias("n"))
    # One row per task that wrote sequences: their number is that of the input's partitions.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total = seqs.count()

    @F.pandas_udf("long")
    def place(number):
        import pandas as pd

        return pd.Series(slots(number.to_numpy(), total, key))

    small = seqs.select("task").distinct().count() <= MOST_TASKS
    out = seqs.join(F.broadcast(counts) if small else counts, "task").withColumn("number", F.col("before") + F.col("place"))
    out = out.withColumn("slot", place("number"))
    return out.withColumn("shard", F.floor(F.col("slot") / shard)).withColumn("record", F.pmod("slot", F.lit(shard)))


def write_shards(ordered: DataFrame, path: str, shard: int = SHARD) -> None:
    """One file per shard, ``path/shard=N/part-*``: records in the order of slots, each its ids and one byte of line end."""

    def unpacked(batches):
        import pyarrow as pa
        import zstandard

        whole = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([whole(x.as_py()) for x in part.column(2)], pa.binary())], ["shard", "slot", "value"])

    n = max(1, -(-ordered.count() // shard))
    # A shard is a range of slots and a partition of its own, so tasks are alike and each writes one file in order.
    rows = ordered.select("shard", "slot", "ids").repartitionById(n, F.col("shard").cast("int")).mapInArrow(unpacked, "shard long, slot long, value binary")
    rows = rows.sortWithinPartitions("shard", "slot")
    rows.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(path)


def read_record(files: dict[int, str], slot: int, length: int = LENGTH, width: int = 2, shard: int = SHARD) -> bytes:
    """Ids at a slot, by one seek; ``files`` are the shards' files."""
    stride = length * width + 1
    with open(files[slot // shard], "rb") as f:
        f.seek(slot % shard * stride)
        return f.read(length * width)


def materialise_order(docs: DataFrame, path: str, vocabulary: str | None = None, length: int = LENGTH, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """Write the shards of ``docs`` (``doc_id``, ``text``) and return where each sequence went.

    (slot, shard, record, number, doc_ids, n_tokens, ids_crc32). Null and empty
    texts are the end id alone; ids may be null or repeat. An empty table
    gives no rows and no files.
    """
    seqs = materialise(sequences(docs, vocabulary, length), "sequences")
    rows = ordered(seqs, key, shard)
    write_shards(rows, path, shard)
    return rows.select("slot", "shard", "record", "number", "doc_ids", "n_tokens", "ids_crc32")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise_order(table(spark, sf_dir, "documents", "doc_id", "text"), new_path(spark, "shards"))
