"""Cost-balanced packing of documents into training sequences.

Attention over a document of n tokens costs ``LINEAR * n + n * n``. Documents
(cut at the sequence length) are taken in descending order, and each goes to
the sequence of the lowest cost so far among those with room for it; a document
that fits nowhere is cut to fill the sequence of the lowest cost with any room.

Everything happens where the documents lie: a task packs blocks of about
``BLOCK_TOKENS`` tokens as it reads them, so there is no shuffle, memory is
bounded by the block and the longest document, and a lost task is simply run
again. A block of T tokens is given T // length sequences of full length and,
for the rest, sequences of the powers of two that add up to it; so no sequence
is padded at all.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import default_vocabulary, tokenizer

#: Fixed values of the query: sequence length, the id after each document.
LENGTH, END = 4096, 2
#: Cost of a token beside the attention within its document, in units of one token pair.
LINEAR = 512
#: Tokens that a task packs together: about a thousand sequences.
BLOCK_TOKENS = 1 << 22

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)


def capacities(total: int, length: int) -> list[int]:
    """Sequence sizes that hold exactly ``total`` tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths, length: int, linear: float = LINEAR):
    """Places for documents of the given token counts: (document, start, tokens, sequence, offset).

    Every token gets exactly one place and every sequence is filled to its size.
    """
    import heapq

    import numpy as np

    room = np.array(capacities(int(sum(lengths)), length), np.int64)
    size, cost, out = room.copy(), np.zeros(len(room)), []
    waiting = []  # longest first, then in the order of arrival
    for k, n in enumerate(lengths):
        for start in range(0, n, length):
            waiting.append((-min(length, n - start), k, start))
    heapq.heapify(waiting)
    while waiting:
        n, k, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
        put = min(n, int(room[s]))
        out.append((k, start, put, s, int(size[s] - room[s])))
        room[s] -= put
        cost[s] += linear * put + put * put
        if put < n:
            heapq.heappush(waiting, (put - n, k, start + put))
    return out, cost


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its place in a sequence; ``with_ids`` adds the ids themselves.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts are the end id alone. Rows are packed one by one: a repeated
    row is packed again. An empty table gives no rows. A
    document longer than ``length`` is cut at multiples of it first. ``cost``
    is the estimated cost of the whole sequence.
    """
    import numpy as np

    path = vocabulary or default_vocabulary()
    schema = PIECES + (", ids binary" if with_ids else "")
    tail = np.array([end], "<u4").tobytes()

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok, base, done = tokenizer(path), TaskContext.get().partitionId() << 36, 0
        fields = [f.split() for f in schema.split(", ")]
        types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

        def block(ids, raws):
            nonlocal done
            places, cost = assign([len(r) // 4 for r in raws], length)
            rows = {name: [] for name, _ in fields}
            for k, start, n, s, offset in places:
                raw = raws[k][4 * start : 4 * (start + n)]
                values = (ids[k], start, n, zlib.crc32(raw), len(raws[k]) // 4, base + done + s, offset, cost[s], raw)
                for (name, _), v in zip(fields, values):
                    rows[name].append(v)
            done += len(cost)
            return pa.RecordBatch.from_arrays([pa.array(rows[n], types[t]) for n, t in fields], [n for n, _ in fields])

        ids, raws, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raws.append(tok.encode(text.as_py()) + tail)
                ids.append(doc)
                held += len(raws[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield block(ids, raws)
                    ids, raws, held = [], [], 0
        if raws:
            yield block(ids, raws)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
