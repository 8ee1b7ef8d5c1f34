"""A count-min sketch of keys, built where rows lie, that keeps rare keys from being shuffled.

Each task counts hashes into a few rows of saturating cells and hands on the
parts that aren't empty; equal parts are added up. A key's count is at most the
least of its cells, so a key whose cells say less than what is asked for can be
dropped before any shuffle, and none that is frequent is ever lost. What is
left is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import kmers as K

#: Cells of a row as a power of two, rows, cells of a part: the sketch takes ROWS * 2**BITS bytes, what tasks are sent an eighth of it.
BITS, ROWS, PART = 22, 4, 1 << 16
#: Most bits of a sketch that is fitted to its keys, its rows, and the cells that a key is given.
MOST_BITS, FITTED_ROWS, CELLS = 28, 1, 4
_CELLS = "row int, part int, cells binary"


def cells_of(hashes, row: int, bits: int):
    """The cells of 64-bit hashes in a row."""
    import numpy as np

    x = (hashes.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (2 * row + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def sketch(df: DataFrame, *keys: str | Column, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """(row, part, cells): counts of the keys' hashes, up to 255, written. Sketches of two tables add up by ``merged``."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        cells = np.zeros((rows, 1 << bits), np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            for r in range(rows):
                at, n = np.unique(cells_of(h, r, bits), return_counts=True)
                cells[r, at] = np.minimum(cells[r, at].astype(np.int64) + n, 255)
        part = min(PART, 1 << bits)
        for r in range(rows):
            split = cells[r].reshape(-1, part)
            on = np.flatnonzero(split.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), r, np.int32)), pa.array(on.astype(np.int32)), pa.array([split[p].tobytes() for p in on], pa.binary())], ["row", "part", "cells"])

    # A sketch for each core and not for each split: what is shuffled does not grow with the input.
    hashes = df.select(F.xxhash64(*keys).alias("h")).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    return written(merged(hashes.mapInArrow(count, _CELLS)), "sketch")


def fitted_bits(n: int) -> int:
    """Bits of a row with ``CELLS`` cells for each of n keys, within bounds."""
    return min(MOST_BITS, max(BITS, (CELLS * n - 1).bit_length()))


def merged(sketches: DataFrame) -> DataFrame:
    """Equal parts added up, one after the other, so that only one is held."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], ["row", "part", "cells"])

        for b in batches:
            for row, part, cells in zip(*(b.column(i).to_pylist() for i in range(3))):
                now = np.frombuffer(cells, np.uint8).astype(np.int16)
                if key == (row, part):
                    total = np.minimum(total + now, 255)
                    continue
                if key is not None:
                    yield out()
                key, total = (row, part), now
        if key is not None:
            yield out()

    return sketches.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(add, _CELLS)


def maybe_frequent(counts: DataFrame, least: int, bits: int = BITS, rows: int = ROWS):
    """A function of a hash column: whether a key may have been seen ``least`` times; false is certain.

    Tasks are sent one bit a cell, rows * 2**bits / 8 bytes whatever the size of the data.
    """
    import numpy as np
    import pandas as pd

    if not 1 <= least <= 255:
        raise ValueError("cells count from 1 to 255")
    part = min(PART, 1 << bits)
    enough = np.zeros((rows, (1 << bits) // part, part // 8), np.uint8)

    def bits_of(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            packed = [np.packbits(np.frombuffer(c.as_buffer(), np.uint8) >= least, bitorder="little").tobytes() for c in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["row", "part", "cells"])

    for r in counts.mapInArrow(bits_of, _CELLS).toLocalIterator():  # a bit a cell, a few parts at a time
        enough[r.row, r.part] = np.frombuffer(r.cells, np.uint8)
    sent = counts.sparkSession.sparkContext.broadcast(enough.reshape(rows, -1))

    @F.pandas_udf("boolean")
    def test(h):
        x, ok = h.to_numpy(np.int64), np.ones(len(h), bool)
        for r in range(rows):
            at = cells_of(x, r, bits)
            ok &= (sent.value[r, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(ok)

    return test


def maybe_frequent_rows(df: DataFrame, keys: list[str], least: int, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """The rows of ``df`` whose keys may be seen ``least`` times: all that are, and few that aren't. ``df`` is read twice."""
    if least <= 1:
        return df
    test = maybe_frequent(sketch(df, *keys, bits=bits, rows=rows), least, bits, rows)
    return df.where(test(F.xxhash64(*keys)))


def frequent_evidence(kmers: DataFrame, least: int = 2, keys: list[str] | None = None, bits: int = BITS, rows: int = ROWS, k: int | None = None) -> DataFrame:
    """``kmers.frequent(kmers.evidence(...))``; k-mers that are surely rarer meet no shuffle. ``k`` is the length of coded k-mers."""
    keys = keys if keys is not None else ["sample_id"]
    left = maybe_frequent_rows(kmers, [*keys, "kmer"], least, bits, rows)
    return K.frequent(K.evidence(left, keys, k=k), least)
