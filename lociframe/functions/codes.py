"""K-mers as numbers: two bits a letter, a whole batch of sequences at a time.

A code takes 8 bytes where the text takes a length and 31, and codes order as
texts do, so what is grouped, joined and shuffled by k-mer is a third as large.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that are worked on at once; a longer sequence is taken in pieces.
PIECE = 1 << 20

#: An odd factor that spreads codes over all 64 bits, and the one that undoes it.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)


def canonical_codes(letters, k: int):
    """The smaller code of each window of k letters (0 to 3) and of its reverse complement; windows double in length."""
    import numpy as np

    f, r, size, length, fwd, rev = letters, 3 - letters, 1, 0, None, None
    while True:
        if k & size:
            m = len(letters) - length - size + 1
            if fwd is None:
                fwd, rev = f[:m], r[:m]
            else:
                fwd, rev = (fwd[:m] << 2 * size) | f[length : length + m], rev[:m] | (r[length : length + m] << 2 * length)
            length += size
        if 2 * size > k:
            return np.minimum(fwd, rev)
        m = len(f) - size
        f, r, size = (f[:m] << 2 * size) | f[size:], r[:m] | (r[size:] << 2 * size), 2 * size


def _table():
    import numpy as np

    place = np.full(256, 4, np.int64)
    for i, both in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
        place[list(both)] = i
    return place


def _windows(seqs, k: int):
    """(code, whether all its letters are A, C, G or T) of every window of a column of texts, and where each row's begin."""
    import numpy as np
    import pyarrow as pa

    seqs = pa.concat_arrays([seqs.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    per = np.maximum(np.diff(offsets) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(per)])
    codes, clean, inside = np.zeros(len(data), np.int64), np.zeros(len(data), bool), np.zeros(len(data) + 1, np.int8)
    on = per > 0
    np.add.at(inside, offsets[:-1][on] - offsets[0], 1)
    np.add.at(inside, offsets[:-1][on] - offsets[0] + per[on], -1)
    table = _table()
    for a in range(0, len(data) - k + 1, PIECE):
        x = table[data[a : a + PIECE + k - 1]]
        bad = np.concatenate([[0], np.cumsum(x > 3)])
        n = len(x) - k + 1
        codes[a : a + n], clean[a : a + n] = canonical_codes(np.where(x > 3, 0, x), k), bad[k:] == bad[:-k]
    keep = np.cumsum(inside[:-1], dtype=np.int8) > 0
    return codes[keep], clean[keep], begin


def kmer_codes(seq: Column, k: int, distinct: bool = False) -> Column:
    """The canonical k-mers' codes of a sequence as an array, ``distinct`` or each; null at places with other letters than A, C, G and T."""

    @F.arrow_udf("array<bigint>")
    def codes(seqs):
        import numpy as np
        import pyarrow as pa

        values, clean, begin = _windows(seqs, k)
        if distinct:
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[clean]
            values = values[clean]
            order = np.lexsort((values, row))
            row, values = row[order], values[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
            row, values = row[new], values[new]
            begin, clean = np.searchsorted(row, np.arange(len(begin))), np.ones(len(values), bool)
        return pa.LargeListArray.from_arrays(begin, pa.array(values, mask=~clean)).cast(pa.list_(pa.int64()))

    return codes(seq)


def kmer_code(kmer: Column, k: int) -> Column:
    """The code of a k-mer's canonical form; null unless it has k letters, all A, C, G or T."""

    @F.arrow_udf("bigint")
    def code(kmers):
        import numpy as np
        import pyarrow as pa

        values, clean, begin = _windows(kmers, k)
        one = np.diff(begin) == 1
        out, ok = np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        out[one], ok[one] = values[begin[:-1][one]], clean[begin[:-1][one]]
        return pa.array(out, mask=~ok)

    return code(kmer)


def kmer_codes_with_error(seq: Column, err: Column, k: int) -> Column:
    """As ``kmer_codes``, each with its window's mean error; bases without a value count as 0."""

    @F.arrow_udf("array<struct<kmer: bigint, err: double>>")
    def codes(seqs, errs):
        import numpy as np
        import pyarrow as pa

        values, clean, begin = _windows(seqs, k)
        per = np.diff(begin)
        # Each row's errors at the places of its letters, so that a window's are next to each other.
        size = np.where(per > 0, per + k - 1, 0)
        at = np.concatenate([[0], np.cumsum(size)])
        errs = pa.concat_arrays([errs])
        given = np.asarray(errs.value_lengths().fill_null(0))
        have = np.minimum(given, size)
        flat = np.zeros(at[-1] + k, np.float64)
        source = errs.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        within = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        flat[np.repeat(at[:-1], have) + within] = source[np.repeat(np.cumsum(given) - given, have) + within]
        first = np.repeat(at[:-1], per) + np.arange(len(values)) - np.repeat(begin[:-1], per)
        total = np.zeros(len(flat) - k + 1)
        for j in range(k):
            total += flat[j : len(total) + j]
        both = pa.StructArray.from_arrays([pa.array(values), pa.array(total[first] / k)], ["kmer", "err"], mask=pa.array(~clean))
        return pa.LargeListArray.from_arrays(begin, both).cast(pa.list_(both.type))

    return codes(seq, err)


@cache
def _eights():
    """The eight letters of each two bytes."""
    import numpy as np

    pairs = np.arange(1 << 16)[:, None] >> np.arange(14, -2, -2) & 3
    return np.frombuffer(b"ACGT", np.uint8)[pairs].view(np.uint64).ravel()


def _once(x):
    """An array in order, equal values once; ``np.unique`` hashes, which takes many times as long."""
    import numpy as np

    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def _spell(x, k: int):
    """The letters of an array of codes as texts."""
    import numpy as np
    import pyarrow as pa

    bits = (x.astype(np.uint64) << np.uint64(64 - 2 * k)).astype(">u8").view(">u2")
    out = np.ascontiguousarray(_eights()[bits].view(np.uint8).reshape(len(x), 32)[:, :k])
    return pa.LargeStringArray.from_buffers(len(x), pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * k), pa.py_buffer(out))


def spelled_codes(code: Column, k: int) -> Column:
    """The letters of codes."""

    @F.arrow_udf("string")
    def spell(codes):
        import pyarrow as pa
        import pyarrow.compute as pc

        text = _spell(codes.fill_null(0).to_numpy(zero_copy_only=False), k)
        return pc.if_else(codes.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())

    return spell(code)


def dealt_codes(df: DataFrame, seq: str, k: int, parts: int) -> DataFrame:
    """The canonical k-mers' codes of all rows' sequences in blocks (``part``, ``codes``), equal ones in the same of ``parts``.

    A block has codes of a batch of rows, each once, multiplied so that all
    parts get as many, in order, 8 bytes each.
    """

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        # The first of each part but the first one, among 64-bit numbers.
        bounds = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
        for batch in batches:
            values, clean, _ = _windows(batch.column(0), k)
            every = _once(values[clean].view(np.uint64) * np.uint64(MIX))
            for a in range(0, len(every), PIECE):
                piece = every[a : a + PIECE]
                ends = np.concatenate([[0], np.searchsorted(piece, bounds), [len(piece)]])
                part = np.flatnonzero(np.diff(ends))
                at = np.append(ends[part], len(piece)).astype(np.int32) * np.int32(8)
                blocks = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(piece)])
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), blocks], ["part", "codes"])

    return df.select(F.col(seq).cast("string")).mapInArrow(cut, "part int, codes binary")


def met_codes(blocks: DataFrame, k: int | None = None) -> DataFrame:
    """The codes (``kmer``) of ``dealt_codes`` once, a part at a time; their letters with ``k``, their length."""

    def meet(table):
        import numpy as np
        import pyarrow as pa

        codes = _once(np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("codes")]) * np.uint64(UNMIX))
        some = range(0, len(codes), PIECE >> 4)
        chunks = [codes[a : a + (PIECE >> 4)].view(np.int64) for a in some]
        return pa.Table.from_batches(pa.RecordBatch.from_arrays([pa.array(x) if k is None else _spell(x, k).cast(pa.string())], ["kmer"]) for x in chunks)

    return blocks.groupBy("part").applyInArrow(meet, "kmer bigint" if k is None else "kmer string")
