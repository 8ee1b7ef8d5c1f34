"""Removing repeated passages by prefix-free parsing.

Texts are parsed into phrases by triggers: every 100-byte window has as its
trigger the 32-byte gram of the lowest rolling hash in it (the leftmost one),
and the windows that share a trigger make up a phrase. Neighbouring phrases
overlap by 99 bytes, so each window lies in exactly one phrase, and equal
windows have equal triggers at equal places. Repeated text gives equal phrases:

* The parse is written as (gram, content, position) rows; phrases whose gram
  occurs once cannot repeat and are dropped at the first shuffle. What repeats
  within a batch is found there, so a very frequent gram is few rows.
* The dictionary holds each distinct phrase with its first position. Every
  later occurrence repeats as a whole.
* Of a gram with several distinct phrases, the dictionary's suffixes are
  compared as far as 100 bytes: first by the 66 bytes or more that any window
  has on one side of its trigger's middle, which leaves few, then suffix by
  suffix, sorted by a 96-bit hash of the 100 bytes and by the order of the
  parse. The first of each equal run is the earliest; the others repeat it.

Nothing is sampled or capped, every gram is treated alike, and no step holds a
group in memory. Whole phrases are equal if two 64-bit hashes are, suffixes if
96 bits are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, released, table

#: Fixed value of the query: bytes that have to be equal.
LENGTH = 100
#: Bytes of a trigger gram, and of text parsed at a time.
GRAM, CHUNK = 32, 1 << 20
POSITION_BITS = 24
#: Bytes that a window has after the start of its trigger, at least, if it counts as right-handed; others have a byte more before the trigger's end.
CORE = GRAM + (LENGTH - GRAM) // 2


def hashes(data):
    """Hash of the 32-byte gram at each position of a byte array."""
    import numpy as np

    table_ = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    h, size = table_[data], 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), 2 * size
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def phrases(data, starts, ends, length: int = LENGTH):
    """Phrases of the texts data[starts[i]:ends[i]]: (text, start, trigger's offset, windows, gram hash, content hash) arrays.

    ``data`` holds less than 2 ** POSITION_BITS bytes.
    """
    import numpy as np

    none = np.zeros(0, np.int64)
    sizes = np.maximum(ends - starts - length + 1, 0)
    if not sizes.sum():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, reach = 1, length - GRAM + 1  # lowest key over as many grams as a window has
    while 2 * span <= reach:
        key, span = np.minimum(key[: len(key) - span], key[span:]), 2 * span
    if span < reach:
        key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
    head = (key & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    heads = head[at]
    first = np.concatenate(([0], np.flatnonzero((heads[1:] != heads[:-1]) | (text[1:] != text[:-1])) + 1))
    windows = np.diff(np.concatenate((first, [len(heads)])))
    start, trigger, text = at[first], heads[first], text[first]
    size = windows - 1 + length
    content = (size * 256 + trigger - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(0, 2 * length, GRAM):  # grams that cover the phrase, the last ending with it
        place = np.minimum(k, size - GRAM)
        content = (content ^ (content >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB) + h[start + place]
    return text, start, trigger - start, windows, h[trigger], content ^ (content >> np.uint64(33))


def _chunks(texts: list[bytes], chunk: int, length: int):
    """(bytes, first texts' numbers, offsets in them, starts, ends): whole short texts together, long ones in overlapping parts."""
    held, number, offset, total = [], [], [], 0
    step = max(chunk, length)
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(1, len(t) - length + 1), step):
            part = t[at : at + step + length - 1]
            if total and total + len(part) > chunk:
                yield held, number, offset
                held, number, offset, total = [], [], [], 0
            held.append(part)
            number.append(i)
            offset.append(at)
            total += len(part)
    if held:
        yield held, number, offset


def _parse(batches):
    """(doc, check, text) batches -> phrases that may repeat: g, c, doc, check, loc, kind.

    kind 0: the only one of its gram in the batch; 1: one of several, and 2: the others.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        docs, checks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        out = [[] for _ in range(5)]
        for held, number, offset in _chunks([t.as_py() for t in batch.column(2)], CHUNK, LENGTH):
            sizes = np.array([len(x) for x in held])
            ends = np.cumsum(sizes)
            number, offset = np.array(number), np.array(offset)
            text, start, trigger, windows, g, c = phrases(np.frombuffer(b"".join(held), np.uint8), ends - sizes, ends)
            doc = number[text]
            loc = ((start - (ends - sizes)[text] + offset[text]) << 14) | (trigger << 7) | windows
            for x, y in zip(out, (g.view(np.int64), c.view(np.int64), docs[doc], checks[doc], loc)):
                x.append(y)
        if not out[0]:
            continue
        out = [np.concatenate(x) for x in out]
        g = out[0]
        order = np.argsort(g, kind="stable")
        again = g[order][1:] == g[order][:-1]
        kind = np.zeros(len(g), np.int8)
        kind[order[:-1][again]] = 1
        kind[order[1:][again]] = 2
        for at in range(0, len(g), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (*out, kind)], ["g", "c", "doc", "check", "loc", "kind"])


def _repeated(batches):
    """Rows in the order of g (kinds 0 and 1 with their equals) -> those whose gram repeats."""
    import numpy as np
    import pyarrow as pa

    names = ["g", "c", "doc", "check", "loc"]
    rows = lambda columns, of: pa.RecordBatch.from_arrays([pa.array(x[of]) for x in columns], names)
    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        other = now[5] == 2
        yield rows(now[:5], other)
        now = [x[~other] for x in now]
        if held is not None:  # the last row of the batch before, and whether it is known to repeat
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        same = now[0][1:] == now[0][:-1]
        ok = now[5] == 1
        ok[1:] |= same
        ok[:-1] |= same
        last = np.arange(len(ok)) == len(ok) - 1
        yield rows(now[:5], ok & ~last)
        held = [x[-1:] for x in now[:5]] + [ok[-1:].astype(np.int8)]
    if held is not None and held[5][0]:
        yield rows(held[:5], slice(None))


def _sides(batches):
    """(doc, check, text, phrases) -> (core, doc, check, at, content): the right- and left-handed windows of each phrase.

    ``core`` is a hash of the trigger and the half of a window's other bytes
    that all windows of this hand have; ``at`` is where ``content`` begins.
    """
    import pyarrow as pa
    from xxhash import xxh64_intdigest
    from zstandard import decompress

    half = CORE - GRAM
    types = [pa.int64()] * 4 + [pa.binary()]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["core", "doc", "check", "at", "content"])
    for batch in batches:
        out = [[] for _ in range(5)]
        docs, checks, found = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for doc, check, text, locs in zip(docs, checks, batch.column(2), found):
            text = decompress(text.as_py())
            for loc in locs:
                start = loc >> 14
                trigger, end = start + (loc >> 7 & 127), start + (loc & 127) - 1 + LENGTH
                cuts = []
                if end - trigger >= CORE:
                    cuts.append((max(start, trigger - half), end, text[trigger : trigger + CORE], 1))
                if trigger - start > half:
                    cuts.append((start, min(end, trigger + GRAM + half - 1), text[trigger - half - 1 : trigger + GRAM], 2))
                for low, high, core, hand in cuts:
                    for x, y in zip(out, (xxh64_intdigest(core, hand) - (1 << 63), doc, check, low, text[low:high])):
                        x.append(y)
            if len(out[0]) > 20_000:
                yield pack(out)
                out = [[] for _ in range(5)]
        yield pack(out)


def windows(data, length: int = LENGTH):
    """Two hashes of the ``length`` bytes at each position of a byte array."""
    import numpy as np

    seed = np.random.default_rng(78)
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        h, size, whole, done = seed.integers(1, 1 << 63, 256, dtype=np.uint64)[data], 1, None, 0
        n = max(0, len(data) - length + 1)
        while size <= length:
            if length & size:  # the bytes after those already taken, as many as this bit says
                part = h[done : done + n]
                whole = part if whole is None else whole * np.uint64(base) + part
                done += size
            if 2 * size <= length:
                h = h[: len(h) - size] * np.uint64(base) + h[size:]
            base, size = base * base % (1 << 64), 2 * size
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(whole ^ (whole >> np.uint64(29)))
    return out


def _suffixes(batches):
    """(doc, check, at, content) -> each window: k, m (its hash), doc, check, at, later.

    ``later``: an equal window of an earlier place is in the same batch.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for low in range(0, batch.num_rows, 5000):
            part = batch.slice(low, 5000)
            content = part.column(3).to_pylist()
            size = np.fromiter(map(len, content), np.int64, len(content))
            number = np.maximum(size - LENGTH + 1, 0)
            if not number.sum():
                continue
            row = np.repeat(np.arange(len(content)), number)
            k = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            where = (np.cumsum(size) - size)[row] + k
            a, b = (x[where] for x in windows(np.frombuffer(b"".join(content), np.uint8)))
            doc, check, at = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in range(3))
            at = at + k
            b = (b >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((at, doc, b, a))
            a, b, doc, check, at = a[order].view(np.int64), b[order], doc[order], check[order], at[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[first]) | (at != at[first])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, doc, check, at, later)], ["k", "m", "doc", "check", "at", "later"])


def _later(batches):
    """Rows in the order of k, m, doc, at -> windows with an equal one at an earlier place: doc, check, at."""
    import numpy as np
    import pyarrow as pa

    held = None  # hash and place of the first of the windows equal to the last one
    for batch in batches:
        a, b, doc, check, at, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if not len(a):
            continue
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        head_doc, head_at = doc[first], at[first]
        if held is not None and held[:2] == (a[0], b[0]):
            run = first == 0
            head_doc, head_at = np.where(run, held[2], head_doc), np.where(run, held[3], head_at)
        held = (a[-1], b[-1], head_doc[-1], head_at[-1])
        hit = known | (doc != head_doc) | (at != head_at)
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, check, at)], ["doc", "check", "at"])


def _packed(batches):
    """(..., text) -> the same with texts compressed, since they are shuffled whole."""
    import pyarrow as pa
    from zstandard import ZstdCompressor

    small = ZstdCompressor(1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([small(t.as_py()) for t in b.column(b.num_columns - 1)], pa.binary())], b.schema.names)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, doc, check and text as bytes; doc is the id, null ids first, null texts are empty.

    ``check`` tells texts of the same id apart; it is 0 for ids that occur once.
    """
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", lowest).alias("doc"), "text")
    twice = materialise(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("d")), "twice")
    if twice.isEmpty():
        return rows.select("doc_id", "doc", F.lit(0).cast("long").alias("check"), "text")
    rows = rows.join(twice, F.col("doc") == F.col("d"), "left")
    return rows.select("doc_id", "doc", F.when(F.col("d").isNull(), 0).otherwise(F.xxhash64("text")).cast("long").alias("check"), "text")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc, check, runs) of ``_marked`` rows; each run is start << 7 | windows: 100-byte windows that all start earlier as well."""
    start = lambda loc: F.shiftright(loc, 14)
    parse = rows.select("doc", "check", "text").mapInArrow(_parse, "g long, c long, doc long, check long, loc long, kind byte")
    dealt = F.when(F.col("kind") < 2, F.col("g")).otherwise(F.xxhash64("doc", "loc"))
    kept = parse.repartition(dealt).sortWithinPartitions("g").mapInArrow(_repeated, "g long, c long, doc long, check long, loc long")
    kept = materialise(kept, "phrases")
    dictionary = kept.groupBy("g", "c").agg(F.min(F.struct("doc", "loc", "check")).alias("first"))
    dictionary = materialise(dictionary.select("g", "c", "first.doc", "first.check", "first.loc"), "dictionary")
    earliest = dictionary.select("g", "c", F.col("doc").alias("d"), F.col("loc").alias("l"))
    later = kept.join(earliest, ["g", "c"]).where(F.struct("doc", start(F.col("loc"))) > F.struct("d", start(F.col("l"))))
    later = materialise(later.select("doc", "check", start(F.col("loc")).alias("start"), F.col("loc").bitwiseAND(F.lit(127)).alias("windows")), "later")
    released(kept)
    # Written first, so that a trigger of very many phrases is a skewed join that Spark can split.
    several = materialise(dictionary.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "several")
    lists = dictionary.join(several, "g").groupBy(F.col("doc").alias("d"), F.col("check").alias("k")).agg(F.collect_list("loc").alias("found"))
    texts = rows.select("doc", "check", "text").mapInArrow(_packed, "doc long, check long, text binary")
    texts = texts.join(lists, (F.col("doc") == F.col("d")) & (F.col("check") == F.col("k"))).select("doc", "check", "text", "found")
    sides = materialise(texts.mapInArrow(_sides, "core long, doc long, check long, at long, content binary"), "sides")
    released(dictionary)
    released(several)
    shared = materialise(sides.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "shared")
    suffixes = sides.join(shared, "core").select("doc", "check", "at", "content").mapInArrow(_suffixes, "k long, m long, doc long, check long, at long, later boolean")
    dealt = F.when(F.col("later"), F.xxhash64("doc", "at")).otherwise(F.col("k"))
    suffixes = suffixes.repartition(dealt).sortWithinPartitions("k", "m", "doc", "at")
    hits = materialise(suffixes.mapInArrow(_later, "doc long, check long, at long"), "hits")
    released(sides)
    released(shared)
    runs = later.union(hits.select("doc", "check", "at", F.lit(1)))
    runs = runs.groupBy("doc", "check").agg(F.collect_list(F.shiftleft("start", 7).bitwiseOR(F.col("windows").cast("long"))).alias("runs"))
    runs = materialise(runs, "runs")
    released(later)
    released(hits)
    return runs


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text), one row for each row of ``docs``; ``kept_text`` is binary.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Places are
    compared by id, then by start, null ids first: rows of the same id and text
    repeat nothing of one another and are treated alike, rows of the same id and
    other text are compared by their starts. Null texts are empty. An empty table
    gives no rows. A text's memory is itself and 1 MiB parts of it.
    """
    rows = _marked(docs)
    runs = repeated_runs(rows).toDF("d", "k", "runs")
    texts = rows.mapInArrow(_packed, "doc_id long, doc long, check long, text binary")
    texts = texts.join(runs, (F.col("doc") == F.col("d")) & (F.col("check") == F.col("k")), "left").select("doc_id", "text", "runs")

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from zstandard import decompress

        types = [pa.int64()] * 3 + [pa.binary()]
        pack = lambda ids, out: pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"])
        for batch in batches:
            out, low, size = [[], [], [], []], 0, 0
            for i, (text, found) in enumerate(zip(batch.column(1), batch.column(2))):
                text = decompress(text.as_py())
                kept, at, n = [], 0, 0
                if found.is_valid:
                    x = np.unique(found.values.to_numpy())
                    begin, end = x >> 7, np.maximum.accumulate((x >> 7) + (x & 127) + LENGTH - 1)
                    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
                    n = len(new)
                    for a, b in zip(begin[new].tolist(), end[np.concatenate((new[1:] - 1, [len(x) - 1]))].tolist()):
                        kept.append(text[at:a])
                        at = b
                kept.append(text[at:])
                kept = b"".join(kept)
                for x, y in zip(out, (len(text), len(text) - len(kept), n, kept)):
                    x.append(y)
                size += len(kept)
                if size > 1 << 24:
                    yield pack(batch.column(0).slice(low, i + 1 - low), out)
                    out, low, size = [[], [], [], []], i + 1, 0
            yield pack(batch.column(0).slice(low), out)

    return texts.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
