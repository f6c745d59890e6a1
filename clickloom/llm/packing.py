"""Best-two-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length are
interchangeable and a packing is known once it says how many sequences use
which lengths.  The plan therefore works on the table of counts by length (at
most ``capacity`` rows, however many documents there are):

1. fill a sequence greedily with the longest documents that still fit;
2. while a gap is left, take out its shortest document and put two unpacked
   ones into the expanded gap if they fill it more tightly;
3. use the same filling as often as the counts allow, then go on.

Documents find their sequence by their number among those of their length.
The numbering is a window per (length, salt) plus the offsets of the salts, so
a length that holds most documents is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.bpe import PieceEncoder
from clickloom.llm.common import materialise

CAPACITY = 1024
SALTS = 64


def best_two(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, int]:
    """The two unpacked documents of the largest joint length within ``room``."""
    best, pair, i, j = 0, (0, 0), 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room or (i == j and counts[a] < 2):
            j -= 1
            continue
        if a + b > best:
            best, pair = a + b, (b, a)
        i += 1
    return pair


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths in one sequence, number of such sequences)] for all documents
    counted in ``histogram`` (length from 1 to capacity -> documents)."""
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    out = []
    while left:
        free, lengths, filled, gap = dict(left), list(left), [], capacity
        while True:
            at = int(np.searchsorted(lengths, gap, "right")) - 1
            if at < 0:
                break
            n = lengths[at]
            filled.append(n)
            gap -= n
            free[n] -= 1
            if not free[n]:
                del lengths[at]
        while gap and len(lengths):
            least = filled[-1]  # greedy filling goes downwards, and the pairs below are sorted in
            a, b = best_two(lengths, free, gap + least)
            if a + b <= least:
                break
            filled = sorted([*filled[:-1], a, b], reverse=True)
            gap += least - a - b
            for n, d in ((a, -1), (b, -1), (least, 1)):
                free[n] += d
            lengths = [n for n, c in free.items() if c]
        uses = Counter(filled)
        times = min(left[n] // c for n, c in uses.items())
        out.append((filled, times))
        for n, c in uses.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` (long) and ``offset`` (long, gapless from 0 in the
    sequence) to rows with a ``length`` of 1 to ``capacity``; ``keys`` name a
    row.  An empty table gives no rows.  ``pieces`` is read three times and
    should be a written table."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # capacity * SALTS rows at most
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("length", "_salt").orderBy(*keys)
    numbered = salted.withColumn("_row", F.row_number().over(own) - 1).join(starts, ["length", "_salt"])
    numbered = numbered.withColumn("_index", (F.col("_row") + F.col("_start")).cast("long")).select(*pieces.columns, "_index")

    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    taken, sequence = Counter(), 0
    for filled, times in plan(histogram, capacity):
        offsets: dict[int, list[int]] = {}
        for n, at in zip(filled, np.cumsum([0, *filled[:-1]]).tolist(), strict=True):
            offsets.setdefault(n, []).append(at)
        for n, ats in offsets.items():
            slots.setdefault(n, []).append((taken[n], len(ats), sequence, ats))
            taken[n] += len(ats) * times
        sequence += times
    table = {n: (np.array([s[0] for s in rows]), rows) for n, rows in slots.items()}

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceEncoder._made.clear()  # a worker that has cut documents before keeps no encoder while it places them
        for part in parts:
            found, offset = [], []
            for n, index in zip(part.column("length").to_pylist(), part.column("_index").to_pylist(), strict=True):
                firsts, rows = table[n]
                first, uses, base, ats = rows[int(np.searchsorted(firsts, index, "right")) - 1]
                found.append(base + (index - first) // uses)
                offset.append(ats[(index - first) % uses])
            kept = part.select([c for c in part.schema.names if c != "_index"])
            yield kept.append_column("sequence_id", pa.array(found, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def cut_documents(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of all texts: the ids and ``end_id``; longer documents are
    cut into pieces of ``capacity``, the first of which may be shorter.  Text
    NULL or empty gives the end id alone."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path, pattern)
        for part in parts:
            docs, rows = part.column("doc_id").to_pylist(), []
            for row, ids in encoder.encode(part.column("text")):
                raw, n = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little"), len(ids) + 1
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((docs[row], k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), raw[4 * a : 4 * b])[: len(out)])
            columns = list(zip(*rows, strict=True)) or [[]] * len(out)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(build, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut and pack all documents; one row per piece."""
    pieces = materialise(cut_documents(docs, path, pattern, end_id, capacity, with_ids))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
