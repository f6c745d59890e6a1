"""Sharding by a hypergeometric communication matrix.

A uniform random shuffle of N rows into S shards of exact sizes, without ever
ordering all rows: if P source partitions hold n_1..n_P rows, the number of
rows that partition p sends to shard s under a uniform permutation follows a
multivariate hypergeometric law.  So

1. count the rows of each source partition (one small aggregate),
2. draw the P x S matrix of counts exactly (``communication_matrix``),
3. permute each partition's rows locally and cut them by its matrix row,
4. exchange by shard and permute again within the shard.

Shard sizes differ by one row at most (law ``rows``), whatever the input looks
like; a hot source, a hot text or copies do not matter, as a row's place
depends on its position in a random order only.  The random orders are keyed
hashes of (seed, doc_id), so a task that runs again after an executor loss
gives the same rows.

All work on rows is DataFrame operations.  The driver holds the P row counts
and the P x S matrix (P is a parameter, not a function of the data).
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
#: Source partitions of the matrix.
PARTITIONS = 256
#: Rows of a shard that are ordered together (a shard is ordered by this many ranges of its keyed hash).
ORDERED_ROWS = 200_000


def draw_hypergeometric(rng: random.Random, good: int, bad: int, taken: int) -> int:
    """Number of good items among ``taken`` of ``good + bad``, drawn by
    inversion outwards from the mode (steps grow with the deviation only)."""
    low, high = max(0, taken - bad), min(taken, good)
    if low == high:
        return low
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def ln_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    at_mode = math.exp(ln_choose(good, mode) + ln_choose(bad, taken - mode) - ln_choose(good + bad, taken))
    left = rng.random() - at_mode
    if left <= 0:
        return mode
    down = up = at_mode
    i = j = mode
    while i > low or j < high:
        if j < high:
            up *= (good - j) * (taken - j) / ((j + 1) * (bad - taken + j + 1))
            j += 1
            left -= up
            if left <= 0:
                return j
        if i > low:
            down *= i * (bad - taken + i) / ((good - i + 1) * (taken - i + 1))
            i -= 1
            left -= down
            if left <= 0:
                return i
    return mode  # the rounding error of the sums


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row p, column s: rows from partition p to shard s under a uniform
    shuffle; row sums are ``counts``, column sums differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        rest, row = sum(room), []
        for s in range(shards):
            x = draw_hypergeometric(rng, room[s], rest - room[s], n)
            rest -= room[s]
            n -= x
            row.append(x)
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, id_col: str, shards: int = SHARDS, partitions: int = PARTITIONS, seed: int = 17) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in the shard).

    ``id_col`` should name rows; NULL ids and repeated rows take part like
    all others (ties in the random order fall to the row's other columns'
    hash, and rows that are equal in everything are interchangeable).  An
    empty table gives no rows.  Existing columns ``shard`` and ``slot`` are
    replaced.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*rest)
    hashable = [F.col(f"`{c}`") for c, t in df.dtypes if c != id_col and "map" not in t and "variant" not in t]
    tie = F.xxhash64(F.lit(0), *hashable)
    keyed = df.withColumns(
        {"_tie": tie, "_first": F.xxhash64(F.lit(seed), F.col(id_col), tie), "_second": F.xxhash64(F.lit(seed + 1), F.col(id_col), tie)}
    ).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col("_tie")), F.lit(partitions)).cast("int"))
    found = {r["_part"]: r["n"] for r in keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `partitions` rows
    counts = [found.get(p, 0) for p in range(partitions)]
    matrix = communication_matrix(counts, shards, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    cells = df.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps([{"_part": p, "_ends": e} for p, e in enumerate(ends)])), "array<struct<_part:int,_ends:array<bigint>>>"))
    )
    # Local permutation: a row's rank in its partition's random order picks the shard.
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_first", id_col, "_tie")).cast("long"))
    sent = ranked.join(F.broadcast(cells), "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
    # Second permutation: each shard is ordered by ranges of the second hash; the range sizes give the offsets.
    ranges = max(1, -(-sum(counts) // (shards * ORDERED_ROWS)))
    spread = F.shiftright(F.shiftrightunsigned("_second", 33) * F.lit(ranges), 31).cast("int")
    sent = sent.withColumn("_range", spread if ranges > 1 else F.lit(0))
    order = Window.partitionBy("shard", "_range").orderBy("_second", id_col, "_tie")
    if ranges == 1:
        placed = sent.withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    else:
        sizes = sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))  # shards * ranges rows
        starts = sizes.withColumn(
            "_start", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).drop("_n")
        placed = sent.withColumn("_row", F.row_number().over(order) - 1).join(starts, ["shard", "_range"]).withColumn("slot", (F.col("_row") + F.col("_start")).cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in rest], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Digest rows of all documents under the law ``rows`` (text NULL: no bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    return shuffle_into_shards(digest, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
