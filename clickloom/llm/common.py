"""Helpers shared by the text operators.

Texts reach Python tasks as Arrow batches.  The functions here work on the
bytes of a whole batch at once (numpy), never on one word at a time.

Words are the matches of ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes; all six
separators are ASCII, so byte and character matching agree.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.session import ensure_checkpoint_dir

U64 = np.uint64
#: Bytes of text that one numpy pass works on (a longer text is one pass of its own).
CHUNK_BYTES = 1 << 21
#: Rows of an Arrow batch: bounds a Python worker's memory with long texts.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder, read by Spark only."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Planning fails where a union's sides keep partitionings of different sizes (seen on empty parts under AQE).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files (and, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, the
    checkpoints) of finished steps.  It does so once the driver's garbage is
    collected; until then they lie on the executors' disks.  For operators of
    many steps, between two of them; what is lost can be computed again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Size of a plan's input as Spark's own statistics give it (file sizes
    for a table scan), or a kilobyte a row where they know nothing; used to
    choose shard counts, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 1024 * df.count()


def shard_count(df: DataFrame, bytes_per_shard: int, least: int = 4) -> int:
    return max(least, -(-input_bytes(df) // bytes_per_shard))


def positions(df: DataFrame, order: list, columns: list) -> DataFrame:
    """``columns`` of ``df`` and ``_pos``: a row's place, from 0, in the order
    of all rows by ``order`` (any among equal rows).  Rows are dealt by ranges
    of the order, with a running number behind it, so neither a hot key nor a
    row repeated without end meets in one task.  ``df`` is read twice (ranges
    are sampled) and should be a table; the result is a written one."""
    tie = F.monotonically_increasing_id()
    dealt = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    held = materialise(dealt.select(*columns, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftrightunsigned("_at", 33).cast("int").alias("_part")  # the number of the partition stands above its rows' numbers
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as partitions, here and below
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.withColumn("_part", part).join(F.broadcast(sizes.select("_part", first.alias("_first"))), "_part")
    return placed.withColumn("_pos", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_at")


# ---------------------------------------------------------------- buffers


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive parts of a column."""
    buf, off = text_buffer(arr)
    for i, j in slices(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


# ------------------------------------------------------------------ words

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row its first word's index
    (one entry more than rows)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[buf]
    cut = np.ones(n + 1, bool)  # a word may start here: after a separator or at a row's start
    cut[1:n] = ~inside[:-1]
    cut[off] = True
    starts = np.flatnonzero(inside & cut[:-1])
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    stop[off[1:][off[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


# ----------------------------------------------------------------- hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = max(CHUNK_BYTES + 1, n)
    if size > CHUNK_BYTES + 1 or size not in _powers:
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > CHUNK_BYTES + 1:
            return pair
        _powers[size] = pair
    return _powers[size]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of 64-bit symbols: one running
    sum of symbol * base**i, taken back to the span's start."""
    up, down = powers(len(symbols) + 1)
    run = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * up[: len(symbols)], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes((_BYTE[LOWER] if lower else _BYTE)[buf], starts, ends)


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` consecutive words of one row, and for
    each row its first run's index (one entry more than rows)."""
    count = np.maximum(np.diff(first) - (width - 1), 0)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], count)
    return (span_hashes(words, at, at + width) if len(at) else np.zeros(0, U64)), out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_rest(col: str, modulus: int) -> F.Column:
    """crc32 of a number written as text, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
