"""Seen-id index of a stream: which keys earlier micro-batches have stored.

Two narrow tables under one folder, both dealt to ``buckets`` by key hash:

- ``ids``: (key, tag), the keys themselves;
- ``filters``: blocked Bloom filters, rows of 32768 bits that hold the marks of
  about ``PER_BLOCK`` keys of one bucket and one tag.

A micro-batch reads the filters of the buckets that its keys fall into, and the
ids of only those buckets where a filter answers "maybe"; ids decide.  What a
batch reads so follows its own keys, not the length of the history: use as many
buckets as keep a bucket's ids at a file's size (a power of two; fixed for an
index).

Both tables are sets that are only added to, under the tag of the batch that
adds.  A batch that runs again ignores what its own tag has written, so a retry
after any failure decides as the first try did.  ``compact`` merges ``FANIN``
small pieces of a level into one of the next, as often as needed, so a bucket
has few files on each of logarithmically many levels; a crash in between leaves
keys twice, which changes nothing.

Filters are built and asked with built-in bitmap functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys per Bloom block of 32768 bits: 12 bits a key.
PER_BLOCK = 2730
BLOCK_BITS = 32768
#: Marks of a key; with 12 bits a key one in 300 new keys is taken for seen and looked up.
MARKS = 6
#: Pieces of one level that are merged into one of the next.
FANIN = 8
#: Buckets of an index.
BUCKETS = 64

_IDS = "key string, tag string, level int, bucket int"
_FILTERS = "tag string, blocks int, block int, bits binary, level int, bucket int"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).cast("int")


def block_of(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), key), F.col(blocks)).cast("int")


def marks_of(key: str) -> list[Column]:
    """Places of a key's marks in its block (from 0)."""
    return [F.pmod(F.xxhash64(F.lit(10 + i), key), F.lit(BLOCK_BITS)).cast("int") for i in range(MARKS)]


def has_mark(bits: str, place: Column) -> Column:
    """Bit ``place`` of a bitmap made by ``bitmap_construct_agg``."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


class SeenIds:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/ids"))

    def _read(self, table: str, buckets: list[int] | None = None, level: str = "*") -> DataFrame:
        """A table's rows, of all buckets or of those named: their folders alone are listed and read."""
        schema, root = {"ids": _IDS, "filters": _FILTERS}[table], f"{self.path}/{table}"
        which = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
        found = self._fs.globStatus(self._path(f"{root}/level={level}/bucket={which}")) if buckets is None or buckets else None
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f.getPath().toString() for f in found])

    def _put(self, keys: DataFrame, tag: str, level: int) -> None:
        """Append distinct ``keys`` (key, bucket) and their filters."""
        keys = keys.select("key", "bucket").distinct().repartition("bucket").persist()
        try:
            row = [F.lit(tag).alias("tag"), F.lit(level).alias("level")]
            keys.select("key", "bucket", *row).write.mode("append").partitionBy("level", "bucket").parquet(f"{self.path}/ids")
            sizes = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_BLOCK)).cast("int").alias("blocks"))
            marked = keys.join(sizes, "bucket").select("bucket", "blocks", block_of("key", "blocks").alias("block"), F.explode(F.array(*marks_of("key"))).alias("place"))
            bits = marked.groupBy("bucket", "blocks", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
            bits.select("blocks", "block", "bits", "bucket", *row).repartition("bucket").write.mode("append").partitionBy("level", "bucket").parquet(f"{self.path}/filters")
        finally:
            keys.unpersist()

    def add(self, keys: DataFrame, tag: str) -> None:
        """Store the keys (column ``key``) of a finished batch."""
        self._put(keys.where(F.col("key").isNotNull()).withColumn("bucket", bucket_of("key", self.buckets)), tag, 0)

    def maybe(self, keys: DataFrame, tag: str) -> DataFrame:
        """Keys (key, bucket) that some filter of another tag may hold: all that
        are stored, and few others."""
        touched = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())  # as many as buckets at most
        filters = self._read("filters", touched).where(F.col("tag") != tag)
        sizes = filters.select("bucket", "tag", "level", "blocks").distinct()
        asked = keys.join(sizes, "bucket").withColumn("block", block_of("key", "blocks"))
        found = asked.join(filters, ["bucket", "tag", "level", "blocks", "block"])
        return found.where(reduce(lambda a, b: a & b, [has_mark("bits", m) for m in marks_of("key")])).select("key", "bucket").distinct()

    def seen(self, keys: DataFrame, tag: str) -> DataFrame:
        """The distinct keys among ``keys`` (column ``key``) that batches of
        other tags have stored."""
        if not self.exists():
            return keys.select("key").limit(0)
        keys = keys.where(F.col("key").isNotNull()).select("key").distinct().withColumn("bucket", bucket_of("key", self.buckets))
        likely = self.maybe(keys, tag).persist()
        try:
            hit = sorted(r["bucket"] for r in likely.select("bucket").distinct().collect())
            stored = self._read("ids", hit).where(F.col("tag") != tag)
            return likely.join(stored, ["bucket", "key"], "left_semi").select("key").checkpoint(eager=True)
        finally:
            likely.unpersist()

    def compact(self) -> None:
        """Merge levels that have ``FANIN`` pieces or more."""
        level = 0
        while self._fs.exists(self._path(f"{self.path}/ids/level={level}")):
            pieces = self._read("filters", level=str(level)).agg(F.count_distinct("tag").alias("n")).first()["n"]
            if pieces >= FANIN:
                here = self._read("ids", level=str(level))
                last = here.agg(F.max("tag")).first()[0]
                self._put(here, f"{last}+{level + 1}", level + 1)
                for table in ("ids", "filters"):
                    self._fs.delete(self._path(f"{self.path}/{table}/level={level}"), True)
            level += 1
