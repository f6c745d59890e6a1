"""Merkle manifest of a document table, with nested-interval labels.

Every source is a tree over its documents in the order of their ids, and one
more tree stands over the sources.  A node carries the interval [lo, hi) of the
leaf ranks that it covers, so

- an ancestor of a leaf is a node whose interval contains the leaf's rank;
- the siblings of a node are what is left of its parent's interval without its
  own: the nodes of its level in [parent lo, lo) and [hi, parent hi).

Levels are handled in bands of ``BAND``.  A band deals its rows to buckets of
``FAN ** BAND`` neighbouring nodes; a bucket's rows meet the nodes above them
there (a containment join on sorted interval ends), and only a bucket's top
node goes on to the next band.  So a leaf is shuffled twice however high the
tree is, the bands above are smaller by ``FAN ** BAND`` each, and no task holds
more than one bucket and the path above it.  Ranks come from positions in a
range-dealt order; a hot source is dealt like any other rows.

Defined cases: NULL in any column is the field ``-``; documents without a
source are a tree of their own, before all others; ids that are NULL come
first, and rows of one id are ordered by their leaf hash (equal rows are
interchangeable); a source of one document has its leaf as root; empty and
long texts are hashed whole; further columns play no part; an empty table has
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import crc_rest, materialise, positions

#: Nodes under one parent.
FAN = 3
#: Levels that are built and attached together.
BAND = 6
WIDTH = FAN**BAND

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODES = "tree string, n bigint, level int, lo bigint, hi bigint, hash string"
_STEPS = "left array<string>, right array<string>"


def digest(*parts: F.Column) -> F.Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(columns: dict[str, F.Column] | None = None) -> F.Column:
    """SHA-256 of a document's fields; ``columns`` replaces some of them."""
    parts = []
    for name in FIELDS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels, covered = 0, 1
    while covered < n:
        levels, covered = levels + 1, covered * FAN
    return levels


def _bucket(group: pa.Table, base: str) -> tuple[str, int, int, np.ndarray]:
    return group.column("tree")[0].as_py(), group.column("n")[0].as_py(), group.column(base)[0].as_py(), group.column("lo").to_numpy()


def build_band(members: DataFrame, band: int) -> DataFrame:
    """All nodes of the levels of one band, from ``members`` (tree, n, lo, hi,
    hash): the nodes of the level below, or the leaves.  A tree of one leaf has
    it as node of level 0."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("lo")
        tree, n, _, lo = _bucket(group, "lo")
        hi, names = group.column("hi").to_numpy(), group.column("hash").to_pylist()
        top = height(n)
        made = [(0, lo, hi, names)] if not top else []
        for level in range(band * BAND + 1, min(top, (band + 1) * BAND) + 1):
            ends = [*range(FAN, len(names), FAN), len(names)]
            names = [hashlib.sha256("".join(names[a:b]).encode()).hexdigest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            lo, hi = lo[::FAN], hi[np.array(ends) - 1]
            made.append((level, lo, hi, names))
        size = [len(m[1]) for m in made]
        return pa.table(
            {
                "tree": [tree] * sum(size),
                "n": pa.array([n] * sum(size), pa.int64()),
                "level": pa.array(np.repeat([m[0] for m in made], size), pa.int32()),
                "lo": np.concatenate([m[1] for m in made]),
                "hi": np.concatenate([m[2] for m in made]),
                "hash": [x for m in made for x in m[3]],
            }
        )

    return members.withColumn("bucket", bucket(band)).groupBy("tree", "bucket").applyInArrow(build, _NODES)


def bucket(band: int) -> F.Column:
    """The bucket of a node of the band, by its interval's start."""
    return F.floor(F.col("lo") / F.lit(WIDTH ** (band + 1))).cast("bigint")


def build_nodes(leaves: DataFrame) -> list[DataFrame]:
    """The nodes above ``leaves`` (tree, n, lo, hi, hash), a table per band."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    bands, below = [], leaves
    for band in range(max(1, -(-height(largest) // BAND))):
        bands.append(materialise(build_band(below, band)))
        below = bands[-1].filter((F.col("level") == (band + 1) * BAND) & (F.col("hi") - F.col("lo") < F.col("n")))
    return bands


def roots(bands: list[DataFrame]) -> DataFrame:
    """(tree, hash) of every tree's top node."""
    tops = [b.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).groupBy("tree").agg(F.max_by("hash", "level").alias("hash"), F.max("level").alias("level")) for b in bands]
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return every.groupBy("tree").agg(F.max_by("hash", "level").alias("hash"))


def attach(leaves: DataFrame, bands: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """``leaves`` with their proofs: ``left`` and ``right`` hold, level by level
    up to the top, the joined hashes of the siblings on either side.  ``tops``
    (tree, left, right, subroot, root) says what stands above each tree."""
    last = len(bands) - 1
    for band in range(last, -1, -1):
        top = height_column()
        here = bands[band].withColumn("up", F.col("level") == F.least(top, F.lit((band + 1) * BAND)))
        ends = here.filter("up").select("tree", "n", "lo", top.alias("top"))
        over = ends.filter(F.col("top") <= (band + 1) * BAND).join(tops, "tree").select("tree", "lo", "left", "right", "subroot", "root")
        if band < last:
            over = over.unionByName(above)  # noqa: F821 - set by the band above
        over = over.withColumnRenamed("left", "over_left").withColumnRenamed("right", "over_right")
        # A bucket's top node brings along what stands above it.
        known = here.filter("not up").select("tree", "level", "lo", "hi", "hash").withColumns({c: F.lit(None).cast(t) for c, t in over.dtypes if c not in ("tree", "lo")})
        tip = here.filter("up").select("tree", "level", "lo", "hi", "hash").join(over, ["tree", "lo"])
        nodes = known.unionByName(tip).withColumn("bucket", bucket(band))
        if band:
            below = bands[band - 1].filter((F.col("level") == band * BAND) & (F.col("hi") - F.col("lo") < F.col("n"))).select("tree", "lo", "hi", "hash")
            above = materialise(_contain(below, nodes, band, [])).select("tree", "lo", "left", "right", "subroot", "root")
        else:
            return _contain(leaves, nodes, 0, carried)
    raise AssertionError


def height_column() -> F.Column:
    """``height`` of the column ``n``."""
    covered = [FAN**k for k in range(40)]
    return F.size(F.filter(F.array(*[F.lit(c).cast("decimal(20,0)") for c in covered]), lambda c: c < F.col("n"))).cast("int")


def _contain(members: DataFrame, nodes: DataFrame, band: int, carried: list[str]) -> DataFrame:
    """Attach the nodes of one band to ``members`` (tree, lo, hi, hash)."""
    kinds = dict(members.dtypes)
    schema = f"tree string, lo bigint, {''.join(f'{c} {kinds[c]}, ' for c in carried)}{_STEPS}, subroot string, root string"

    def join(mine: pa.Table, over: pa.Table) -> pa.Table:
        mine, over = mine.sort_by("lo"), over.sort_by([("level", "ascending"), ("lo", "ascending")])
        rank = mine.column("lo").to_numpy()
        level, lo, hi, names = over.column("level").to_numpy(), over.column("lo").to_numpy(), over.column("hi").to_numpy(), over.column("hash").to_pylist()
        tip = int(np.argmax(level)) if len(level) else 0
        kept_left, kept_right = over.column("over_left")[tip].as_py(), over.column("over_right")[tip].as_py()
        left: list[list[str]] = [[] for _ in rank]
        right: list[list[str]] = [[] for _ in rank]
        child_lo, child_hi, child = rank, mine.column("hi").to_numpy(), mine.column("hash").to_pylist()
        for k in [x for x in np.unique(level) if x > band * BAND]:
            at = np.flatnonzero(level == k)
            # The child and the parent whose intervals contain the rank; what the parent has besides the child are its siblings.
            own = np.searchsorted(child_lo, rank, "right") - 1
            parent = at[np.searchsorted(lo[at], rank, "right") - 1]
            start, end = np.searchsorted(child_lo, lo[parent], "left"), np.searchsorted(child_hi, hi[parent], "right")
            for i, (a, x, b) in enumerate(zip(start.tolist(), own.tolist(), end.tolist(), strict=True)):
                left[i].append("".join(child[a:x]))
                right[i].append("".join(child[x + 1 : b]))
            child_lo, child_hi, child = lo[at], hi[at], [names[i] for i in at]
        rows = len(rank)
        out = {"tree": mine.column("tree"), "lo": mine.column("lo")} | {c: mine.column(c) for c in carried}
        out |= {"left": pa.array([x + kept_left for x in left], pa.list_(pa.string())), "right": pa.array([x + kept_right for x in right], pa.list_(pa.string()))}
        return pa.table(out | {c: pa.array([over.column(c)[tip].as_py()] * rows, pa.string()) for c in ("subroot", "root")})

    keys = ["tree", "bucket"]
    return members.withColumn("bucket", bucket(band)).groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(join, schema)


def ranked(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` (with ``tree``) and n, lo, hi: the size of the row's tree and
    its leaf's interval, by ``order`` within the tree."""
    placed = positions(df, ["tree", *order], columns)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    lo = F.col("_pos") - F.col("_first")
    return placed.join(sizes, "tree").select(*columns, "n", lo.alias("lo"), (lo + 1).alias("hi"))


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of all rows of ``leaves`` (source, doc_id, leaf, and columns that
    are carried along): subroot, root, and the sibling hashes ``left`` and
    ``right`` of every level from the leaf through the subroot to the root."""
    carried = [c for c in leaves.columns if c not in ("source", "leaf")]
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree")  # "-" sorts before "="
    rows = materialise(leaves.select(tree, F.col("leaf").alias("hash"), *carried))
    placed = materialise(ranked(rows, ["doc_id", "hash"], ["tree", "hash", *carried]))
    bands = build_nodes(placed)
    tops = materialise(roots(bands).select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "hash"))
    above = materialise(ranked(tops, ["source_tree"], ["tree", "source_tree", "hash"]))
    over = build_nodes(above)
    none = F.array().cast("array<string>")
    crown = roots(over).select("tree", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    sources = attach(above.withColumn("own", F.col("hash")), over, crown, ["source_tree", "own"])
    sources = materialise(sources.select(F.col("source_tree").alias("tree"), "left", "right", F.col("own").alias("subroot"), "root"))
    proved = attach(placed.withColumn("leaf", F.col("hash")), bands, sources, ["leaf", *carried])
    return proved.select(*carried, "leaf", "subroot", "root", "left", "right")


def proof_digest(left: str = "left", right: str = "right") -> F.Column:
    """SHA-256 of all sibling hashes, level by level, left to right."""
    return digest(F.array_join(F.transform(left, lambda x, i: F.concat(x, F.get(right, i))), ""))


def fold(leaf: str, left: str = "left", right: str = "right") -> F.Column:
    """The root that a leaf hash and a proof give."""
    steps = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    return F.aggregate(steps, F.col(leaf), lambda h, s: digest(s["l"], h, s["r"]))


def check_documents(docs: DataFrame) -> DataFrame:
    """Manifest digests of ``documents`` rows, with every other document (by
    the crc of its id) verified after its line feeds were deleted."""
    docs = docs.select(*FIELDS)
    changed = F.when(F.coalesce(crc_rest("doc_id", 2) == 0, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("source", "doc_id", leaf_hash().alias("leaf"), leaf_hash({"text": changed}).alias("found"))
    proved = manifest(leaves)
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold("found").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
