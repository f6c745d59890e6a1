"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  Its name is (depth, 128 bits):
the exclusive-or of a hash of (place, role, text) of each of its turns, so
names of all prefixes are running values and a parent's name is the child's
without its last term.  Nodes are rows with their smallest member and counts;
texts are read once, for their hash and length.

Sums over subtrees do not walk the trie.  The Euler tour enters and leaves each
node once: ``enter`` goes on to the first child (or the node's own ``exit``),
``exit`` to the next sibling's ``enter`` (or the parent's ``exit``).  The tour
is a linked list of two arcs a node, and is ranked in three steps:

1. arcs of neighbouring conversations and depths lie in one block, which ranks
   its own chains; a chain goes on as one item (its length as weight);
2. of the items left, one in ``RULER`` becomes a ruler; all others jump, twice
   as far each round, until they stand on a ruler (rounds grow with the
   logarithm of the longest gap);
3. the rulers are a list of the same kind, ranked in the same way until a list
   of at most ``SMALL`` items is left, which one task ranks.

With positions known, running sums of leaves and savings over the tour (blocks
of positions and carries) give a subtree's sums as the difference between a
node's two arcs.

A conversation that holds most turns is dealt like other rows (positions by
range, running names by blocks of depths, chains by blocks), a node with most
conversations as members is counted by partial aggregates, and its members'
ids are hashed as a stream of joined ranges, never held as one list.

Defined cases: turns are ordered by (turn, role, text), NULL turns first, NULL
role or text is empty; rows that repeat are turns of their own; rows without a
conv_id belong to no conversation; texts of any length count whole; further
columns play no part; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import crc_rest, materialise, positions

#: Depths whose running names one task computes.
DEPTHS = 4096
#: Arcs of 2**8 conversation ids and 2**11 depths are one block.
CONV_BITS, DEPTH_BITS = 8, 11
#: One item in so many is a ruler.
RULER = 16
#: Items that one task ranks.
SMALL = 10_000
#: Positions of a block of running sums.
SUM_BITS = 12
#: Ids that are joined into one text before a node's ids are hashed: 2**10.
ID_BITS = 10
#: Turns that a conversation may take from its group's first, and conversations of a group.
SHARED, GROUP = 6, 100


# ------------------------------------------------------------ conversations


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 0, a, b, chars) of all turns; a and b are hashes."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role, text)
    facts = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("bigint").alias("chars")]
    placed = positions(turns, ["conv_id", "turn", "role", "text"], ["conv_id", *facts])
    first = placed.groupBy("conv_id").agg(F.min("_pos").alias("_first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("_pos") - F.col("_first")).alias("rank"), "a", "b", "chars")


def share_first_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns are those of the group's first
    conversation, h = crc32(conv_id) % SHARED.  Returns their turns (conv_id,
    depth from 1, a, b, chars) and (conv_id, length) of all, turnless ones too."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = crc_rest("conv_id", SHARED).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", "n", h, base).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = turns.join(convs, "conv_id").filter("rank >= h").select("conv_id", (F.col("taken") + F.col("rank") - F.col("h") + 1).alias("depth"), "a", "b", "chars")
    # At most SHARED - 1 turns, for at most GROUP conversations.
    lent = turns.filter((F.col("rank") < SHARED - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(lent, "base").filter("rank < h").select("conv_id", (F.col("rank") + 1).alias("depth"), "a", "b", "chars")
    return own.unionByName(first), convs.select("conv_id", "length")


def name_prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, a, b, chars) with the names (x, y) of the
    prefix that ends there and (px, py) of its parent."""
    turns = turns.select(
        "conv_id", "depth", "chars", F.floor((F.col("depth") - 1) / F.lit(DEPTHS)).alias("block"),
        F.xxhash64(F.lit(11), "depth", "a", "b").alias("s"), F.xxhash64(F.lit(12), "depth", "b", "a").alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("s", "t")])
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.withColumns({"xs": F.bit_xor("s").over(here), "ys": F.bit_xor("t").over(here)}).join(carry, ["conv_id", "block"])
    x, y = F.col("xs").bitwiseXOR(F.col("s0")), F.col("ys").bitwiseXOR(F.col("t0"))
    return named.select("conv_id", "depth", "chars", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("s")).alias("px"), y.bitwiseXOR(F.col("t")).alias("py"))


# -------------------------------------------------------------------- trie


def trie_nodes(named: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, n_convs, chars, parent_conv_id) of all nodes."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")  # one row
    found = materialise(
        named.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"), F.first("px").alias("px"), F.first("py").alias("py"))
    )
    tops = found.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "x", "y", "n_convs", "chars", "parent_conv_id"]
    deep = found.filter("depth > 1").join(tops, ["depth", "px", "py"])
    first = found.filter("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))  # the root is one row
    zero = F.lit(0).cast("bigint")
    top = root.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), "n_convs", zero.alias("chars"), F.lit(None).cast("bigint").alias("parent_conv_id"))
    return deep.select(columns).unionByName(first.select(columns)).unionByName(top)


def hash_ids(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of each node's ``conv_id`` values in
    ascending order, joined by commas."""
    joined = ends.groupBy("node", "depth", F.shiftright("conv_id", ID_BITS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: list, sums: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sums, pa.string())], names=["node", "depth", "ends_sha256"])

        last, running = None, None
        for part in parts:
            keys, sums = [], []
            for node, depth, ids in zip(*(part.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) != last:
                    if last is not None:
                        keys.append(last)
                        sums.append(running.hexdigest())
                    last, running = (node, depth), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield told(keys, sums)
        if last is not None:
            yield told([last], [running.hexdigest()])

    by_node = joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "range").select("node", "depth", "ids")
    return by_node.mapInArrow(stream, "node bigint, depth bigint, ends_sha256 string")


# ------------------------------------------------------------- list ranking


def chain_ranks(ids: np.ndarray, after: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of a part of linked lists: the first item of its chain within
    the part, the weight from there up to the item, and whether the chain
    leaves the part behind it.  ``after`` is -1 at a list's end."""
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, after, sorter=order), len(ids) - 1)
    at = order[at]
    inside = ids[at] == after
    head, offset = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    head[at[inside]], offset[at[inside]] = np.flatnonzero(inside), weight[inside]
    while True:
        further = head[head]
        if (further == head).all():
            return head, offset, ~inside
        offset, head = offset + offset[head], further


def contract(arcs: DataFrame) -> DataFrame:
    """Rank the chains of each block of ``arcs`` (id, next, block, layer): (id,
    head, offset, out), out being what follows where a chain leaves the block."""

    def rank(block: pa.Table) -> pa.Table:
        ids, after = block.column("id").to_numpy(), block.column("next").to_numpy()
        head, offset, leaves = chain_ranks(ids, after, np.ones(len(ids), np.int64))
        return pa.table({"id": ids, "head": ids[head], "offset": offset, "out": pa.array(after, mask=~leaves)})

    return arcs.groupBy("block", "layer").applyInArrow(rank, "id bigint, head bigint, offset bigint, out bigint")


def list_ranks(items: DataFrame, level: int = 0) -> DataFrame:
    """(id, left): the weight from each item of the linked list ``items`` (id,
    next, weight; a written table; next of the last is -1) to the list's end."""
    if items.count() <= SMALL:

        def rank(rows: pa.Table) -> pa.Table:
            ids, after, weight = (rows.column(c).to_numpy() for c in ("id", "next", "weight"))
            head, offset, _ = chain_ranks(ids, after, weight)
            total = int(weight.sum())
            return pa.table({"id": ids, "left": total - offset})

        return items.groupBy(F.lit(0).alias("all")).applyInArrow(rank, "id bigint, left bigint")

    def ruler(c: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(level), c), F.lit(RULER)) == 0  # other rulers on every level

    work = items.withColumn("stands", (F.col("next") < 0) | ruler("next"))
    while True:
        moving = work.filter("not stands")
        there = work.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("weight").alias("more"), F.col("stands").alias("held"))
        jumped = moving.join(there, "next").select("id", F.col("then").alias("next"), (F.col("weight") + F.col("more")).alias("weight"), F.col("held").alias("stands"))
        work = materialise(work.filter("stands").unionByName(jumped))
        if work.filter("not stands").isEmpty():
            break
    rulers = materialise(work.filter(ruler("id")).drop("stands"))
    # Rulers form one list; what comes before the first of them ends on it like all other items.
    ranked = materialise(list_ranks(rulers, level + 1))
    rest = work.filter(~ruler("id"))
    below = ranked.select(F.col("id").alias("next"), "left")
    others = rest.join(below, "next", "left").select("id", (F.col("weight") + F.coalesce("left", F.lit(0))).alias("left"))
    return ranked.unionByName(others)


def running_sums(rows: DataFrame, columns: list[str], last: int) -> DataFrame:
    """``rows`` (pos from 0 to ``last``, ...) with the sums of ``columns`` up
    to and including each row, as ``<column>_sum``; blocks of positions first."""
    order = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.shiftright("pos", SUM_BITS))
    within = rows.withColumns({f"{c}_sum": F.sum(c).over(order) for c in columns})
    if last >> SUM_BITS == 0:
        return within.drop("block")
    blocks = rows.groupBy("block").agg(*[F.sum(c).alias(c) for c in columns]).withColumnRenamed("block", "pos")
    carried = running_sums(blocks, columns, last >> SUM_BITS)
    carry = carried.select(F.col("pos").alias("block"), *[(F.col(f"{c}_sum") - F.col(c)).alias(f"{c}_carry") for c in columns])
    summed = within.join(carry, "block").withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"{c}_carry") for c in columns})
    return summed.drop("block", *[f"{c}_carry" for c in columns])


def euler_tour(nodes: DataFrame) -> DataFrame:
    """The arcs (id, next, block, layer) of ``nodes`` (k, conv_id, depth, parent,
    first, sibling, all but the first three as numbers k, or NULL): a node's
    ``enter`` is 2k, its ``exit`` 2k + 1; the root's exit is the end."""
    place = [F.shiftright("conv_id", CONV_BITS).alias("block"), F.shiftright("depth", DEPTH_BITS).alias("layer")]
    enter, leave = 2 * F.col("k"), 2 * F.col("k") + 1
    down = nodes.select(enter.alias("id"), F.coalesce(2 * F.col("first"), leave).alias("next"), *place)
    up = nodes.select(leave.alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1, F.lit(-1)).alias("next"), *place)
    return down.unionByName(up)


def tour_positions(arcs: DataFrame) -> DataFrame:
    """(id, pos): the place of every arc on the tour, from 0."""
    chains = materialise(contract(arcs))
    items = materialise(chains.filter("out is not null").select(F.col("head").alias("id"), F.col("out").alias("next"), (F.col("offset") + 1).alias("weight")))
    ranks = list_ranks(items).select(F.col("id").alias("head"), "left")
    total = chains.agg(F.count(F.lit(1)).alias("total"))  # one row
    placed = chains.join(ranks, "head").crossJoin(F.broadcast(total))
    return placed.select("id", (F.col("total") - F.col("left") + F.col("offset")).alias("pos"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: ``turns`` (conv_id, depth
    from 1, a, b, chars) and ``convs`` (conv_id, length)."""
    convs = materialise(convs)
    named = materialise(name_prefixes(turns))
    nodes = materialise(trie_nodes(named, convs))
    # Numbers: siblings lie side by side, ascending by their smallest member; the root is 0.
    placed = positions(nodes, [F.col("parent_conv_id").asc_nulls_first(), "depth", "conv_id"], ["conv_id", "depth", "parent_conv_id", "n_convs", "chars"])
    placed = placed.withColumnRenamed("_pos", "k")
    children = placed.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n_children"))
    known = materialise(placed.join(children, ["conv_id", "depth"], "left"))
    family = known.filter("n_children > 0").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("k").alias("parent"), F.col("last").alias("youngest"))
    linked = known.join(family, ["parent_conv_id", "depth"], "left").withColumn("sibling", F.when(F.col("k") < F.col("youngest"), F.col("k") + 1))
    arcs = tour_positions(euler_tour(linked.select("k", "conv_id", "depth", "parent", "first", "sibling")))

    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint")
    weights = known.select((2 * F.col("k")).alias("id"), leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    on_tour = materialise(arcs.join(weights, "id", "left").fillna(0, ["leaves", "saved"]))
    last = (on_tour.agg(F.max("pos")).first()[0] or 0)
    summed = running_sums(on_tour, ["leaves", "saved"], last)
    # What lies between a node's two arcs, its own entering included.
    between = [F.sum(F.when(F.col("id") % 2 == 1, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum"))).alias(c) for c in ("leaves", "saved")]
    sums = summed.groupBy(F.shiftright("id", 1).alias("k")).agg(*between)

    ids = nodes.select(F.col("conv_id").alias("node"), "depth", "x", "y")
    finals = named.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "x", "y")
    zero = F.lit(0).cast("bigint")
    finals = finals.unionByName(convs.filter("length = 0").select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y")))
    ends = hash_ids(finals.join(ids, ["depth", "x", "y"]).select("node", "depth", "conv_id")).withColumnRenamed("node", "conv_id")
    out = known.join(sums, "k").join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("leaves").cast("bigint").alias("n_leaves"), F.col("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations of a table (conv_id, turn, role, text),
    rebuilt by ``share_first_turns``."""
    turns = materialise(ordered_turns(conversations))
    return prefix_trie(*share_first_turns(turns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations of a table as they stand."""
    turns = materialise(ordered_turns(conversations))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return prefix_trie(turns.select("conv_id", (F.col("rank") + 1).alias("depth"), "a", "b", "chars"), lengths)
