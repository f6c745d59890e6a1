"""Near-duplicate documents by SuperMinHash.

Documents are sets of ``shingle``-word shingles (words with A-Z lowered).  Two
are linked if 100 * |A & B| >= percent * |A | B|; a group is a connected
component of links.

*Signature.*  For register i an element's value is a random fraction plus the
rank of i in a random permutation of the registers that belongs to the
element; a register keeps the least value.  Ranks within an element are all
different, which lowers the variance against independent hashes.  Elements
are worked through rank by rank, and a document stops at the first rank that
cannot lower any of its registers.  The permutation is i -> a + rank * b
modulo a prime number of registers, with a and b drawn from the element.

*Candidates.*  Equal sets collapse first.  Registers are cut into bands;
documents with an equal band share a bucket.  Buckets of at most ``small``
documents give their pairs.  Larger ones are compared with their pivot, the
document that meets most others (near copies of one text lie around it), and
split by a second band that their documents also share; a split bucket that is
still large is compared with its own pivot.  A sketch of one bit a register rules out most pairs that
are far from the threshold.  Large buckets whose members still lie in
different groups after that are gone through whole: every pair of two groups
meets in one task of bounded size (``blocks``), first by sketch, then, for
members with a pair left, on the full sets (``remainder``).

*Verification* is on the full sets: the members of a hub go to the hub's task
in parts of bounded size (``salted``).  First each document's likeliest
partner is checked, then, after grouping, the pairs that still lie in
different groups.  *Grouping* is union-find within partitions and large-star /
small-star rounds between them, all on the executors.

Defined cases: a document with fewer words than a shingle is the whole word
sequence as one shingle; without words (text NULL, empty or blank) it is
linked with nothing; a NULL doc_id is linked with nothing and kept; rows that
repeat a doc_id have one component, also where their texts differ (their links
join), and are kept or go together; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import U64, chunks, materialise, mix64, release, signed, span_hashes, word_bounds, word_hashes

SHINGLE = 5
PERCENT = 85
#: Registers (a prime).
REGISTERS = 127
#: Most probable loss of a link right at the threshold, by the bands and by the
#: sketch each; both fall fast above it.
LOSS = 1e-6
#: Largest bucket that gives all its pairs.
SMALL = 16
#: Bands pair up within classes of so many at most (band modulo the number of
#: classes) to split a large bucket: bounds a document's pairs at any threshold.
PAIRED = 13
#: Members of a hub that one task compares.
HUB_MEMBERS = 256
#: Members of a large bucket on each side of one task: by sketch, on full sets.
SKETCH_BLOCK, TEXT_BLOCK = 1024, 128
#: Links below which a grouping step uses fewer tasks.
EDGES_PER_TASK = 50_000

_GOLDEN = U64(0x9E3779B97F4A7C15)
_DONE = U64(0xFFFFFFFFFFFFFFFF)


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers of a band): the longest bands of which two sets at the
    threshold share none with probability ``LOSS`` at most (25 of 5 at 85)."""
    s = percent / 100
    rows = next((r for r in range(16, 1, -1) if (1 - s**r) ** (REGISTERS // r) <= LOSS), 1)
    return REGISTERS // rows, rows


def max_bits(percent: int) -> int:
    """Differing sketch bits beyond which a pair is dropped: two sets at the
    threshold differ in more with probability ``LOSS`` at most (26 at 85)."""
    p, left = (1 - percent / 100) / 2, 1.0
    for bits in range(REGISTERS):
        left -= math.comb(REGISTERS, bits) * p**bits * (1 - p) ** (REGISTERS - bits)
        if left <= LOSS:
            return bits
    return REGISTERS


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order of (text, hash), each one's text)."""
    starts, ends, first = word_bounds(buf, off)
    words = word_hashes(buf, starts, ends, lower=True)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    base = np.cumsum(count) - count
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(count.sum())) + np.repeat(first[:-1] - base, count)
    if not len(at):
        return np.zeros(0, U64), text
    h = span_hashes(words, at, np.minimum(at + width, first[1:][text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def superminhash(h: np.ndarray, text: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of ``rows`` texts from their distinct elements: the rank in
    the high 8 bits, the fraction below; ``_DONE`` in texts without elements."""
    out = np.full((rows, registers), _DONE)
    flat = out.reshape(-1)
    low = mix64(h ^ U64(0xA5A5A5A5))
    shift = ((low >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
    step = 1 + ((low & U64(0xFFFFFFFF)) * U64(registers - 1) >> U64(32)).astype(np.int64)
    base = text * registers
    for rank in range(registers):
        fraction = mix64(h + U64(int(_GOLDEN) * (rank + 1) % 2**64)) >> U64(8)
        np.minimum.at(flat, base + shift, (U64(rank) << U64(56)) | fraction)
        # The next rank's values are rank + 1 at least: texts whose registers are all below that are done.
        open_ = (out.max(axis=1) >> U64(56)) > U64(rank)
        more = open_[text]
        if not more.any():
            break
        h, text, base, step = h[more], text[more], base[more], step[more]
        shift = shift[more] + step
        shift[shift >= registers] -= registers
    return out


_SIGNED = "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, s1 bigint, s2 bigint"


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Set size, set fingerprint (128 bits), band hashes and sketch of each row
    (doc_id, text); further columns, which are numbers, are carried along."""
    bands, width = banding(percent)
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, buf, off in chunks(part.column("text")):
                h, text = shingle_sets(buf, off)
                rows = j - i
                n = np.bincount(text, minlength=rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                prints = []
                for salt in (0x1234567, 0x89ABCDE):
                    run = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(salt)), dtype=U64)])
                    prints.append(signed(run[edge[1:]] - run[edge[:-1]]))
                reg = superminhash(h, text, rows)
                band = np.full((rows, bands), U64(bands))
                for r in range(width):
                    band = mix64(band * _GOLDEN + reg[:, r : bands * width : width]) + np.arange(bands, dtype=U64)
                bits = np.zeros((rows, 128), np.uint8)
                bits[:, :REGISTERS] = mix64(reg) >> U64(63)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(signed(np.ascontiguousarray(band)).reshape(-1)))
                yield pa.record_batch(
                    [*[part.column(c).slice(i, rows) for c in ("doc_id", *carried)], pa.array(n), pa.array(prints[0]), pa.array(prints[1]), flat, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["doc_id", *carried, "n", "f1", "f2", "bands", "s1", "s2"],
                )

    return docs.mapInArrow(build, _SIGNED.replace("n bigint", "".join(f"{c} bigint, " for c in carried) + "n bigint", 1))


def may_link(a: str, b: str, percent: int) -> F.Column:
    """Necessary by the set sizes, and likely by the sketches."""
    col = lambda side, c: F.col(f"{side}.{c}")
    bits = F.bit_count(col(a, "s1").bitwiseXOR(col(b, "s1"))) + F.bit_count(col(a, "s2").bitwiseXOR(col(b, "s2")))
    sizes = 100 * F.least(col(a, "n"), col(b, "n")) >= percent * F.greatest(col(a, "n"), col(b, "n"))
    return sizes & (bits <= max_bits(percent))


def bucket_pairs(members: DataFrame, small: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the small buckets of ``members`` (key, m), and the
    members of the large ones with their pivot ``top``."""
    counted = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("m.meets", (-F.col("m.doc_id")).alias("o"), "m")).alias("top"))
    held = members.join(counted.filter("size > 1").select("key", "size", "top.m").withColumnRenamed("m", "top"), "key")
    lists = held.filter(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("l"))
    pairs = F.flatten(
        F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.greatest(F.size("l") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter(may_link("a", "b", percent)), held.filter(F.col("size") > small)


def candidates(sets: DataFrame, percent: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b, bits) with a < b of ``sets``, and the
    documents of large buckets with their buckets ``k``."""
    classes = -(-banding(percent)[0] // PAIRED)
    m = lambda meets: F.struct("doc_id", "n", "s1", "s2", meets.alias("meets")).alias("m")
    banded = sets.select(F.posexplode("bands").alias("band", "h"), m(F.lit(0).cast("bigint"))).select(F.xxhash64("band", "h").alias("key"), "band", "m")
    pairs, large = bucket_pairs(banded, small, percent)
    crowded = large.groupBy("m.doc_id").agg(
        F.max("m").alias("m"), F.sum("size").alias("meets"), F.array_sort(F.collect_list(F.struct((F.col("band") % classes).alias("g"), "key", "band"))).alias("k")
    )  # a row holds at most one key a band
    crowded = materialise(crowded.select("m.doc_id", "m.n", "m.s1", "m.s2", "meets", "k"))
    two = F.flatten(
        F.transform(
            "k",
            lambda a, i: F.transform(
                F.filter(F.slice("k", i + 2, F.greatest(F.size("k") - i - 1, F.lit(0))), lambda b: b["g"] == a["g"]), lambda b: F.xxhash64(a["key"], b["key"])
            ),
        )
    )
    split = materialise(crowded.select(F.explode(two).alias("key"), m(F.col("meets"))))  # read four times below
    split_pairs, still = bucket_pairs(split, small, percent)
    _, first_large = bucket_pairs(crowded.select(F.explode("k.key").alias("key"), m(F.col("meets"))), 1, percent)
    stars = [x.select(F.col("top").alias("a"), F.col("m").alias("b")).filter("a.doc_id <> b.doc_id").filter(may_link("a", "b", percent)) for x in (first_large, still)]
    every = pairs.unionByName(split_pairs).unionByName(stars[0]).unionByName(stars[1])
    bits = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    x, y = F.col("a.doc_id"), F.col("b.doc_id")
    return every.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), bits.alias("bits")).dropDuplicates(["a", "b"]), crowded


def blocks(members: DataFrame, width: int) -> DataFrame:
    """``members`` (key, doc_id, group, ...) of the buckets with several groups,
    dealt to tasks (key, i, j) of about ``width`` rows a side.  Members outside
    a bucket's largest group (``minor``) are on the left and meet all on the right."""
    groups = members.groupBy("key", "group").agg(F.count(F.lit(1)).alias("c"))
    told = groups.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "group")).alias("major")).filter("size > major.c")
    held = members.join(told, "key").withColumn("minor", F.col("group") != F.col("major.group"))
    across, down = (F.ceil(x / width).cast("int") for x in (F.col("size"), F.col("size") - F.col("major.c")))
    part = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    left = held.filter("minor").withColumn("left", F.lit(True)).withColumn("i", part(1, down)).withColumn("j", each(across))
    right = held.withColumn("left", F.lit(False)).withColumn("j", part(2, across)).withColumn("i", each(down))
    return left.unionByName(right).drop("size", "major")


def open_pairs(task: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of one task that lie in different groups, share no
    earlier band (they meet there), and may be linked."""
    get = lambda c: task.column(c).to_numpy()
    left, minor, ids, group, n = get("left").astype(bool), get("minor").astype(bool), get("doc_id"), get("group"), get("n")
    s1, s2 = get("s1").view(U64), get("s2").view(U64)
    bands = pa.concat_arrays([c.flatten() for c in task.column("bands").chunks]).to_numpy().reshape(task.num_rows, -1)[:, : task.column("band")[0].as_py()]
    right, found = np.flatnonzero(~left), []
    for at in np.array_split(np.flatnonzero(left), max(1, int(left.sum()) // 64)):
        x = at[:, None]
        differ = np.bitwise_count(s1[x] ^ s1[right]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[right])
        ok = (differ <= max_bits(percent)) & (group[x] != group[right]) & (~minor[right] | (ids[x] < ids[right]))
        ok &= 100 * np.minimum(n[x], n[right]) >= percent * np.maximum(n[x], n[right])
        a, b = np.nonzero(ok)
        a, b = at[a], right[b]
        new = ~(bands[a] == bands[b]).any(1)
        found.append((a[new], b[new]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def remainder(crowded: DataFrame, sets: DataFrame, texts: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different groups of ``grouped`` among all pairs of
    the large buckets; of links that join the same groups a task gives one."""
    group = grouped.select("doc_id", F.col("component_id").alias("group"))
    named = materialise(crowded.join(group, "doc_id", "left").select("doc_id", F.coalesce("group", "doc_id").alias("group"), "k"))
    keyed = named.select("doc_id", "group", F.explode("k").alias("k")).select("doc_id", "group", "k.key", "k.band")
    several = keyed.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x < y").select("key")
    facts = sets.select("doc_id", "n", "s1", "s2", "bands")
    # Buckets of one group, mostly all, end here; only members of the others fetch their facts, once each.
    open_keys = keyed.join(several, "key", "left_semi").groupBy("doc_id", "group").agg(F.collect_list(F.struct("key", "band")).alias("k"))  # one a band at most
    members = open_keys.join(facts, "doc_id").withColumn("k", F.explode("k"))
    members = materialise(members.select("doc_id", "k.key", "group", "k.band", "n", "s1", "s2", "bands"))

    def live(task: pa.Table) -> pa.Table:
        rows = np.unique(np.concatenate(open_pairs(task, percent)))
        return task.select(["key", "doc_id"]).take(pa.array(rows))

    def links(task: pa.Table) -> pa.Table:
        x, y = open_pairs(task, percent)
        rows = np.unique(np.concatenate([x, y]))
        hashes, size = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for i, j, buf, off in chunks(task.column("text").take(pa.array(rows))):
            h, text = shingle_sets(buf, off)
            hashes.append(h)
            size.append(np.bincount(text, minlength=j - i))
        size = np.concatenate(size)
        edge = np.concatenate([[0], np.cumsum(size)])
        values, code = np.unique(np.concatenate(hashes), return_inverse=True)
        x, y, ids, group = np.searchsorted(rows, x), np.searchsorted(rows, y), task.column("doc_id").to_numpy()[rows], task.column("group").to_numpy()[rows]
        _, group = np.unique(group, return_inverse=True)
        found: list[tuple[int, int]] = []
        for one in np.unique(x):
            others = y[x == one]
            others = others[group[others] != group[one]]
            if not len(others):
                continue
            mine = np.zeros(len(values), bool)
            mine[code[edge[one] : edge[one + 1]]] = True
            run = np.concatenate([[0], np.cumsum(mine[code])])
            both = run[edge[others + 1]] - run[edge[others]]
            for other in others[100 * both >= percent * (size[one] + size[others] - both)]:
                if group[other] != group[one]:
                    group[group == group[other]] = group[one]
                    found.append((int(ids[one]), int(ids[other])))
        return pa.table([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    alive = blocks(members, SKETCH_BLOCK).groupBy("key", "i", "j").applyInArrow(live, "key bigint, doc_id bigint").distinct()
    alive = materialise(members.join(alive, ["key", "doc_id"], "left_semi"))
    return blocks(alive, TEXT_BLOCK).join(texts, "doc_id").groupBy("key", "i", "j").applyInArrow(links, "a bigint, b bigint")


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, on the full sets of ``texts`` (doc_id, text)."""
    load = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).groupBy("d").agg(F.count(F.lit(1)).alias("w"))
    w = lambda side: load.select(F.col("d").alias(side), F.col("w").alias(f"w{side}"))
    hubbed = pairs.join(w("a"), "a").join(w("b"), "b")
    first = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b")))
    hub, member = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    parts = F.ceil(F.greatest("wa", "wb") / HUB_MEMBERS)
    salted = materialise(hubbed.select(hub.alias("hub"), member.alias("doc_id"), F.pmod(F.xxhash64(member), parts).cast("int").alias("salt")))
    hubs = salted.select("hub", F.col("hub").alias("doc_id"), "salt").distinct()
    rows = salted.unionByName(hubs).join(texts, "doc_id").select("hub", "salt", "doc_id", "text")

    def compare(group: pa.Table) -> pa.Table:
        hub, ids = group.column("hub")[0].as_py(), group.column("doc_id").to_pylist()
        own = ids.index(hub) if hub in ids else -1
        found = []
        if own >= 0:
            for _, _, buf, off in chunks(group.column("text").slice(own, 1).combine_chunks()):
                mine = shingle_sets(buf, off)[0]
            for i, j, buf, off in chunks(group.column("text")):
                h, text = shingle_sets(buf, off)
                place = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                both = np.bincount(text[mine[place] == h], minlength=j - i)
                total = len(mine) + np.bincount(text, minlength=j - i) - both
                found += [ids[i + k] for k in np.flatnonzero(100 * both >= percent * total) if ids[i + k] != hub]
        return pa.table([pa.array([min(hub, x) for x in found], pa.int64()), pa.array([max(hub, x) for x in found], pa.int64())], names=["a", "b"])

    return rows.groupBy("hub", "salt").applyInArrow(compare, "a bigint, b bigint")


def local_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: (least member, member)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    members = [x for x in parent if find(x) != x]
    yield pa.record_batch([pa.array([find(x) for x in members], pa.int64()), pa.array(members, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of all documents with a link whose component's
    least id is another one."""

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, in parts of useful size, and a checksum of their set."""
        df = materialise(df)
        told = tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        return df.coalesce(max(1, min(df.rdd.getNumPartitions(), told[0] // EDGES_PER_TASK))), told

    edges, before = written(links.mapInArrow(local_groups, "a bigint, b bigint").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")  # m <= a < b
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(up, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
        edges, after = written(joined.filter("m <> b").select(F.col("m").alias("a"), "b").distinct())
        if after == before:
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id"))
        before = after


def group_documents(docs: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id
    (the least doc_id of its group) and kept (whether that is the row's own)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("mark"))
    marked = materialise(signatures(docs, percent))
    full = marked.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # A node is a distinct set, named by a number; an id that stands over different texts has several.
    equal = full.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "mark")).alias("rep"))
    equal = materialise(equal.select("n", "f1", "f2", "rep.doc_id", "rep.mark", F.monotonically_increasing_id().alias("node")))
    first = full.join(equal, ["n", "f1", "f2", "doc_id", "mark"]).dropDuplicates(["node"])
    sets = materialise(first.select(F.col("node").alias("doc_id"), "n", "bands", "s1", "s2"))
    whose = equal.select("doc_id", "mark", "node")
    pairs, crowded = candidates(sets, percent, small)
    pairs = materialise(pairs)
    release(docs.sparkSession)  # the buckets
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(crowded.select("doc_id")).distinct()
    asked = whose.join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi")
    texts = docs.join(asked, ["doc_id", "mark"]).dropDuplicates(["node"])
    texts = materialise(texts.select(F.col("node").alias("doc_id"), "text"))
    ends = pairs.select(F.col("a").alias("d"), "a", "b", "bits").unionByName(pairs.select(F.col("b").alias("d"), "a", "b", "bits"))
    best = ends.groupBy("d").agg(F.min(F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    sure = verify(best, texts, percent)
    grouped = components(sure)
    release(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(f"g{c}"), F.col(c))
    g = lambda c: grouped.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"g{c}"))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(g("a"), "a", "left").join(g("b"), "b", "left").filter(named("a") != named("b")).select("a", "b")
    more = verify(apart, texts, percent)
    edges = lambda groups: groups.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    grouped = components(edges(grouped).unionByName(more))
    release(docs.sparkSession)
    linked = edges(grouped).unionByName(remainder(crowded, sets, texts, grouped, percent))
    rows = marked.select("doc_id", F.col("n").alias("n_shingles"), "n", "f1", "f2").join(equal.select("n", "f1", "f2", "node"), ["n", "f1", "f2"], "left")
    rows = materialise(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    # Rows that repeat an id join their nodes: with different texts they are several.
    repeated = rows.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    same = rows.join(repeated.select("doc_id", "a"), "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    found = components(linked.unionByName(same)).select(F.col("doc_id").alias("node"), F.col("component_id").alias("group"))
    rows = rows.join(found, "node", "left").withColumn("group", F.coalesce("group", "node"))
    # An id over a text with words and one without any belongs to the first one's group.
    named = rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_id = rows.filter("group is null and doc_id is not null").select("doc_id").distinct().join(rows.filter("group is not null").select("doc_id", "group"), "doc_id")
    of_id = of_id.groupBy("doc_id").agg(F.min("group").alias("own"))
    rows = rows.join(of_id, "doc_id", "left").withColumn("group", F.coalesce("group", "own"))
    out = rows.join(named, "group", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
