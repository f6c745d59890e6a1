"""Language-model scores by prediction by partial matching (PPM).

The model is a byte-context trie of all training documents: for each context
of 0 to ``order`` bytes the bytes that followed it, with counts.  A byte is
predicted in the longest context that the trie knows; if it did not follow
there, the model escapes to the next shorter context, from whose distribution
the bytes of the longer one are excluded.  Escapes are estimated as in PPMD:
with T occurrences and q different bytes, a byte seen c times has
(2c - 1) / 2T and the escape q / 2T.  After order 0 the bytes that never
occurred share what is left.

A document is its words with A-Z lowered, one space between, and an end mark;
the contexts at its start reach into end marks.  The same normalised tokens
give the add-one unigram score that comes along for comparison.

Nothing of the model is broadcast or collected.  Documents are dealt to
batches by a hash of their id; a batch reports its distinct (order + 1)-grams
and words with their counts in training documents.  Their totals, the trie's
shorter contexts and the log probabilities are joins and aggregates over
distinct grams, and each batch gets back the values of its own grams and
words, which it adds up for each document.

Defined cases: a text NULL, empty or blank is the end mark alone; a NULL
doc_id counts as an untrained row; repeated rows count as often as they stand;
without training documents all bytes are equally likely; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, U64, bound_batches, chunks, shard_count, signed, word_bounds, word_hashes

#: Longest context, in bytes.
ORDER = 5
#: Bytes that a document can hold: all but the separators other than space, and the end mark (0x0A).
SYMBOLS = 252
#: Input bytes of a batch, about.
BATCH_BYTES = 14 << 20

_END, _SPACE = 0x0A, 0x20
_TOKENS, _KINDS = -(2**63), -(2**63) + 1  # keys of the two totals; words have the sign bit and a higher hash
_COUNT = (1 << 32) - 1  # a batch holds fewer bytes
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
    + [("base_score", pa.float64()), ("score", pa.float64())]
)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, the end mark after each text's words included, and
    each text's first token (one entry more than texts)."""
    starts, ends, first = word_bounds(buf, off)
    end = word_hashes(np.array([_END], np.uint8), np.array([0]), np.array([1]), lower=True)
    h = np.insert(word_hashes(buf, starts, ends, lower=True), first[1:], end[0])
    return signed((h >> U64(1)) + U64(2) | U64(1 << 63)), first + np.arange(len(first))


def grams(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the normalised texts with the ``order`` bytes before it,
    as one number; and each text's first (one entry more than texts)."""
    starts, ends, first = word_bounds(buf, off)
    size = ends - starts + 1
    run = np.concatenate([[0], np.cumsum(size)])
    length = np.maximum(run[first[1:]] - run[first[:-1]], 1)  # of each text with its end mark
    base = np.cumsum(length + order) - length - order
    text = np.repeat(np.arange(len(length)), np.diff(first))
    to = base[text] + order + run[:-1] - run[first[:-1]][text]
    out = np.full(int((length + order).sum()), _END, np.uint8)
    width = size - 1
    at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    out[at + np.repeat(to, width)] = LOWER[buf[at + np.repeat(starts, width)]]
    inner = np.ones(len(starts), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    out[(to + width)[inner]] = _SPACE
    n = len(out) - order
    g = np.zeros(max(n, 0), np.int64)
    for j in range(order + 1):
        g = (g << 8) | out[j : j + n]
    keep = np.ones(len(g), bool)
    for j in range(order):
        keep[base[1:] - order + j] = False  # windows that end in the next text's start
    return g[keep], np.concatenate([[0], np.cumsum(length)])


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def counted(keys: np.ndarray, first: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    return distinct, np.bincount(codes, np.repeat(train, np.diff(first)), len(distinct))


def score_documents(docs: DataFrame, held_out: F.Column, order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); rows with ``held_out`` are
    scored only."""
    bound_batches(docs.sparkSession)
    batches = shard_count(docs, batch_bytes, 2)
    doc_id = F.col("doc_id").cast("bigint")
    dealt = docs.select(
        F.pmod(F.xxhash64(F.coalesce(doc_id, F.xxhash64("text"))), F.lit(batches)).cast("int").alias("batch"),
        doc_id.alias("doc_id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        "text",
    )

    def count(group: pa.Table) -> pa.Table:
        held = np.asarray(group.column("held_out"), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, buf, off in chunks(group.column("text")):
            train = (~held[i:j]).astype(np.float64)
            found += [counted(*tokens(buf, off), train), counted(*grams(buf, off, order), train)]
            if len(found) >= 8:
                found = [add_up(found)]
        keys, c = add_up(found)
        return pa.table([pa.array(keys), pa.array(c + (group.column("batch")[0].as_py() << 32))], names=["key", "load"])

    # Batch and count travel as one number, and no filter on the key stands above the totals: so both uses of
    # `rows` keep the same columns and rows, and Spark computes and exchanges it once.
    rows = dealt.groupBy("batch").applyInArrow(count, "key bigint, load bigint").filter("key is not null").repartition("key")
    totals = rows.groupBy("key").agg(F.sum(F.col("load").bitwiseAND(F.lit(_COUNT))).alias("c"), F.max(F.col("key") >= 0).alias("gram"))
    values = totals.filter(~F.col("gram")).select("key", F.col("c").cast("double").alias("value"))
    values = values.unionByName(gram_scores(totals.filter("gram"), order))
    own = rows.join(values.hint("merge"), "key").select(F.shiftright("load", 32).cast("int").alias("batch"), "key", "value")
    stats = totals.filter(~F.col("gram") & (F.col("c") > 0)).agg(F.sum("c").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("v"))
    stats = stats.select(F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "n", "v").select(
        F.col("batch").cast("int").alias("batch"),
        F.explode(F.array(F.struct(F.lit(_TOKENS).alias("key"), F.coalesce("n", F.lit(0.0)).alias("value")), F.struct(F.lit(_KINDS).alias("key"), F.col("v").alias("value")))).alias("s"),
    ).select("batch", "s.key", "s.value")

    def add(texts: pa.Table, given: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _SCORED.empty_table()
        index, value = pd.Index(np.asarray(given.column("key"), np.int64)), np.asarray(given.column("value"), np.float64)
        total, kinds = value[index.get_indexer([_TOKENS, _KINDS])]
        out = []
        for _, _, buf, off in chunks(texts.column("text")):
            keys, first = tokens(buf, off)
            c = value[index.get_indexer(keys)]
            base = np.add.reduceat(np.log10((c + 1) / (total + kinds + 1)), first[:-1])
            known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
            g, g_first = grams(buf, off, order)
            out.append((np.diff(first), known, base, np.add.reduceat(value[index.get_indexer(g)], g_first[:-1])))
        n, known, base, score = (np.concatenate(x) for x in zip(*out, strict=True))
        all_tokens = np.full(len(n), int(total), np.int64)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), n, known, all_tokens, base, score], schema=_SCORED)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("batch").cogroup(own.unionByName(stats).groupBy("batch")).applyInArrow(add, schema)


def gram_scores(wanted: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 probability of the last byte of each gram of
    ``order`` + 1 bytes after the others; ``wanted``: (key, c) with the
    training counts, 0 included."""

    def tail(gram: F.Column, bytes_: int) -> F.Column:
        return gram.bitwiseAND(F.lit((1 << 8 * bytes_) - 1))

    def mark(gram: F.Column, k: F.Column) -> F.Column:
        return gram + F.shiftleft(k.cast("bigint"), 56)  # contexts and grams of different orders side by side

    # All orders of the trie: the counts of a gram's endings are sums over what stands before them.
    orders = [F.struct(F.lit(k).alias("k"), tail(F.col("key"), k + 1).alias("g")) for k in range(order + 1)]
    nodes = wanted.filter("c > 0").select(F.explode(F.array(*orders)).alias("o"), "c").groupBy("o.k", "o.g").agg(F.sum("c").alias("c"))
    shorter = F.when(F.col("k") > 0, F.element_at(F.array(*[tail(F.col("g"), max(k, 1)) for k in range(order + 1)]), F.col("k") + 1))
    pairs = nodes.select(mark(F.col("g"), F.col("k")).alias("pair"), F.col("c"))
    below = nodes.select("k", "g", "c", mark(shorter, F.col("k") - 1).alias("pair"))
    joined = below.join(pairs.withColumnRenamed("c", "low"), "pair", "left")
    contexts = joined.groupBy(mark(F.shiftright("g", 8), F.col("k")).alias("context")).agg(
        F.sum("c").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("q"), F.coalesce(F.sum("low"), F.lit(0)).cast("double").alias("e")
    )
    top = mark(F.shiftright("key", 8), F.lit(order))
    # Every such context is there; an inner join would put a filter on the key below the exchange of the counts.
    seen = wanted.filter("c > 0").withColumn("context", top).join(contexts, "context", "left")
    seen = seen.select("key", F.log10((2 * F.col("c") - 1) / (2 * F.col("t"))).alias("value"))
    steps = [
        F.struct(F.lit(order - k).alias("step"), mark(tail(F.col("key"), k + 1), F.lit(k)).alias("pair"), mark(F.shiftright(tail(F.col("key"), k + 1), 8), F.lit(k)).alias("context"))
        for k in range(order, -1, -1)
    ]
    unseen = wanted.filter("c = 0").select("key", F.explode(F.array(*steps)).alias("s")).select("key", "s.*")
    unseen = unseen.join(pairs, "pair", "left").join(contexts, "context", "left")
    walk = unseen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("c", F.lit(0)).cast("double").alias("c"), "t", "q", "e"))).alias("l"))
    zero = F.struct(F.lit(0.0).alias("lp"), F.lit(0.0).alias("q"), F.lit(0.0).alias("e"), F.lit(False).alias("done"))

    def down(state: F.Column, x: F.Column) -> F.Column:
        mass = 2 * (x["t"] - state["e"])
        hit = x["c"] > 0
        p = F.when(hit, (2 * x["c"] - 1) / mass).otherwise((x["q"] - state["q"]) / mass)
        lp = F.when(hit | (mass > 0), state["lp"] + F.log10(p)).otherwise(state["lp"])  # a context without further bytes always escapes
        moved = F.struct(lp.alias("lp"), x["q"].alias("q"), x["e"].alias("e"), hit.alias("done"))
        return F.when(state["done"] | x["t"].isNull(), state).otherwise(moved)

    rest = lambda s: F.when(s["done"], s["lp"]).otherwise(s["lp"] - F.log10(F.lit(float(SYMBOLS)) - s["q"]))
    return seen.unionByName(walk.select("key", F.aggregate("l", zero, down, rest).alias("value")))
