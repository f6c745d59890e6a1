"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability of being toxic is
a logistic function of its features; the document's is their noisy-or,
1 - prod(1 - p).  Only documents carry labels: the noisy-or's likelihood passes
the blame to the sentences that explain the label, so the same model names the
offending sentences afterwards.

Features are words and word beginnings of 3 to 6 characters (inflected forms
of one stem).  Words are maximal runs of bytes other than blanks and ASCII
punctuation, with A-Z lowered; a sentence ends at ``. ! ?`` or a line end.
Labels, language, source and id never enter a score.

The fit uses at most ``train_rows`` labelled rows (distinct texts of the lowest
hash of their id).  Candidate features are those whose presence depends on the
label by a likelihood-ratio test; from them features are taken one by one, each
for the toxic documents that those before leave unexplained, so that words
that merely accompany an offence do not get in.  The weights are then fitted
to the noisy-or's likelihood.  Scoring reads every document whole, in one pass
without a shuffle.

Defined cases: a NULL or empty text has no sentence, so its score is 0; labels
that are NULL or neither 0 nor 1, and labels of documents that do not exist,
are not used; a text that is labelled both ways counts as toxic; without any
toxic label the model has no feature and scores stay near 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, SEPARATOR, U64, chunks, crc_rest, materialise, mix64, word_hashes

#: Bound of the labelled rows that the model is fitted to.
TRAIN_ROWS = 20_000
#: Candidate features handed to the fit, the best by the test.
CANDIDATES = 4096
#: Least likelihood ratio (twice the log) of a feature.
LEAST_RATIO = 12.0
PREFIXES = (3, 4, 5, 6)
#: A feature's kind is its hash modulo this: 0 a word, else the length of a word beginning.
KINDS = 8
#: Bits of the table that rules out most features before the exact look-up.
FILTER_BITS = 20
EPOCHS = 150

_SPLIT = SEPARATOR.copy()
_SPLIT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F, 0x0A]] = True


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie at ``off`` in ``buf``: features (one row per kind,
    one column per word; 0 where a word is too short), each word's sentence,
    each sentence's text and first byte.  A sentence without a word does not
    count."""
    none = np.zeros(0, np.int64)
    if not len(buf):
        return np.zeros((1 + len(PREFIXES), 0), U64), none, none, none
    inside = ~_SPLIT[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros((1 + len(PREFIXES), 0), U64), none, none, none
    lowered = LOWER[buf]
    features = np.zeros((1 + len(PREFIXES), len(starts)), U64)
    features[0] = _kind(word_hashes(lowered, starts, ends, lower=False), 0)
    heads = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
    rank, stop = np.searchsorted(heads, starts), np.searchsorted(heads, ends)
    heads = np.append(heads, len(buf))
    for row, k in enumerate(PREFIXES, 1):
        at = np.flatnonzero(stop - rank >= k)
        features[row, at] = _kind(word_hashes(lowered, starts[at], heads[rank[at] + k], lower=False), k)
    text = np.searchsorted(off, starts, "right") - 1
    stops = np.cumsum(_STOP[buf])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])
    first = np.flatnonzero(new)
    return features, np.cumsum(new) - 1, text[first], starts[first]


def _kind(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + U64(kind)) & ~U64(KINDS - 1)) | U64(kind)


class Lookup:
    """Columns of known features: a bit table first, then the exact hash."""

    def __init__(self, known: np.ndarray) -> None:
        self.order = np.argsort(known)
        self.sorted = known[self.order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[known >> U64(64 - FILTER_BITS)] = True

    def find(self, features: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, column) of all known features, each once a sentence."""
        kind, word = np.nonzero(self.maybe[features >> U64(64 - FILTER_BITS)])
        if not len(self.sorted) or not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = features[kind, word]
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        hit = self.sorted[at] == h
        pair = np.unique(sentence[word[hit]] * len(self.sorted) + self.order[at[hit]])
        return pair // len(self.sorted), pair % len(self.sorted)


@dataclass
class Model:
    """Known features, their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, all_pos: float, all_neg: float) -> np.ndarray:
    """Twice the log likelihood ratio of presence against label; negative
    where presence speaks for a clean document."""
    n = all_pos + all_neg
    total = np.zeros(len(pos))
    for seen, row, column in ((pos, pos + neg, all_pos), (neg, pos + neg, all_neg), (all_pos - pos, n - pos - neg, all_pos), (all_neg - neg, n - pos - neg, all_neg)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, 2 * seen * np.log(seen * n / (row * column)), 0.0)
    return np.where(pos * all_neg > neg * all_pos, total, -total)


def choose(doc: np.ndarray, column: np.ndarray, kinds: np.ndarray, neg: np.ndarray, toxic: int, clean: float) -> list[int]:
    """Columns by sequential covering.  Entries (doc, column) are distinct and
    of the ``toxic`` toxic documents; ``neg`` counts the clean documents (of
    ``clean``) that hold each column."""
    chosen, open_ = [], np.ones(toxic, bool)
    while open_.any() and len(chosen) < len(kinds):
        pos = np.bincount(column[open_[doc]], minlength=len(kinds)).astype(float)
        ratio = likelihood_ratio(pos, neg, float(open_.sum()), clean)
        ratio[chosen] = -1.0
        best = int(np.lexsort((kinds, np.round(ratio, 6)))[-1])  # of equal ones the longest beginning
        if ratio[best] < LEAST_RATIO:
            break
        chosen.append(best)
        open_[doc[column == best]] = False
    return chosen


def fit_bags(doc: np.ndarray, sentence: np.ndarray, column: np.ndarray, empty: np.ndarray, y: np.ndarray, width: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the largest likelihood of the noisy-or, by Adam with
    a small quadratic penalty.  Entries: document, sentence (numbered over all
    documents) and column; ``empty``: sentences without an entry, by document."""
    w, bias = np.zeros(width), -5.0
    keys, index = np.unique(sentence, return_inverse=True)
    owner = np.zeros(len(keys), np.int64)
    owner[index] = doc
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, epochs + 1):
        z = bias + np.bincount(index, w[column], len(keys))
        total = np.maximum(empty * softplus(bias) + np.bincount(owner, softplus(z), len(y)), 1e-9)
        slope = np.where(y == 1, -1.0 / np.expm1(np.minimum(total, 500.0)), 1.0) / len(y)
        g = slope[owner] / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(column, g[index], width) + 1e-5 * w, g.sum() + (slope * empty).sum() / (1.0 + np.exp(-bias)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit to at most ``train_rows`` rows of ``docs`` (doc_id, text) with a
    label (doc_id, toxic)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    known = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).join(known, "doc_id")
    once = texts.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    sample = once.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(train_rows).select("doc_id", "toxic")
    sample = materialise(sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))  # at most train_rows short rows
    by_label = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = float(by_label.get(1, 0)), float(by_label.get(0, 0))
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            y = np.array(part.column("toxic"), np.int64)
            for i, j, buf, off in chunks(part.column("text")):
                features, sentence, text, _ = sentences(buf, off)
                if not len(sentence):
                    continue
                owner = np.broadcast_to(text[sentence], features.shape)[features > 0]
                h = features[features > 0]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, toxic = h[new], y[i:j][owner[new]]
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n = np.diff(np.append(at, len(h)))
                yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(toxic, at)), pa.array(n)], names=["h", "pos", "n"])

    seen = rows.mapInArrow(count, "h bigint, pos bigint, n bigint").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    ln = lambda seen, row, column: F.when(seen > 0, 2 * seen * F.log(seen * (n_pos + n_neg) / (row * column))).otherwise(0.0)
    rest = n_pos + n_neg - F.col("n")
    ratio = ln(pos, F.col("n"), n_pos) + ln(neg, F.col("n"), n_neg) + ln(n_pos - pos, rest, n_pos) + ln(n_neg - neg, rest, n_neg)
    best = seen.filter(pos * n_neg > neg * n_pos).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "h").limit(CANDIDATES)
    found = best.select("h", "pos", "n").collect() if n_pos and n_neg else []
    candidates = np.array([r["h"] for r in found], np.int64).view(U64)

    def bags(of: DataFrame, features: np.ndarray) -> list[dict]:
        """Of each document the number of sentences, and the places (sentence,
        column) of known features."""
        lookup = Lookup(features)

        def bag(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                out: list[tuple[int, bytes, bytes]] = []
                for i, j, buf, off in chunks(part.column("text")):
                    features, sentence, text, _ = sentences(buf, off)
                    at, column = lookup.find(features, sentence)
                    total = np.bincount(text, minlength=j - i)
                    cut = np.searchsorted(text[at], np.arange(j - i + 1))
                    for r in range(j - i):
                        a, b = cut[r], cut[r + 1]
                        out.append((int(total[r]), at[a:b].astype("<i4").tobytes(), column[a:b].astype("<i4").tobytes()))
                columns = list(zip(*out, strict=True)) or [[]] * 3
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("toxic"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "toxic", "total", "sentence", "column"],
                )

        return of.mapInArrow(bag, "doc_id bigint, toxic int, total bigint, sentence binary, column binary").toArrow().sort_by("doc_id").to_pylist()

    chosen: list[int] = []
    if len(candidates):
        # Presence of candidates is needed of the toxic rows only; the clean rows' counts are known.
        held = [np.unique(np.frombuffer(r["column"], "<i4")) for r in bags(rows.filter("toxic = 1"), candidates)]
        doc = np.repeat(np.arange(len(held)), [len(c) for c in held])
        neg = np.array([r["n"] - r["pos"] for r in found], float)
        chosen = choose(doc, np.concatenate(held), (candidates & U64(KINDS - 1)).astype(np.int64), neg, len(held), n_neg)
    known_features = candidates[chosen]
    got = bags(rows, known_features)
    if not got:
        return Model(known_features, np.zeros(len(chosen)), -5.0)
    sentence = [np.unique(np.frombuffer(r["sentence"], "<i4"), return_inverse=True)[1] for r in got]
    sizes = np.array([len(s) for s in sentence], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(got)), sizes)
    sentence = np.concatenate([s + b for s, b in zip(sentence, base, strict=False)]).astype(np.int64)
    column = np.frombuffer(b"".join(r["column"] for r in got), "<i4").astype(np.int64)
    filled = np.bincount(doc[np.unique(sentence, return_index=True)[1]], minlength=len(got))
    empty = np.array([r["total"] for r in got], float) - filled
    weights, bias = fit_bags(doc, sentence, column, empty, np.array([r["toxic"] for r in got], np.int64), len(chosen))
    return Model(known_features, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, names: tuple[str, str, str] = ("score", "predicted", "offending")) -> DataFrame:
    """Add to every row of ``docs`` its score (double), prediction (int) and
    offending sentences: the byte offset and probability of each sentence
    whose own probability reaches ``threshold``.  All columns are kept; those
    that have one of ``names`` are replaced."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])
    span = pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())]))
    lookup = Lookup(model.features)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores, spans = [], []
            for i, j, buf, off in chunks(part.column("text")):
                features, sentence, text, at = sentences(buf, off)
                where, column = lookup.find(features, sentence)
                z = model.bias + np.bincount(where, model.weights[column], len(text))
                total = np.bincount(text, softplus(z), j - i) if len(z) else np.zeros(j - i)
                scores.append(-np.expm1(-total))
                p = 1.0 / (1.0 + np.exp(-z))
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for s in np.flatnonzero(p >= threshold):
                    found[text[s]].append({"start": int(at[s] - off[text[s]]), "score": float(p[s])})
                spans += found
            p = np.concatenate(scores) if scores else np.zeros(0)
            out = part.append_column(names[0], pa.array(p, pa.float64())).append_column(names[1], pa.array((p >= threshold).astype(np.int32), pa.int32()))
            yield out.append_column(names[2], pa.array(spans, span))

    schema = "".join(f"`{c}` {t}, " for c, t in kept.dtypes)
    return kept.mapInArrow(build, f"{schema}{names[0]} double, {names[1]} int, {names[2]} array<struct<start:bigint,score:double>>")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fold."""
    held_out = crc_rest("doc_id", 5) == 0
    model = fit(docs, labels.filter(~held_out))
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "offending")
