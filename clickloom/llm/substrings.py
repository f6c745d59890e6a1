"""Removal of repeated passages by FM-indexes.

A window is ``width`` consecutive words of one document.  Every word covered
by a window that also starts earlier (smaller doc_id, or earlier in the same
document) is removed.

Equal windows must meet, so windows are dealt to shards by content: a window's
anchor is the smallest hash among its ``anchor_words``-word runs.  Consecutive
windows with one anchor form a segment, the unit that travels.

1. Segments of all documents as hashes: (anchor, content, doc_id, start).
2. Segments whose anchor occurs once in all texts hold no repeated window; the
   rest goes on (``instances``).
3. Equal segments collapse to their first place (an aggregate with map-side
   combine, so a passage that a third of all documents share is one row).  All
   windows of later places are repeats.
4. What is left are first places of different segments with one anchor, which
   may share some of their windows, and segments that repeat themselves.  Each shard builds an FM-index over the
   words of its segments (suffixes ordered by their first 32 words, the
   Burrows-Wheeler transform held in a wavelet matrix of packed bits) and
   streams the segments through it from right to left.  One backward step a
   word keeps the matching statistic, the interval of the longest match of at
   most ``width`` words; where it reaches ``width`` and the interval holds an
   earlier place, the window is reported.
5. An anchor with more than ``hot`` different segments is split further: its
   segments are cut into single windows, which collapse as in 3.

Windows are compared by 64-bit word hashes and 128-bit segment keys.

Defined cases: texts NULL, empty or shorter than a window keep all words; rows
with a NULL doc_id keep all words and are not compared; rows that repeat a
doc_id are documents at the same place, so neither makes the other a repeat;
further columns are kept by ``remove_repeats`` and ignored by
``digest_documents``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import U64, chunks, fresh, materialise, mix64, signed, span_hashes, text_buffer, window_hashes, word_bounds, word_hashes

WIDTH = 20
ANCHOR_WORDS = 5
#: Different segments of one anchor that go to one shard.
HOT = 2000
#: Bytes of text that one numpy pass works on: several workers of one executor hold such a pass at once.
PASS_BYTES = 1 << 19
#: Words that one index holds, about.
SHARD_WORDS = 400_000


# ----------------------------------------------------------------- segments


def segments(words: np.ndarray, first: np.ndarray, width: int, anchor_words: int) -> tuple[np.ndarray, ...]:
    """Segments of texts whose hashed words start at ``first``: text, first
    word (within the text), windows, anchor, content hash, and whether the
    anchor stands in it more than once (else its windows all differ)."""
    runs, run_first = window_hashes(words, first, anchor_words)
    runs = mix64(runs ^ U64(0x243F6A8885A308D3))
    count = np.maximum(np.diff(first) - (width - 1), 0)
    base = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(base[-1]) + np.repeat(run_first[:-1] - base[:-1], count)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64), none > 0
    least = runs[at]
    for d in range(1, width - anchor_words + 1):
        np.minimum(least, runs[at + d], out=least)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[base[:-1][count > 0]] = True
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(least)))
    text = np.searchsorted(base, begin, "right") - 1
    start = begin - base[text]
    place = first[text] + start
    span = n + width - anchor_words
    edge = np.cumsum(span) - span
    anchors = runs[np.arange(span.sum()) + np.repeat(run_first[text] + start - edge, span)] == np.repeat(least[begin], span)
    return text, start, n, least[begin], span_hashes(words, place, place + n + width - 1), np.add.reduceat(anchors, edge, dtype=np.int64) > 1


def again(text: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether an equal segment stands earlier in the same text."""
    order = np.lexsort((np.arange(len(text)), content, anchor, text))
    same = np.zeros(len(text), bool)
    t, a, c = text[order], anchor[order], content[order]
    same[order[1:]] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    return same


_INSTANCE = "anchor bigint, content bigint, doc_id bigint, start int, n int, again boolean, inner boolean"
_NAMES = ["anchor", "content", "doc_id", "start", "n", "again", "inner"]


def _rows(anchor, content, doc, start, n, repeated, inner) -> pa.RecordBatch:
    columns = [pa.array(signed(anchor)), pa.array(signed(content)), doc, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(repeated), pa.array(inner)]
    return pa.record_batch(columns, names=_NAMES)


def all_segments(docs: DataFrame, width: int, anchor_words: int) -> DataFrame:
    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id")
            for i, _, buf, off in chunks(part.column("text"), PASS_BYTES):
                starts, ends, first = word_bounds(buf, off)
                text, start, n, anchor, content, inner = segments(word_hashes(buf, starts, ends, lower=False), first, width, anchor_words)
                yield _rows(anchor, content, ids.take(pa.array(text + i)), start, n, again(text, anchor, content), inner)

    return docs.mapInArrow(build, _INSTANCE)


def collapse(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(later places, first places with the number of different segments of
    their anchor) of segments; ``instances`` is read twice."""
    single = instances.filter(~F.col("again")).groupBy("anchor", "content").agg(F.min("doc_id").alias("_doc"))
    different = single.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"))
    # Joins, not windows: Spark splits the partitions that a hot segment fills.
    placed = instances.join(single, ["anchor", "content"])
    later = placed.filter(F.col("again") | (F.col("doc_id") > F.col("_doc"))).select("doc_id", "start", "n")
    firsts = placed.filter(~F.col("again") & (F.col("doc_id") == F.col("_doc"))).join(different, "anchor")
    return later, firsts.select("anchor", "doc_id", "start", "n", "different", "inner")


def with_spans(docs: DataFrame, spans: DataFrame, how: str, name: str = "_spans") -> DataFrame:
    """Documents with the list ``name`` of their ``spans`` (doc_id, ...); a
    list is bounded by its document."""
    fields = [c for c in spans.columns if c != "doc_id"]
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias(name))
    return docs.join(grouped.hint("merge"), "doc_id", how)


# ------------------------------------------------------------------ FM-index


class Wavelet:
    """Wavelet matrix: rank of a symbol in a prefix of a sequence; one packed
    bit a level and symbol, and a counter each 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, U64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Backward search over a sequence of symbols from 1 (0 ends a segment),
    with suffixes ordered by their first 32 symbols."""

    def __init__(self, text: np.ndarray, size: int, width: int) -> None:
        n = len(text)
        rank, order, depth_rank = text.astype(np.int64), np.argsort(text, kind="stable"), None
        h = 1
        while h < 32:
            if h <= width < 2 * h:  # ranks by the first `width` symbols, from those by h
                depth_rank = self._ranks(rank, width - h, n)[0]
            rank, order = self._ranks(rank, h, n)
            h *= 2
        self.order = order
        self.transform = text[order - 1]  # the last symbol ends a segment
        self.wavelet = Wavelet(self.transform, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        by_depth = depth_rank[order]
        self.group_start = np.flatnonzero(np.append(True, by_depth[1:] != by_depth[:-1]))
        self.group = np.cumsum(np.append(True, by_depth[1:] != by_depth[:-1])) - 1
        self.group_end = np.append(self.group_start[1:], n)
        self.earliest = np.minimum.reduceat(order, self.group_start)

    @staticmethod
    def _ranks(rank: np.ndarray, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, order) by (rank at i, rank at i + step); the end sorts first."""
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        return out, order

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol on the left."""
        return self.before[symbol] + self.wavelet.rank(symbol, low), self.before[symbol] + self.wavelet.rank(symbol, high)

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches cut to ``width`` symbols."""
        group = self.group[low]
        return self.group_start[group], self.group_end[group]


def repeated_windows(words: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For segments in the order of their places: whether each window also
    starts earlier in one of them."""
    sizes = np.array([len(w) for w in words])
    codes, distinct = pd.factorize(np.concatenate(words))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    text[inside] = codes + 1
    index = FMIndex(text, len(distinct) + 1, width)
    found = np.zeros(begin[-1], bool)
    by = np.argsort(-sizes, kind="stable")
    low, high, depth = np.zeros(len(by), np.int64), np.full(len(by), len(text)), 0
    for step in range(int(sizes.max())):
        active = int(np.searchsorted(-sizes[by], -step, "left"))  # segments with more than `step` words
        at = begin[by[:active]] + sizes[by[:active]] - 1 - step
        low, high = index.extend(text[at], low[:active], high[:active])
        depth += 1
        if depth > width:
            low, high = index.widen(low)
            depth = width
        if depth == width:
            found[at] = index.earliest[index.group[low]] < at
    return [found[b : b + max(0, s - width + 1)] for b, s in zip(begin, sizes, strict=False)]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# ---------------------------------------------------------------- the stages


def repeats(docs: DataFrame, width: int = WIDTH, anchor_words: int = ANCHOR_WORDS, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Runs of repeated windows: (doc_id, start, n): the ``n`` windows from
    word ``start`` on are repeats.  ``docs``: (doc_id, text)."""
    every = all_segments(docs, width, anchor_words)
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("_c"), F.max("inner").alias("_inner")).filter("_c > 1 or _inner").select("anchor")
    instances = materialise(every.join(shared, "anchor"))
    later, firsts = collapse(instances)
    firsts = materialise(firsts.filter("different > 1 or inner"))
    total = firsts.agg(F.sum(F.col("n") + (width - 1)).alias("words"), F.max("different").alias("most")).first()
    shards = max(12, -(-(total["words"] or 0) // shard_words))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans = part.column("_spans").to_pylist()
            out: list[tuple] = []
            for i, j, buf, off in chunks(part.column("text"), PASS_BYTES):
                starts, ends, first = word_bounds(buf, off)
                for row in range(i, j):
                    doc, base = part.column("doc_id")[row].as_py(), first[row - i]
                    for s in spans[row]:
                        a, b = base + s["start"], base + s["start"] + s["n"] + width - 2
                        out.append((s["anchor"] % shards, doc, s["start"], buf[starts[a] : ends[b]].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "doc_id", "start", "words"])

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, spans = part.column("doc_id"), part.column("_spans").to_pylist()
            for i, j, buf, off in chunks(part.column("text"), PASS_BYTES):
                starts, ends, first = word_bounds(buf, off)
                content, content_first = window_hashes(word_hashes(buf, starts, ends, lower=False), first, width)
                text, start, anchor = [], [], []
                for row in range(i, j):
                    for s in spans[row]:
                        text.append(np.full(s["n"], row - i))
                        start.append(np.arange(s["start"], s["start"] + s["n"]))
                        anchor.append(np.full(s["n"], s["anchor"], np.int64))
                text, start, anchor = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (text, start, anchor))
                content = content[content_first[text] + start]
                order = np.lexsort((start, text))
                text, start, anchor, content = text[order], start[order], anchor[order].view(U64), content[order]
                yield _rows(anchor, content, ids.take(pa.array(text + i)), start, np.ones(len(text), np.int64), again(text, anchor, content), np.zeros(len(text), bool))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        buf, off = text_buffer(group.column("words").cast(pa.string()))
        starts, ends, first = word_bounds(buf, off)
        words = word_hashes(buf, starts, ends, lower=False)
        doc, at, n = [], [], []
        ids, begin = group.column("doc_id").to_pylist(), group.column("start").to_pylist()
        for k, mask in enumerate(repeated_windows([words[a:b] for a, b in zip(first, first[1:], strict=False)], width)):
            for a, b in zip(*runs_of(mask), strict=True):
                doc.append(ids[k])
                at.append(begin[k] + int(a))
                n.append(int(b - a))
        return pa.table([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "start", "n"])

    spans = "doc_id bigint, start int, n int"
    mild = with_spans(docs, firsts.filter(F.col("different") <= hot).select("doc_id", "anchor", "start", "n"), "inner")
    partly = mild.mapInArrow(cut, "shard bigint, doc_id bigint, start int, words binary").groupBy("shard").applyInArrow(search, spans)
    out = later.unionByName(partly)
    if (total["most"] or 0) > hot:
        crowded = with_spans(docs, firsts.filter(F.col("different") > hot).select("doc_id", "anchor", "start", "n"), "inner")
        out = out.unionByName(collapse(materialise(crowded.mapInArrow(windows, _INSTANCE)))[0])
    return out


def kept_words(starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, as bytes; and their ends."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    out = np.append(buf, np.uint8(0x20))[np.arange(total) + np.repeat(starts - (stop - size), size)]
    out[stop - 1] = 0x20
    return out, np.concatenate([[0], stop])


def apply_repeats(docs: DataFrame, found: DataFrame, width: int, digests: bool) -> DataFrame:
    """Documents without the words that ``found`` covers: digest columns, or
    all columns with the text changed where words went."""
    name = fresh(docs, "_spans")
    joined = with_spans(docs, found, "left", name)
    columns = docs.dtypes

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans, texts, total, gone = part.column(name).to_pylist(), [], [], []
            for i, j, buf, off in chunks(part.column("text"), PASS_BYTES):
                starts, ends, first = word_bounds(buf, off)
                change = np.zeros(len(starts) + 1, np.int32)
                for row in range(i, j):
                    for s in spans[row] or ():
                        change[first[row - i] + s["start"]] += 1
                        change[first[row - i] + s["start"] + s["n"] + width - 1] -= 1
                keep = np.cumsum(change[:-1]) == 0
                out, edge = kept_words(starts[keep], ends[keep], buf)
                kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
                n, left = np.diff(first), np.diff(kept_first)
                total += n.tolist()
                gone += (n - left).tolist()
                for row in range(j - i):
                    a, b = edge[kept_first[row]], edge[kept_first[row + 1]]
                    if digests:
                        texts.append(hashlib.sha256(out[a : max(a, b - 1)].tobytes()).hexdigest())
                    else:
                        texts.append(out[a : max(a, b - 1)].tobytes().decode() if n[row] > left[row] else None)
            if digests:
                yield pa.record_batch([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=_DIGEST_NAMES)
            else:
                old = part.column("text")
                new = pa.array([o if t is None else t for o, t in zip(old.to_pylist(), texts, strict=True)], old.type)
                yield pa.record_batch([new if c == "text" else part.column(c) for c, _ in columns], names=[c for c, _ in columns])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" if digests else ", ".join(f"`{c}` {t}" for c, t in columns)
    return joined.mapInArrow(build, schema)


_DIGEST_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def digest_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Digest rows of all documents."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = docs.filter(F.col("doc_id").isNotNull())
    out = apply_repeats(named, repeats(named, width), width, digests=True)
    alone = docs.filter(F.col("doc_id").isNull())
    none = docs.sparkSession.createDataFrame([], "doc_id bigint, start int, n int")
    return out.unionByName(apply_repeats(alone, none, width, digests=True))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs``; a text that lost words is its kept
    words joined by one space, every other text stays as it is."""
    named = docs.filter(F.col("doc_id").isNotNull())
    found = repeats(named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width)
    return apply_repeats(named, found, width, digests=False).unionByName(docs.filter(F.col("doc_id").isNull()))
