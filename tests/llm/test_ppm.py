import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clickloom.llm import ppm
from clickloom.llm.common import chunks, crc_rest

from .helpers import corpus, frame, words


def brute(rows, held, order):
    """Plain PPMD with symbol exclusion, one byte at a time."""
    unigrams, followers = Counter(), defaultdict(Counter)
    for (_, text), out in zip(rows, held, strict=True):
        if out:
            continue
        w = words(text, lower=True)
        unigrams.update(w)
        unigrams[None] += 1
        s = b"\n" * order + b" ".join(w) + b"\n"
        for i in range(order, len(s)):
            for k in range(order + 1):
                followers[s[i - k : i]][s[i]] += 1
    n, v = sum(unigrams.values()), len(unigrams)

    def ln(context, symbol):
        excluded, total = set(), 0.0
        for k in range(order, -1, -1):
            seen = followers.get(context[order - k :])
            if seen is None:
                continue
            mass = 2 * sum(c for s, c in seen.items() if s not in excluded)
            if symbol in seen:
                return total + math.log10((2 * seen[symbol] - 1) / mass)
            if mass:
                total += math.log10(len(seen.keys() - excluded) / mass)
            excluded = set(seen)
        return total - math.log10(252 - len(excluded))

    out = []
    for (i, text), h in zip(rows, held, strict=True):
        w = words(text, lower=True)
        s = b"\n" * order + b" ".join(w) + b"\n"
        base = sum(math.log10((unigrams[x] + 1) / (n + v + 1)) for x in [*w, None])
        score = sum(ln(s[p - order : p], s[p]) for p in range(order, len(s)))
        out.append((i if i is not None else -1, h, len(w) + 1, sum(unigrams[x] > 0 for x in [*w, None]), n, round(base, 6), round(score, 6)))
    return sorted(out)


def run(spark, rows, held_out, **kw):
    got = ppm.score_documents(frame(spark, rows), held_out, **kw).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in got)


def test_equals_brute_force(spark):
    rows = corpus(n=50)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert any(held)
    assert run(spark, rows, crc_rest("doc_id", 7) == 2, order=3, batch_bytes=2000) == brute(rows, held, 3)


def test_probabilities_of_all_next_bytes_sum_to_one(spark):
    """The trie's distribution after some contexts, seen and unseen."""
    texts = [t for _, t in corpus(n=30)]
    pairs = Counter()
    for _, _, buf, off in chunks(pa.array(texts)):
        pairs.update(ppm.grams(buf, off, 2)[0].tolist())
    for context in (b"a ", b"\n\n", b"qq", b"qa"):
        want = [(context[0] << 16) | (context[1] << 8) | s for s in range(256)]
        rows = [(g, pairs.get(g, 0)) for g in {*want, *pairs}]
        got = {r.key: r.value for r in ppm.gram_scores(spark.createDataFrame(rows, "key bigint, c bigint"), 2).collect()}
        never = [s for s in (0x09, 0x0B, 0x0C, 0x0D) if (context[0] << 16) | (context[1] << 8) | s not in pairs]
        total = sum(10 ** got[g] for g in want if (g & 255) not in never)
        assert abs(total - 1) < 1e-9, context


def test_edges(spark):
    assert ppm.score_documents(frame(spark, []), F.lit(False)).count() == 0
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "A b")]
    got = run(spark, rows, F.col("doc_id") == 3, order=2)
    assert got == brute([(i if i is not None else None, t) for i, t in rows], [False, False, False, True, True], 2)
    untrained = run(spark, [(1, "ab")], F.lit(True))
    assert untrained == [(1, True, 2, 0, 0, round(2 * math.log10(1), 6), round(-3 * math.log10(252), 6))]


def test_grams_carry_the_bytes_before():
    _, _, buf, off = next(chunks(pa.array(["Ab  c", "", "d"])))
    g, first = ppm.grams(buf, off, 2)
    texts = [bytes([int(x) >> 16, int(x) >> 8 & 255, int(x) & 255]) for x in g]
    assert texts == [b"\n\na", b"\nab", b"ab ", b"b c", b" c\n", b"\n\n\n", b"\n\nd", b"\nd\n"]
    assert first.tolist() == [0, 5, 6, 8] and np.diff(first).min() == 1
