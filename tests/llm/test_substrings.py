import hashlib

import numpy as np
import pytest

from clickloom.llm import substrings

from .helpers import corpus, frame, words


def brute(rows, width):
    """Keep masks by document; windows in the order of (doc_id, start)."""
    seen, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), (i, k)) != (i, k):
                keep[k : k + width] = [False] * width
        out[i] = (len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep, strict=True) if y))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
@pytest.mark.parametrize("width,anchor", [(20, 5), (6, 2)])
def test_equals_brute_force(spark, width, anchor, hot):
    rows = corpus(seed=8, n=90)
    docs = frame(spark, rows)
    found = substrings.repeats(docs.select("doc_id", "text"), width, anchor, hot=hot, shard_words=200)
    got = substrings.apply_repeats(docs.select("doc_id", "text"), found, width, digests=True).collect()
    want = {i: (n, k, hashlib.sha256(t).hexdigest()) for i, (n, k, t) in brute(rows, width).items()}
    assert {r.doc_id: tuple(r[1:4]) for r in got} == want and len(got) == len(rows)
    assert any(k for _, k, _ in want.values())


def test_texts_change_only_where_words_go(spark):
    rows = corpus(seed=9, n=60)
    out = substrings.remove_repeats(frame(spark, rows))
    assert out.dtypes == frame(spark, []).dtypes
    want, text = brute(rows, 20), dict(rows)
    for r in out.collect():
        n, gone, kept = want[r.doc_id]
        assert r.text == (kept.decode() if gone else text[r.doc_id])
        assert (r.source, r._spans, r.score) == ("src", "y", None)


def test_edges(spark):
    assert substrings.digest_documents(frame(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(3, long), (3, long), (None, long), (5, None), (6, ""), (7, long)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in substrings.digest_documents(frame(spark, rows)).collect())
    assert got == [(-1, 30, 0), (3, 30, 0), (3, 30, 0), (5, 0, 0), (6, 0, 0), (7, 30, 30)]


def test_fm_index_finds_every_earlier_window():
    rng = np.random.default_rng(1)
    for _ in range(200):
        base = rng.integers(0, rng.integers(2, 30), 60).astype(np.uint64)
        segments = []
        for _ in range(rng.integers(1, 8)):
            a, n = rng.integers(0, 30), rng.integers(5, 25)
            s = base[a : a + n].copy()
            if rng.random() < 0.4:
                s[rng.integers(0, n)] = 99
            segments.append(s)
        seen = set()
        for s, got in zip(segments, substrings.repeated_windows(segments, 5), strict=True):
            want = []
            for k in range(len(s) - 4):
                window = tuple(s[k : k + 5])
                want.append(window in seen)
                seen.add(window)
            assert got.tolist() == want


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 300):
        symbols = rng.integers(0, size, 500)
        wavelet = substrings.Wavelet(symbols, size)
        at, c = rng.integers(0, 501, 200), rng.integers(0, size, 200)
        assert wavelet.rank(c, at).tolist() == [int((symbols[:a] == x).sum()) for a, x in zip(at, c, strict=True)]
