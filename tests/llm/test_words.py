import numpy as np
import pyarrow as pa

from clickloom.llm.common import chunks, fresh, slices, window_hashes, word_bounds, word_hashes

from .helpers import corpus, frame, words


def test_words_equal_the_pattern_at_every_chunk_size():
    texts = [t for _, t in corpus()]
    for limit in (1, 50, 1 << 20):
        got = [[] for _ in texts]
        for i, j, buf, off in chunks(pa.array(texts), limit):
            starts, ends, first = word_bounds(buf, off)
            for row in range(j - i):
                got[i + row] = [buf[a:b].tobytes() for a, b in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]], strict=True)]
        assert got == [words(t) for t in texts]


def test_hashes_follow_the_bytes():
    _, _, buf, off = next(chunks(pa.array(["the The the a b c a b c", "a b c"])))
    starts, ends, first = word_bounds(buf, off)
    exact, lower = word_hashes(buf, starts, ends, False), word_hashes(buf, starts, ends, True)
    assert exact[0] == exact[2] != exact[1] and lower[0] == lower[1]
    runs, at = window_hashes(exact, first, 3)
    assert at.tolist() == [0, 7, 8] and runs[3] == runs[6] == runs[7] and len(set(runs.tolist())) == 6


def test_slices_cover_all_rows():
    off = np.array([0, 0, 5, 5, 100, 101])
    assert list(slices(off, 10)) == [(0, 3), (3, 4), (4, 5)]


def test_fresh_names(spark):
    assert fresh(frame(spark, []), "_Spans") == "_Spans_"
