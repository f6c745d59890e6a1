import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import sharding

from .helpers import corpus, frame


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 99))
def test_matrix_has_the_exact_margins(counts, shards, seed):
    matrix = sharding.communication_matrix(counts, shards, seed)
    assert [sum(r) for r in matrix] == counts
    sizes = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(sizes) - min(sizes) <= 1 and min(map(min, matrix)) >= 0


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(1)
    draws = np.array([sharding.draw_hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(draws.mean() - 6) < 0.05 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    big = np.array([sharding.draw_hypergeometric(rng, 10**9, 3 * 10**9, 10**8) for _ in range(50)])
    assert abs(big.mean() / 2.5e7 - 1) < 1e-3


def test_all_documents_are_placed(spark, monkeypatch):
    rows = corpus() + [(None, "x"), (None, "x"), (3, "again")]
    for ordered in (200_000, 1):
        monkeypatch.setattr(sharding, "ORDERED_ROWS", ordered)
        got = sharding.shard_documents(frame(spark, rows), 7).collect()
        text = defaultdict(list)
        for i, t in rows:
            text[i].append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
        for r in got:
            assert (r.size, r.text_crc32) in text[r.doc_id] and r.law == "rows" and r.grown_shard is None
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_columns_are_kept_and_places_look_uniform(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "id % 3 AS _x")
    out = sharding.shuffle_into_shards(df, "doc_id", 8).collect()
    by = defaultdict(list)
    for r in out:
        assert r._x == r.doc_id % 3
        by[r.shard].append(r.doc_id)
    assert {len(v) for v in by.values()} == {500}
    assert all(abs(np.mean(v) - 2000) < 250 for v in by.values())  # five standard deviations
    slots = np.array([(r.slot, r.doc_id) for r in out])
    assert abs(np.corrcoef(slots.T)[0, 1]) < 0.08
