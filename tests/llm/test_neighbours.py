from collections import defaultdict

import numpy as np
import pytest

from clickloom.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int, shard int, v string"


def brute(rows, every, k):
    held = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in held:
        if q % every:
            continue
        near = [(-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in held if i != q and len(b) == len(a)]
        out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, None, 2, 3, "x") for i, v in rows], SCHEMA)


def vectors(n=400, width=8):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # equal vectors: ties fall to the smaller id
    rows += [(2000, None), (2050, [0.0] * width), (2100, [float("nan")] * width), (2150, [1.0, None] + [0.0] * (width - 2)), (2200, [float("inf")] * width), (2250, [])]
    return rows + [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]


@pytest.mark.parametrize("leaf,shards", [(8, 4), (64, 1)])
def test_factor_one_is_exact(spark, leaf, shards, monkeypatch):
    monkeypatch.setattr(neighbours, "shard_count", lambda *_: shards)
    rows = vectors()
    df = table(spark, rows)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0"), leaf=leaf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, 50, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    for q, v in got.items():
        assert np.allclose([s for _, s in v], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_smaller_factors_look_at_less():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree, q = neighbours.Tree(x, 32), x[::40]
    bound = tree.bounds(q)
    exact = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :5]
    looked, recall = [], []
    for factor in (1.0, 0.7, 0.3):
        member, dist = tree.search(q, 5, factor)
        looked.append((bound <= factor * dist[:, -1:] + 2e-7).mean())
        recall.append(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(member, exact, strict=True)]))
    assert recall[0] == 1.0 and looked[0] > looked[1] > looked[2] and recall[1] > 0.9
    # A bound never exceeds a member's distance.
    for k, members in enumerate(tree.leaves):
        assert (neighbours.chord(q @ x[members].T).min(1) >= bound[:, k] - 1e-7).all()


def test_few_candidates_and_empty_table(spark):
    empty = table(spark, [])
    assert neighbours.search_embeddings(empty).count() == 0
    got = neighbours.search_embeddings(table(spark, [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])])).collect()
    assert sorted((r.query_id, r.vec_id) for r in got if r.rank <= 2) == [(50, 3), (50, 4)] or len(got) >= 2


def test_many_different_vectors_of_equal_cosine():
    """Scaled copies (powers of two: exactly equal cosines) hold a third of the rows: the smallest ids win."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 8))
    rows = [(1000 - i, x[i]) for i in range(120)] + [(500 - i, x[0] * 2.0**i) for i in range(1, 61)]
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    table = lambda rows: pa.table([[i for i, _ in rows], [list(v) for _, v in rows]], schema=schema)
    asked = [rows[0], rows[5], (7, x[0] + 0.1 * x[1])]
    got = defaultdict(list)
    for r in neighbours.search_shard(table(rows), table(asked), 5, 1.0, 16).to_pylist():
        got[r["query_id"]].append(r["vec_id"])
    for q, a in asked:
        near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in rows if i != q)
        assert got[q] == [i for _, i in near[:5]]
