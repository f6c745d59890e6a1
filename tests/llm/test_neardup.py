import numpy as np
import pytest

from clickloom.llm import neardup

from .helpers import corpus, frame, words


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("small", [16, 2])
def test_equals_brute_force(spark, small):
    rows = corpus(seed=5, n=120)
    got = neardup.group_documents(frame(spark, rows), small=small).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert any(not r.kept for r in got)


def test_edges(spark):
    assert neardup.group_documents(frame(spark, [])).count() == 0
    rows = [(4, "a b"), (2, "A  b"), (9, None), (3, ""), (1, "c"), (4, "a b"), (None, "a b"), (None, None)]
    got = neardup.group_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 0, -1, True), (-1, 1, -1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False), (4, 1, 2, False), (9, 0, 9, True),
    ]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint").repartition(8)
    got = {r.doc_id: r.component_id for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_signature_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (30, 10, 10))
        h = np.concatenate([both, a, both, b])
        text = np.repeat([0, 1], 40)
        order = np.lexsort((h, text))
        reg = neardup.superminhash(h[order], text[order], 2)
        assert (reg >> np.uint64(56)).max() < neardup.REGISTERS
        errors.append((reg[0] == reg[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.012
    assert np.var(errors) < 0.6 * 0.4 / neardup.REGISTERS  # below that of independent hashes


def family(seed, n, low, high, length=160):
    """Variants of one text, without the text itself."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(length)], []
    for i in range(n):
        w = list(base)
        for at in rng.choice(length, rng.integers(low, high + 1), replace=False):
            w[at] = f"v{i}x{at}"
        out.append((i, " ".join(w)))
    return out


def test_large_family_without_a_hub(spark):
    rows = family(1, 400, 2, 3)
    got = neardup.group_documents(frame(spark, rows)).collect()
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 1
    assert sorted(tuple(r) for r in got) == want


def test_remainder_links_what_pivots_miss(spark, monkeypatch):
    """Pivots and split bands show nothing here: all links come from the remainder, over several blocks."""
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 8)
    rows = family(1, 90, 1, 5)
    docs = frame(spark, rows).select("doc_id", "text")
    marked = neardup.signatures(docs)
    _, crowded = neardup.candidates(marked, 85, 16)
    alone = docs.select("doc_id", neardup.F.col("doc_id").alias("component_id")).limit(0)
    found = {r.doc_id: r.component_id for r in neardup.components(neardup.remainder(crowded, marked, docs, alone, 85)).collect()}
    in_large = {r.doc_id for r in crowded.collect()}
    assert {i: found.get(i, i) for i in in_large} == {i: c for i, _, c, _ in brute([r for r in rows if r[0] in in_large])}


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_search_follows_the_threshold(percent):
    """Links right at the threshold are lost with probability 1e-6 at most, by bands and by sketch."""
    s = percent / 100
    bands, width = neardup.banding(percent)
    assert bands * width <= neardup.REGISTERS and (1 - s**width) ** bands <= 1e-6
    differ = np.random.default_rng(4).binomial(neardup.REGISTERS, (1 - s) / 2, 1_000_000)
    assert (differ > neardup.max_bits(percent)).sum() < 8


def test_lower_threshold_equals_brute_force(spark):
    rows = corpus(seed=12, n=80)
    got = neardup.group_documents(frame(spark, rows), percent=80).collect()
    assert brute(rows, 80) != brute(rows)
    assert sorted(tuple(r) for r in got) == brute(rows, 80)


def test_repeated_ids_with_different_texts(spark):
    """Links of every text of an id count; the id's rows have one component."""
    rng = np.random.default_rng(6)
    text = lambda: [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    a, b, c = text(), text(), text()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (7, " ".join(c)), (5, near(c)), (7, None), (9, near(c) + " x"), (9, " ".join(a[:40])), (8, ""), (1, " ".join(b))]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.group_documents(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (7, 5, False), (9, 5, False), (8, 8, True)}


def test_remainder_explodes_no_bucket_of_one_group(spark):
    """Where all members of the large buckets are in one group, nothing is fetched for them."""
    rows = family(1, 60, 0, 1)
    docs = frame(spark, rows).select("doc_id", "text")
    marked = neardup.signatures(docs)
    _, crowded = neardup.candidates(marked, 85, 16)
    one = docs.select("doc_id", neardup.F.lit(0).cast("bigint").alias("component_id"))
    assert crowded.count() > 16 and neardup.remainder(crowded, marked, docs, one, 85).count() == 0
