import hashlib
import random
import zlib

import pytest

from clickloom.llm import merkle

from .helpers import corpus

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, lo bigint, hash string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes):
    """(root, for each leaf its list of (siblings before, siblings after))."""
    proofs, under = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, over = [], []
        for i in range(0, len(hashes), 3):
            run = hashes[i : i + 3]
            for k in range(len(run)):
                for x in under[i + k]:
                    proofs[x].append((run[:k], run[k + 1 :]))
            up.append(H(*run))
            over.append([x for u in under[i : i + 3] for x in u])
        hashes, under = up, over
    return hashes[0], proofs


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        by[name].sort(key=lambda x: x[:3])
        trees.append(tree([x[2] for x in by[name]]))
    root, above = tree([t[0] for t in trees])
    out = []
    for name, (sub, proofs), up in zip(names, trees, above, strict=True):
        for (_, _, own, r), proof in zip(by[name], proofs, strict=True):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf((*r[:4], text))
            for a, b in proof + up:
                h = H(*a, h, *b)
            out.append((r[0], own, sub, root, H(*[x for a, b in proof + up for x in a + b]), h, h == root))
    return sorted(out, key=str)


def rows_of(n_sources, seed=5):
    rng = random.Random(seed)
    docs = [(i, rng.choice([None, *[f"s{k}é" for k in range(n_sources)]]) if i % 3 else "hot", rng.choice(["en", None, ""]), len(t or "") if i and i % 7 else None, t) for i, t in corpus(seed)]
    docs += [docs[4]] * 30 + [(None, "hot", None, None, None), (None, None, None, 1, "a\nb"), (5, "hot", "x", 2, "other text\n\n"), (10**12, "alone", "y", 0, "\n" * 3000)]
    return docs


@pytest.mark.parametrize("band,n_sources", [(1, 40), (2, 4), (6, 4)])
def test_equals_brute_force(spark, monkeypatch, band, n_sources):
    monkeypatch.setattr(merkle, "BAND", band)
    monkeypatch.setattr(merkle, "WIDTH", merkle.FAN**band)
    rows = rows_of(n_sources)
    full = [(i, t, lang, s, n, "l", "t", 1, "h") for i, s, lang, n, t in rows]
    got = merkle.check_documents(spark.createDataFrame(full, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_tables(spark):
    one = [(7, "s", None, None, "x\ny")]
    for rows in ([], one, one * 2, [(1, None, None, None, None), (2, "", "", 0, "")]):
        full = [(i, t, lang, s, n, None, None, None, None) for i, s, lang, n, t in rows]
        got = merkle.check_documents(spark.createDataFrame(full, SCHEMA)).collect()
        assert sorted(map(tuple, got), key=str) == (brute(rows) if rows else [])


def test_fold_needs_every_step(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i, "", "", 0, "") for i in range(11)], SCHEMA)
    proved = merkle.manifest(docs.select("source", "doc_id", merkle.leaf_hash().alias("leaf"))).collect()
    for r in proved:
        assert len(r.left) == len(r.right) == merkle.height(11)
        h = r.leaf
        for a, b in zip(r.left, r.right, strict=True):
            h = H(a, h, b)
        assert h == r.root == r.subroot  # one source: its subroot is the root
