import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from clickloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, n_convs string, k int, id int"


def brute(rows, shared=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:] if shared else own[c]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].decode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA)


def make(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-250, 420), n), 100, 200, 10**14 + 7]:
        for t in range(rng.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["é" * 3, "a", "b", None, "", "x" * 50, "𝔘"])))
    rows += [(300 + i, t, "user", "copy") for i in range(40) for t in range(4)]
    rows += [(350, t, "user", f"long {t}") for t in range(120)] + [(351, 0, "u", "same")] * 9 + [(None, 1, "user", "nobody's"), (7, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # many blocks, rulers, carries and joined ranges
        for name, value in {"DEPTHS": 7, "CONV_BITS": 2, "DEPTH_BITS": 2, "RULER": 3, "SMALL": 20, "SUM_BITS": 3, "ID_BITS": 1}.items():
            monkeypatch.setattr(trie, name, value)
    rows = make(4)
    got = trie.shared_trie(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(brute(rows), key=lambda r: r[:2])


def test_conversations_as_they_stand(spark):
    rows = make(9, 20)
    got = trie.conversation_trie(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(brute(rows, shared=False), key=lambda r: r[:2])


def test_small_tables(spark):
    assert trie.shared_trie(table(spark, [])).collect() == []
    # 205 takes h = 1..5 turns from conversation 200, which is absent, and has one turn of its own
    turnless = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6)
    for rows in ([(turnless, 0, "user", "only")], [(100, None, None, None)], [(turnless, 0, "u", "x" * 200_000), (100, 0, "u", "x" * 200_000)]):
        got = trie.shared_trie(table(spark, rows)).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_chain_ranks():
    rng = np.random.default_rng(1)
    order = rng.permutation(50) * 3  # a list over these ids
    after = np.append(order[1:], -1)
    part = np.sort(rng.permutation(50)[:31])
    head, offset, leaves = trie.chain_ranks(order[part], after[part], np.arange(50)[part])
    for i, p in enumerate(part):
        first = p
        while first - 1 in part:
            first -= 1
        assert part[head[i]] == first and offset[i] == sum(range(first, p)) and leaves[i] == (p + 1 not in part)
