"""Inputs and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import random
import re

SEPARATED = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Extra columns whose names clash with names that operators use.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, batch int, shard int, term string, anchor string, _spans string, rank int, label int"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return SEPARATED.findall(raw.translate(LOWER) if lower else raw)


def corpus(seed: int = 3, n: int = 60, vocabulary: int = 40) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, odd blanks, NULLs,
    empty texts, repetitions and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "!"])
    vocab = [word() for _ in range(vocabulary)] + ["The", "the", "I'll", "ｘ２", "\x1c", "𝔘"]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    base, passage, out = make(120), make(30), []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
        elif kind == 1:
            w = make(rng.randint(0, 20)) + passage + make(rng.randint(0, 20))
        elif kind == 2:
            w = make(3) * rng.randint(1, 15)
        elif kind == 3:
            w = make(rng.randint(1, 6))
        else:
            w = make(rng.randint(5, 90))
        out.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in w).strip() if i % 3 else " ".join(w)))
    out += [(n, out[10][1]), (n + 1, out[10][1]), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (n + 5, " ".join(make(4000)))]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    """Documents with clashing extra columns."""
    full = [(i, t, None, "src", len(t) if t is not None else None, None, 1, 2, "x", None, "y", 3, None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
