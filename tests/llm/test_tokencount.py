import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from clickloom.llm import tokencount

from .helpers import corpus, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PATH)


def expected(model, rows, limit):
    n = {i: len(model.encode(t or "")) for i, t in enumerate(t for _, t in rows)}
    return sorted(((d, len((t or "").encode()), n[k], n[k] > limit) for k, (d, t) in enumerate(rows)), key=str)


def hard_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abethéあ\U0001f600\u0007") for _ in range(rng.randint(1, 9)))
    return [
        "a" * 3000,  # one piece repeated: no stable boundary at all
        " " * 2500 + "x" + " " * 700,
        "ab" * 700 + " middle " + "=" * 1500,
        "▁ ▁▁  <s>\x00</s>" * 120,
        "\U0001f600" * 900,  # characters that are no piece: every boundary is stable
        " ".join(word() for _ in range(900)),
        "".join(word() for _ in range(700)),
        "the  \n" * 400 + "a" * 600 + " the" * 300,
    ]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 40), (97, 2), (1 << 15, 1 << 10)])
def test_equals_the_library(spark, model, chunk, overlap):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(hard_texts())] + [(None, "x " * 400), (None, None), (1000, "a" * 3000), (5, "again " * 90)]
    got = tokencount.count_tokens(frame(spark, rows), PATH, limit=50, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(model, rows, 50)


def test_empty_table(spark):
    assert tokencount.count_tokens(frame(spark, []), PATH).collect() == []


def test_widened_overlaps(spark, model, monkeypatch):
    """Boundaries further apart than the first overlaps take more rounds."""
    seen = []
    keep = tokencount.materialise
    monkeypatch.setattr(tokencount, "materialise", lambda df: seen.append(df.columns) or keep(df))
    rows = [(1, ("a" * 500 + " ") * 8), (2, "word " * 900)]
    got = tokencount.count_tokens(frame(spark, rows), PATH, chunk=128, overlap=8)
    assert sorted(map(tuple, got.collect())) == expected(model, rows, tokencount.LIMIT)
    assert len([c for c in seen if "tail" in c]) > 1


TEXT = st.text(st.sampled_from("ab the.é▁\nあ<s>\U0001f600"), min_size=30, max_size=200)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT, st.integers(4, 30))
def test_stable_boundaries_hold_in_any_text(model, left, right, overlap):
    """Counts add up at a boundary that two overlapping chunks agree on."""
    counter = tokencount.Counter.of(PATH)
    text = left + right
    size = len(left)
    a = counter.splices(text[: size + overlap], size, overlap, True)
    b = counter.splices(text[size:], len(text), overlap, False)
    assert a[3] == b[1]
    if a[3] is not None:
        assert a[4] + b[0] - b[2] == len(model.encode(text))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        tokencount.Counter(str(tmp_path / "m.model"))
