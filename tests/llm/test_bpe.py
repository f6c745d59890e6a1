import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from clickloom.llm import bpe

from .helpers import corpus, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_pieces_equal_the_library(library):
    rng = np.random.default_rng(1)
    alphabet = list("ab s tm drevl'  \n\t'1２é漢. !'\x85　\x1c\r𝔘")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(5000)]
    texts += [t for _, t in corpus() if t] + ["I'll we've 're ''s 'S don't  x", "<|endoftext|>", "a" * 5000]
    encoder = bpe.PieceEncoder.of(PATH, P.PATTERN)
    for text, (_, ids) in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_json_vocabulary_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [x or "" for _, x in corpus()]
    got = [ids.tolist() for _, ids in bpe.PieceEncoder.of(path, P.PATTERN).encode(pa.array(texts))]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert bpe.read_ranks(path) == bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (40, 4), (1 << 15, 1 << 10)])
def test_chunked_texts_are_stitched_exactly(spark, library, chunk, overlap):
    rows = [*corpus(), (900, "x" * 300 + " y"), (901, "ab  \n\n   " * 40), (901, "ab  \n\n   " * 40), (None, "z " * 100)]
    got = bpe.encode_documents(frame(spark, rows), PATH, P.PATTERN, chunk, overlap).collect()
    want = [(i if i is not None else -1, library.encode_ordinary(t or "")) for i, t in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == sorted(want)
    digests = bpe.encode_documents(frame(spark, rows), PATH, P.PATTERN, chunk, overlap, digests=True).collect()
    text = {i: t or "" for i, t in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in digests)
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, rows), PATH, P.PATTERN, chunk, overlap), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == text[r.doc_id] for r in back)


def test_empty_table(spark):
    assert bpe.encode_documents(frame(spark, []), PATH, P.PATTERN).count() == 0
