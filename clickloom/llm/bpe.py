"""Byte-level BPE over whole texts.

Pre-tokenising is a vectorised form of the pattern of the rank files
(``public_tokenizers.PATTERN``): characters are classed (letter, number, other,
blank) by one table and the pattern's alternatives become rules on where
classes change.  Each distinct piece of a chunk is merged once, by tiktoken's
own merge routine, and the ids of all its places are gathered from that.

Texts above ``chunk_chars`` are cut into overlapping chunks that are
pre-tokenised apart, on all executors.  The pattern never looks back, so two
pre-tokenisations that share one boundary agree from there on: a chunk hands
over to the next at the first boundary of their overlap that both have.  Where
an overlap has no common boundary (a run longer than the overlap), the text is
encoded in one piece instead, so the result never depends on the cut.
Decoding concatenates the raw bytes of the ids.

Defined cases: text NULL or empty gives no ids; repeated rows are encoded one
by one; further columns are not carried along; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import CHUNK_BYTES, chunks, mix64, span_hashes

LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4
#: Bytes of distinct pieces and their ids that a Python worker keeps, about.
CACHE_BYTES = 72 << 20
#: Bytes of text that are pre-tokenised together: arrays of 8 bytes a character are made of it.
ENCODE_BYTES = CHUNK_BYTES // 4

ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of the vocabulary of a byte-level
    ``.json`` tokenizer, whose tokens are written in printable characters."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


class PieceEncoder:
    """Ids of texts, a batch at a time; one per Python worker and rank file."""

    _made: dict[tuple[str, str], PieceEncoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> PieceEncoder:
        key = path, pattern
        if key not in cls._made:
            cls._made[key] = cls(path, pattern)
        return cls._made[key]

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        ranks = read_ranks(path)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held = 0
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = np.frombuffer(points.encode("utf-32-le"), np.uint32)
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            self.kind[[ord(c) for c in regex.findall(what, points)]] = kind
        assert len(at) == len(points)
        self.symbol = mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED2701))
        size = max(ranks.values()) + 1
        self.token_len = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.token_len[i] = len(token)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        flat = bytearray(int(self.token_at[-1]))
        for token, i in ranks.items():
            flat[self.token_at[i] : self.token_at[i] + len(token)] = token
        self.token_bytes = np.frombuffer(bytes(flat), np.uint8)

    def piece_starts(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pattern's matches start in texts that lie one after the
        other in ``cp`` (code points) at ``off``."""
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[cp]
        first = np.zeros(n + 1, bool)
        first[off] = True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 0, kind[:-1]
        before[first[:n]] = 0
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = 0, kind[1:]
        after[first[1:]] = 0
        changes = kind != before
        joined = np.zeros(n, bool)  # the character before is a space that this run takes along
        joined[1:] = cp[:-1] == 0x20
        joined[first[:n]] = False
        blank = kind == BLANK
        # A run starts a match unless it joins a space; so does a blank run, and the last blank before something else.
        start = (changes & (blank | ~joined)) | (blank & (after != 0) & (after != BLANK))
        quote = np.flatnonzero((cp == 0x27) & changes & ~joined & (after == LETTER))
        if len(quote):
            end = off[np.searchsorted(off, quote, "right")]
            one = cp[quote + 1]
            two = np.where(quote + 2 < end, cp[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            for hit, width in ((short, 2), (long, 3)):
                at = quote[hit] + width
                start[at[at < end[hit]]] = True
        return np.flatnonzero(start)

    def ids(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, distinct = pd.factorize(span_hashes(self.symbol[cp], starts, ends))
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cache, merge, found = self.cache, self.merge, []
        for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            piece = text[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece.encode())
                if b - a < 64:
                    cache[piece] = ids = tuple(ids)
                    self.held += 200 + 4 * (b - a) + 40 * len(ids)
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        return gather(flat, np.concatenate([[0], np.cumsum(size)]), size, codes), size[codes]

    def encode(self, arr: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text of a column, in order."""
        for i, j, buf, off in chunks(arr, ENCODE_BYTES):
            text = buf.tobytes().decode("utf-8")
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off] if len(buf) else off
            starts = self.piece_starts(cp, chars)
            ids, size = self.ids(text, cp, starts, np.append(starts[1:], len(cp)))
            at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, chars, "left")]
            for row in range(i, j):
                yield row, ids[at[row - i] : at[row - i + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_at, self.token_len, ids).tobytes()


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices flat[at[c] : at[c] + size[c]] of all codes, joined."""
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at[codes] - (ends - n), n)]


def digest_row(encoder: PieceEncoder, ids: np.ndarray) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        hashlib.sha256(encoder.decode(ids)).hexdigest(),
    )


def file_row(encoder: PieceEncoder, ids: np.ndarray) -> tuple[int, bytes, bytes]:
    return len(ids), ids.astype("<u4").tobytes(), encoder.decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk_chars: int = 1 << 15, overlap: int = 1 << 10, digests: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the ids as little-endian
    unsigned 32-bit integers and the bytes that they decode to, or with
    ``digests`` the SHA-256 of both."""
    if digests:
        make: Callable = digest_row
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    else:
        make, schema = file_row, ENCODED_SCHEMA
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def table(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.record_batch([pa.array(c, t.type) for c, t in zip([ids, *columns], out, strict=True)], schema=out)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path, pattern)
        for part in parts:
            yield table(part.column("doc_id").to_pylist(), [make(encoder, ids) for _, ids in encoder.encode(part.column("text"))])

    def boundaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path, pattern)
        for part in parts:
            starts = []
            for text, last in zip(part.column("text").to_pylist(), part.column("last").to_pylist(), strict=True):
                cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                at = encoder.piece_starts(cp, np.array([0, len(cp)]))
                starts.append(at if last else at[at < len(cp) - 3])  # a match that needs more characters than the chunk has
            yield part.append_column("starts", pa.array([s.astype(np.int32) for s in starts], pa.list_(pa.int32())))

    def stitched(group: pa.Table) -> pa.Table:
        encoder, got = PieceEncoder.of(path, pattern), []
        for r in group.sort_by("part").to_pylist():
            at = np.array(r["starts"], np.int64)
            at = at[(at >= r["low"]) & (at < r["high"])]
            cp = np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)
            got.append(encoder.ids(r["text"], cp, at, np.append(at[1:], r["high"]))[0])
        return pa.Table.from_batches([table([group.column("doc_id")[0].as_py()], [make(encoder, np.concatenate(got))])])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    chars = F.length("text")
    short = docs.filter(F.col("text").isNull() | (chars <= chunk_chars)).mapInArrow(whole, schema)
    long = docs.filter(chars > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    cut = (
        long.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((chars - 1) / chunk_chars).cast("int"))))
        .select(
            "row",
            "doc_id",
            "part",
            ((F.col("part") + 1) * chunk_chars >= chars).alias("last"),
            F.expr(f"substring(text, part * {chunk_chars} + 1, {chunk_chars + overlap})").alias("text"),
        )
        .repartition("row", "part")
    )
    found = cut.mapInArrow(boundaries, "row bigint, doc_id bigint, part int, last boolean, text string, starts array<int>")
    by_row = Window.partitionBy("row").orderBy("part")
    tail = F.transform(F.filter("starts", lambda s: s >= chunk_chars), lambda s: s - chunk_chars)
    head = F.filter("starts", lambda s: s < overlap)
    met = (
        found.withColumn("low", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag(tail).over(by_row), head))))
        .withColumn("next_low", F.lead("low").over(by_row))
        .withColumn("high", F.when(F.col("last"), F.length("text")).otherwise(F.col("next_low") + chunk_chars))
        .withColumn("whole", F.max(F.col("low").isNull()).over(Window.partitionBy("row")))
    )
    joined = met.filter(~F.col("whole")).select("row", "doc_id", "part", "text", "starts", "low", "high").groupBy("row").applyInArrow(stitched, schema)
    # No common boundary: from one piece, put together again from the chunks.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.substring("text", 1, chunk_chars).alias("text")))), lambda x: x["text"]), "")
    rest = met.filter("whole").groupBy("row", "doc_id").agg(text.alias("text")).select("doc_id", "text").mapInArrow(whole, schema)
    return short.unionByName(joined).unionByName(rest)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text bytes) of id sequences (doc_id, ids)."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path, pattern)
        for part in parts:
            raw = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(build, "doc_id bigint, decoded binary")
