"""Token counts of whole texts by a sentencepiece BPE model.

Texts of at most ``chunk`` characters are counted where they lie.  Longer ones
are cut into chunks that overlap, encoded on all executors with the character
offsets of their tokens, and spliced where two neighbours resynchronise:

- A boundary between two characters is *stable* if no piece of the vocabulary
  holds them side by side.  Merges only make pieces, so no merge ever crosses
  it: whatever text surrounds it, a token ends there, and the tokens on one
  side do not depend on the other.
- Both chunks of an overlap look for its first stable boundary.  If both have
  it, with a token end at that offset, the left chunk counts up to it and the
  right one from it.
- Where an overlap has none (a long run such as one letter repeated), the run
  of chunks around it is encoded again between its proven outer boundaries with
  overlaps ``WIDEN`` times as wide, until it aligns or fits one chunk.

So the count is that of the whole text, however it was cut.  A stretch without
any stable boundary is encoded by one task, as the library itself would.

Defined cases: text NULL or empty has no tokens and no bytes; rows are counted
one by one, also when they repeat; further columns are not carried along; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import CHUNK_BYTES, materialise, slices, text_buffer

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: Overlaps grow by this factor where no boundary was found.
WIDEN = 8
LIMIT = 4096
#: How the model writes a blank.
BLANK = "▁"


class Counter:
    """A model and what its vocabulary proves; one per Python worker and file."""

    _made: dict[str, Counter] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        plain = not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix) and norm.escape_whitespaces
        kinds = {p.type for p in spec.pieces}
        own = spec.pieces[0].USER_DEFINED
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or not plain or own in kinds:
            raise ValueError(f"{path}: only BPE models with byte fallback that keep all characters can be spliced")
        self.model = SentencePieceProcessor(model_file=path)
        # Chunks are encoded without the blank that the model puts before a text; a text's first chunk gets it here.
        self.lead = BLANK if norm.add_dummy_prefix else ""
        norm.add_dummy_prefix = False
        self.bare = SentencePieceProcessor(model_proto=spec.SerializeToString())
        normal = [p.piece for p in spec.pieces if p.type == p.NORMAL]
        self.width = np.array([len(p.piece.encode()) if p.type == p.NORMAL else 1 for p in spec.pieces], np.int64)  # bytes; a byte piece is one
        pairs = {(ord(a) << 21) | ord(b) for x in normal for a, b in zip(x, x[1:], strict=False)}
        self.inside = np.array(sorted(pairs), np.int64)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def splices(self, text: str, size: int, overlap: int, opens: bool) -> tuple[int, int | None, int, int | None, int]:
        """(tokens, head, tokens before it, tail, tokens before it) of a chunk:
        its first stable boundaries within ``overlap`` from its first character
        and from the character ``size``, counted from there; None where there
        is none.  ``opens``: the chunk is the start of its text."""
        lead = self.lead if opens else ""
        text = lead + text.replace(" ", BLANK)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = (points[:-1] << 21) | points[1:]
        stable = np.ones(len(points) + 1, bool)
        stable[1:-1] = self.inside[np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)] != pair
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        ends = np.cumsum(self.width[np.array(self.bare.encode(text), np.int64)])
        assert ends[-1] == byte_at[-1]
        out: list = [len(ends)]
        for base in (len(lead), len(lead) + size):
            at = base + 1 + np.flatnonzero(stable[base + 1 : min(base + overlap, len(points))])
            where = byte_at[at[0]] if len(at) else -1
            k = int(np.searchsorted(ends, where))
            aligned = len(at) and ends[k] == where
            out += [int(at[0]) - base, k + 1] if aligned else [None, 0]
        return tuple(out)


def count_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of ``long`` (row, text), a written table."""
    work = long.select("row", F.lit(0).cast("bigint").alias("lo"), F.length("text").cast("bigint").alias("hi"))
    done: DataFrame | None = None

    while True:
        size, reach = chunk, overlap

        def encode(parts: Iterator[pa.RecordBatch], size: int = size, reach: int = reach) -> Iterator[pa.RecordBatch]:
            counter = Counter.of(path)
            for part in parts:
                opens = pc.and_(pc.equal(part.column("lo"), 0), pc.equal(part.column("part"), 0)).to_pylist()
                rows = [counter.splices(t, size, reach, first) for t, first in zip(part.column("text").to_pylist(), opens, strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kept = part.select(["row", "lo", "hi", "part", "parts"])
                for name, values in zip(("n", "head", "head_at", "tail", "tail_at"), columns, strict=True):
                    kept = kept.append_column(name, pa.array(values, pa.int64()))
                yield kept

        parts = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.lit(size)).cast("int"))
        start = F.col("lo") + F.col("part") * F.lit(size)
        text = F.substring(F.col("text"), (start + 1).cast("int"), F.least(F.lit(size + reach), F.col("hi") - start).cast("int"))
        cut = (
            work.join(long, "row")
            .withColumn("parts", parts)
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("row", "lo", "hi", "part", "parts", text.alias("text"))
            .repartition("row", "lo", "part")
        )
        schema = "row bigint, lo bigint, hi bigint, part int, parts int, n bigint, head bigint, head_at bigint, tail bigint, tail_at bigint"
        found = materialise(cut.mapInArrow(encode, schema))
        # A text is a string of 2 GB at most, so its chunks are 65 thousand narrow rows at most.
        order = Window.partitionBy("row", "lo").orderBy("part")
        first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
        meets = F.coalesce(F.col("head") == F.lag("tail").over(order), F.lit(False))
        base = F.col("lo") + F.col("part") * F.lit(size)
        runs = (
            found.withColumn("opens", F.when(first | meets, 1).otherwise(0))
            .withColumn("run", F.sum("opens").over(order))
            .withColumn("start", F.when(first, F.col("lo")).otherwise(base + F.col("head")))
            .withColumn("stop", F.when(last, F.col("hi")).otherwise(base + F.lit(size) + F.col("tail")))
            .withColumn("tokens", F.when(last, F.col("n")).otherwise(F.col("tail_at")) - F.when(first, F.lit(0)).otherwise(F.col("head_at")))
            .groupBy("row", "lo", "run")
            .agg(F.count(F.lit(1)).alias("chunks"), F.min_by("start", "part").alias("start"), F.max_by("stop", "part").alias("stop"), F.sum("tokens").alias("tokens"))
        )
        runs = materialise(runs)
        counted = runs.filter("chunks = 1").select("row", "tokens")
        done = counted if done is None else done.unionByName(counted)
        work = runs.filter("chunks > 1").select("row", F.col("start").alias("lo"), F.col("stop").alias("hi"))
        if work.isEmpty():
            return done.groupBy("row").agg(F.sum("tokens").alias("n_tokens"))
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_tokens and
    over_limit (n_tokens > ``limit``)."""
    if not 1 < overlap < chunk:
        raise ValueError("an overlap has at least two characters and less than a chunk")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for part in parts:
            texts = part.column("text")
            _, off = text_buffer(texts)
            counts: list[int] = []
            for i, j in slices(off, CHUNK_BYTES):
                counts += counter.count(texts.slice(i, j - i).to_pylist())
            yield pa.record_batch([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    chars = F.length("text")
    short = docs.filter(chars <= chunk).mapInArrow(whole, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    long = materialise(docs.filter(chars > chunk).withColumn("row", F.monotonically_increasing_id()))
    counted = count_long(long.select("row", "text"), path, chunk, overlap)
    spliced = long.select("row", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")).join(counted, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
