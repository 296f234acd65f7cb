"""Byte-level BPE with overlapping chunks, and decoding.

Short texts are pre-tokenised and encoded where they lie. A long text is cut
into overlapping chunks that travel as rows of their own: each chunk is
pre-tokenised by itself, its last match and trailing white space set aside,
since more text could change them. Where a match of one chunk ends at a
boundary of the next chunk's matches, both go on alike; the pieces are stitched
there and every chunk encodes the pieces that fall to it, matches of white space
at a piece's end one by one, as the text after them made them. A text whose
chunks never meet again (one match longer than the overlap) is pre-tokenised whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize

CHUNK, OVERLAP = 32_768, 2_048


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file; one in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _compiled(pattern: str):
    import regex

    # the encoder's \\s is Unicode's White_Space, which lacks the separators 0x1C-0x1F
    return regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))


def pretokenise(text: str, pattern: str) -> np.ndarray:
    """Ends of the matches; the pattern's matches follow one another without gaps."""
    return np.fromiter((m.end() for m in _compiled(pattern).finditer(text)), np.int64)


def settled(text: str, ends: np.ndarray, last: bool) -> np.ndarray:
    """The ends that more text after ``text`` could not move."""
    if last:
        return ends
    end = len(text)
    while end and _compiled(r"\s").match(text, end - 1):
        end -= 1
    return ends[ends <= end - 1]


def stitch(first: list[np.ndarray], starts: list[int]) -> list[tuple[int, int]] | None:
    """The (from, to) range of the text that falls to each chunk, or None.

    ``first``: each chunk's settled ends, in the whole text's positions.
    ``starts``: where each chunk begins.
    """
    out, at = [], 0
    for i, ends in enumerate(first):
        if i + 1 == len(first):
            out.append((at, int(ends[-1]) if len(ends) else at))
            break
        later = np.append(first[i + 1], starts[i + 1])
        meet = np.intersect1d(ends[ends >= at], later)
        if not len(meet):
            return None
        out.append((at, int(meet[0])))
        at = int(meet[0])
    return out


def tail(ends: np.ndarray, spaced: np.ndarray, a: int, b: int) -> list[int]:
    """The last ends in (a, b]: from the last match that ends in other than white space on.

    What comes before is cut where more text changes no match, so it may be
    pre-tokenised again by itself; each later match must be taken as it is.
    """
    inside = (ends > a) & (ends <= b)
    solid = ends[inside & ~spaced]
    start = int(solid[-1]) if len(solid) else a
    return [start, *ends[inside & (ends > start)].tolist()]


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, one after another."""
    return encoding(path, pattern).decode_bytes(list(map(int, ids)))


_IDS = "ids array<int>"


def _encode_short(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield _rows(b, [enc.encode_ordinary(t) for t in b.column(2).to_pylist()], enc, digests)

    return run


def _rows(b: pa.RecordBatch, ids: list[list[int]], enc, digests: bool) -> pa.RecordBatch:
    cols = [b.column(0), b.column(1), pa.array(list(map(len, ids)), pa.int64())]
    if not digests:
        return pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], ["row", "id", "n_tokens", "ids"])
    cols += [pa.array(map(_digest, ids), pa.string()), pa.array((hashlib.sha256(enc.decode_bytes(x)).hexdigest() for x in ids), pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["row", "id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _chunk_ends(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            space = _compiled(r"\s")
            ends = [settled(r["part"], pretokenise(r["part"], pattern), r["last"]) for r in rows]
            # an end after white space is written as a negative number
            signed = [[-(e + r["start"]) if space.match(r["part"], e - 1) else e + r["start"] for e in x.tolist()] for r, x in zip(rows, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(signed, pa.list_(pa.int64()))], ["row", "chunk", "start", "ends"])

    return run


def _stitched(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["chunk"].to_pylist(), table["start"].to_pylist(), table["ends"].to_pylist(), strict=True))
    signed = [np.array(r[2], np.int64) for r in rows]
    parts = stitch([np.abs(x) for x in signed], [r[1] for r in rows])
    if parts is None:
        return pa.table({"row": [key[0].as_py()], "chunk": [-1], "a": [0], "b": [0], "tail": [[]]}, schema=_PARTS)
    tails = [[e - a for e in tail(np.abs(x), x < 0, a, b)] for x, (a, b) in zip(signed, parts, strict=True)]
    return pa.table({"row": [key[0].as_py()] * len(rows), "chunk": [r[0] for r in rows], "a": [p[0] for p in parts], "b": [p[1] for p in parts], "tail": tails}, schema=_PARTS)


_PARTS = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("tail", pa.list_(pa.int64()))])


def encode_piece(enc, text: str, ends: list[int]) -> list[int]:
    """The ids of a piece: up to the first of ``ends`` as a text, then match by match; without any, as a text."""
    if not ends:
        return enc.encode_ordinary(text)
    out = enc.encode_ordinary(text[: ends[0]])
    for a, b in zip(ends, ends[1:], strict=False):
        out += enc.encode_ordinary(text[a:b])
    return out


def _encode_parts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode_piece(enc, t, x) for t, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["row", "chunk", "ids"])

    return run


def _join_parts(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [[x for part in sorted(parts, key=lambda p: p["chunk"]) for x in part["ids"]] for parts in b.column(2).to_pylist()]
            yield _rows(b, ids, enc, digests)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, digests: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids) for every row of ``docs``; with ``digests`` the SHA-256 of the ids and of the decoded bytes instead of the ids.

    The ids are those of ordinary encoding of the whole text, without special
    tokens. Null texts count as empty and give no ids; rows with null or
    repeated ids stay as they are; other columns are ignored. ``path`` must be
    readable on every executor, as an installed package's files are.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and below chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    cols = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"n_tokens long, {_IDS}"
    names = [c.split()[0] for c in cols.split(", ")]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk).select(F.lit(0).cast("long").alias("row"), "id", "text")
    short = short.mapInArrow(_encode_short(path, pattern, digests), f"row long, id {kind}, {cols}").select("id", *names)

    long_ = materialize(texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "op4-long")
    step = chunk - overlap
    at = long_.select("row", "text", F.posexplode(F.expr(f"sequence(0L, greatest(0L, ceil((length(text) - {chunk}) / {step})) * {step}, {step}L)")).alias("chunk", "start"))
    at = at.select("row", F.col("chunk").cast("long"), "start", F.expr(f"substring(text, int(start) + 1, {chunk})").alias("part"), F.expr(f"start + {chunk} >= length(text)").alias("last"))
    ends = at.repartition("row", "chunk").mapInArrow(_chunk_ends(pattern), "row long, chunk long, start long, ends array<long>")
    parts = materialize(ends.groupBy("row").applyInArrow(_stitched, "row long, chunk long, a long, b long, tail array<long>"), "op4-parts")
    cut = parts.join(long_, "row").select("row", "chunk", F.expr("if(chunk < 0, text, substring(text, int(a) + 1, int(b - a)))").alias("part"), "tail")
    done = cut.repartition("row", "chunk").mapInArrow(_encode_parts(path, pattern), f"row long, chunk long, {_IDS}")
    done = done.groupBy("row").agg(F.collect_list(F.struct("chunk", "ids")).alias("parts"))
    done = done.join(long_.select("row", "id"), "row").select("row", "id", "parts").mapInArrow(_join_parts(path, pattern, digests), f"row long, id {kind}, {cols}")
    return short.union(done.select("id", *names)).withColumnRenamed("id", id_col)
