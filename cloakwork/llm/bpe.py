"""Byte-level BPE of whole texts, long ones in overlapping chunks.

A text longer than `CHUNK` characters is cut into chunks that overlap by `OVERLAP`.
The chunks are pre-tokenised in parallel.  Where a chunk and the next one have a
pre-token boundary in common, both continue alike, for the pattern looks only
ahead; there the text is stitched.  The pieces between such places are whole runs
of pre-tokens, so encoding them apart gives the ids of the whole text.  A document
with two chunks that never agree (one pre-token longer than the overlap) is encoded
whole.

Ids are kept packed: a binary column of little-endian unsigned 32-bit integers.

Defined results: a null text is encoded as the empty text and gives no ids, rows that
are equal stay apart, an empty table gives no rows, all other columns are kept, and a
column named like an output is replaced.
"""

from __future__ import annotations

import base64
import functools
import json

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import staged

CHUNK, OVERLAP = 32_768, 1_024
#: A match that ends so far from the end of a chunk is the same in the whole text: the
#: longest look ahead is that of "'re".
MARGIN = 4


def rank_table(path: str) -> dict[bytes, int]:
    """The ranks of a `.tiktoken` file, or the vocabulary of a byte-level `.json` file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # The printable stand-ins of byte-level vocabularies: printable bytes are themselves.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    stands = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    return {bytes(map(stands.__getitem__, token)): i for token, i in vocabulary.items()}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    ranks = rank_table(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def packed(coder: tiktoken.Encoding, text: str) -> bytes:
    return coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _encoder(path: str, pattern: str):
    def encode(texts: pa.Array) -> pa.Array:
        coder = encoding(path, pattern)
        return pa.array([packed(coder, t or "") for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(encode, "binary")


def _joiner(path: str, pattern: str):
    def join(pieces: pa.Array, texts: pa.Array) -> pa.Array:
        """The pieces' ids, or those of the whole text where there is one."""
        coder = encoding(path, pattern)
        return pa.array(
            [
                packed(coder, text) if text is not None else b"".join(p or [])
                for p, text in zip(pieces.to_pylist(), texts.to_pylist())
            ],
            pa.binary(),
        )

    return F.arrow_udf(join, "binary")


def boundaries(text: str, pattern: str, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Starts of pre-tokens in the first `overlap` characters, and sure ones in the last.

    The end of a match that is sure is a start as well.
    """
    sure, size = len(text) - MARGIN, len(text)
    ends = [m.end() for m in regex.finditer(pattern, text)]
    head = [0, *(e for e in ends if e <= overlap)]
    tail = [] if last else [e for e in ends if size - overlap <= e <= sure]
    return head, tail


def _finder(pattern: str, overlap: int):
    kind = pa.struct([("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def find(texts: pa.Array, starts: pa.Array, last: pa.Array) -> pa.Array:
        rows = []
        for text, start, is_last in zip(texts.to_pylist(), starts.to_pylist(), last.to_pylist()):
            head, tail = boundaries(text, pattern, overlap, is_last)
            rows.append({"head": [start + x for x in head], "tail": [start + x for x in tail]})
        return pa.array(rows, kind)

    return F.arrow_udf(find, "struct<head:array<bigint>,tail:array<bigint>>")


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    out: str = "ids",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The frame with the packed ids of `text` as column `out`."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("two overlaps must be shorter than a chunk")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    body = df[f"`{text}`"]
    is_long = F.coalesce(F.length(body) > chunk, F.lit(False))
    coder = _encoder(path, pattern)
    short = df.where(~is_long).select(*(df[f"`{c}`"] for c in kept), coder(body).alias(out))
    joined = _encode_long(df.where(is_long).select(*(df[f"`{c}`"] for c in kept)), path, pattern, text, out, chunk, overlap)
    return short.unionByName(joined)


def _encode_long(
    df: DataFrame, path: str, pattern: str, text: str, out: str, chunk: int, overlap: int
) -> DataFrame:
    columns = df.columns
    rows = staged(
        df.select(F.monotonically_increasing_id().alias("key"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")),
        "bpe-long",
    )
    step, size = chunk - overlap, F.length(F.col("row")[text])
    chunks = (
        rows.select("key", F.col("row")[text].alias("body"), F.ceil((size - overlap) / F.lit(step)).cast("int").alias("n"))
        .select("key", "n", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .select(
            "key",
            "n",
            "k",
            (F.col("k").cast("long") * step).alias("start"),
            F.expr(f"substr(body, k * {step} + 1, {chunk})").alias("part"),
        )
        .repartition("key", "k")
    )
    found = _finder(pattern, overlap)(F.col("part"), F.col("start"), F.col("k") == F.col("n") - 1)
    ordered = Window.partitionBy("key").orderBy("k")
    cuts = (
        chunks.select("key", "k", "n", found.alias("found"))
        .withColumn("next", F.lead("found").over(ordered)["head"])
        .withColumn("upto", F.array_min(F.array_intersect(F.col("found")["tail"], F.col("next"))))
        .withColumn("since", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("upto").over(ordered)))
        .select("key", "k", "since", "upto", (F.col("upto").isNull() & (F.col("k") < F.col("n") - 1)).alias("apart"))
    )
    pieces = chunks.join(cuts, ["key", "k"])
    length: Column = F.when(F.col("upto").isNotNull(), F.col("upto") - F.col("since")).otherwise(F.length("part"))
    piece = F.substr("part", (F.col("since") - F.col("start") + 1).cast("int"), length.cast("int"))
    encoded = pieces.select("key", "k", "apart", _encoder(path, pattern)(piece).alias("ids"))
    gathered = encoded.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("pieces"), F.max("apart").alias("apart")
    )
    whole = F.when(F.col("apart"), F.col("row")[text])
    ids = _joiner(path, pattern)(F.col("pieces")["ids"], whole)
    return rows.join(gathered, "key").select(*(F.col("row")[c].alias(c) for c in columns), ids.alias(out))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the bytes that packed ids stand for; null ids give null bytes."""

    def to_bytes(column: pa.Array) -> pa.Array:
        import numpy as np

        table = byte_table(path)
        return pa.array(
            [
                None if x is None else b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()])
                for x in column.to_pylist()
            ],
            pa.binary(),
        )

    return df.withColumn(out, F.arrow_udf(to_bytes, "binary")(F.col(ids)))
