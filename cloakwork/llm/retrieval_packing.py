"""Documents packed into sequences with those that are about the same.

Documents are token ids, and tokens are also the terms of a BM25 index.  How many documents
hold a token is counted over the whole corpus.  A document's key is the token with its
highest weight; keys with little text share a shard and keys with much are dealt over
several, so that a shard holds about `SHARD_TOKENS` ids of documents alike, whatever part of
them one key has.  Each shard has an inverted index.  A seed document is looked up by its
weightiest tokens; its unused neighbours, best first, fill its window: those that fit, then
the best of the others, which is cut and seeds the next window with its rest.  Without
neighbours the shard's next unused document is taken.

All windows of a shard are full but the last, which is cut into sequences whose lengths are
powers of two, so nothing is padded.

Defined results: a null text is the empty text, an empty document is its end id; rows that
are equal are documents of their own; an empty table gives no rows; columns other than id
and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.bpe import rank_table
from cloakwork.llm.packing import SPECIAL_ID, token_ids
from cloakwork.llm.shared import let_workers_import, staged

CAPACITY, END_ID = 2_048, 1
SHARD_TOKENS = 1 << 21
#: A seed is looked up by so many tokens; so many neighbours are returned at once.
QUERY_TERMS, NEIGHBOURS = 24, 64
K1, B = 1.2, 0.75
ROWS_AT_ONCE = 256
#: Weights are whole multiples of 1/SCALE, so a sum doesn't depend on its order.
SCALE = 1_024


@dataclass
class Corpus:
    """What weights need of all documents: the idf of each token and the mean length."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, holding: np.ndarray, documents: int, tokens: int) -> Corpus:
        return cls(np.log1p((documents - holding + 0.5) / (holding + 0.5)), max(1.0, tokens / max(1, documents)))

    def weights(self, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """What each posting gives; `lengths` are those of its documents."""
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / self.mean))
        return (SCALE * self.idf[terms] * part).astype(np.int64)


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(SPECIAL_ID, *rank_table(path).values()) < 1 << 16 else "<u4"


def _tokenised(df: DataFrame, path: str, pattern: str, doc_id: str, text: str, kind: str) -> DataFrame:
    """row (a number of its own), id, n (ids with the end), packed ids without it, distinct tokens and their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few rows at a time, so that a worker holds little beside the texts it was given.
            for part in (batch.slice(k, ROWS_AT_ONCE) for k in range(0, batch.num_rows, ROWS_AT_ONCE)):
                ids = [token_ids(path, pattern, t or "") for t in part.column(2).to_pylist()]
                found = [np.unique(x, return_counts=True) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(x) + 1 for x in ids], pa.int64()),
                        pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
                        pa.array([x.astype(kind).tobytes() for x, _ in found], pa.binary()),
                        pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary()),
                    ],
                    ["row", "doc_id", "n", "ids", "terms", "counts"],
                )

    given = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`"))
    return rows.mapInArrow(encode, f"row bigint, doc_id {given}, n bigint, ids binary, terms binary, counts binary")


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers that the rows of a binary column are packed of, one row after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _holding(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """How many documents hold each token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_joined(batch.column(0), kind), minlength=size)
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(held[terms])], ["term", "docs"])

    found = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term int, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        found[r.term] = r.docs
    return found


def keys_of(corpus: Corpus, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The weightiest token of each document, the smallest of equal ones; -1 where there is none.

    `sizes` are the distinct tokens of each document, `terms` ascend in each.
    """
    keys = np.full(len(sizes), -1, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        weights = corpus.weights(terms, counts, np.repeat(lengths, sizes))
        most = np.repeat(np.maximum.reduceat(weights, starts), sizes[some])
        best = np.where(weights == most, terms.astype(np.int64), np.iinfo(np.int64).max)
        keys[some] = np.minimum.reduceat(best, starts)
    return keys


def shard_plan(tokens: dict[int, int], target: int) -> dict[int, tuple[int, int]]:
    """For each key its first shard and over how many it is dealt; neighbouring small keys share one."""
    plan, shard, room = {}, -1, 0
    for key in sorted(tokens):
        parts = -(-tokens[key] // target)
        if parts == 1 and tokens[key] <= room:
            room -= tokens[key]
        else:
            shard, room = shard + 1, target - tokens[key]
        plan[key] = (shard, parts)
        if parts > 1:
            shard, room = shard + parts - 1, 0
    return plan


class Index:
    """The inverted index of a shard, and which of its documents are unused."""

    def __init__(self, profiles: list[tuple[np.ndarray, np.ndarray]]):
        self.unused = np.ones(len(profiles), bool)
        docs = np.repeat(np.arange(len(profiles)), [len(terms) for terms, _ in profiles])
        terms, weights = (np.concatenate([p[k] for p in profiles]) for k in (0, 1))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        ordered = terms[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        bounds = zip(starts.tolist(), [*starts[1:].tolist(), len(order)])
        self.lists = dict(zip(ordered[starts].tolist(), bounds))

    def neighbours(self, profile: tuple[np.ndarray, np.ndarray]) -> list[int]:
        """Unused documents by falling score, then number; none that shares no query token."""
        terms, weights = profile
        score = np.zeros(len(self.unused), np.int64)
        for term in terms[np.argsort(-weights, kind="stable")[:QUERY_TERMS]].tolist():
            start, end = self.lists[term]
            score[self.docs[start:end]] += self.weights[start:end]
        found = np.flatnonzero((score > 0) & self.unused)
        if len(found) > NEIGHBOURS:
            least = np.partition(score[found], -NEIGHBOURS)[-NEIGHBOURS]
            found = found[score[found] >= least]
        return found[np.argsort(-score[found], kind="stable")][:NEIGHBOURS].tolist()


def profiles(corpus: Corpus, documents: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct tokens of each document and their weights."""
    found = [np.unique(ids, return_counts=True) for ids in documents]
    terms, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    sizes = [len(f[0]) for f in found]
    weights = corpus.weights(terms, counts, np.repeat([len(ids) for ids in documents], sizes))
    ends = np.cumsum(sizes)
    return [(f[0], weights[end - len(f[0]) : end]) for f, end in zip(found, ends.tolist())]


def fill_windows(sizes: list[int], profiles: list, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); all are full but the last."""
    index = Index(profiles)
    windows: list[list[tuple[int, int, int]]] = []
    cut: tuple[int, int] | None = None  # a document whose rest seeds the next window
    following = 0
    while True:
        while following < len(sizes) and not index.unused[following]:
            following += 1
        if cut is None:
            if following == len(sizes):
                return windows
            cut = (following, 0)
            index.unused[following] = False
        seed, start = cut
        taken = min(capacity, sizes[seed] - start)
        window, room = [(seed, start, taken)], capacity - taken
        cut = (seed, start + taken) if start + taken < sizes[seed] else None
        while room:
            near = index.neighbours(profiles[seed])
            if not near:
                while following < len(sizes) and not index.unused[following]:
                    following += 1
                if following == len(sizes):
                    break
                near = [following]
            for doc in [d for d in near if sizes[d] <= room]:
                if sizes[doc] <= room:
                    window.append((doc, 0, sizes[doc]))
                    room -= sizes[doc]
                    index.unused[doc] = False
            rest = [d for d in near if index.unused[d]]
            if room and rest:
                window.append((rest[0], 0, room))
                cut, room = (rest[0], room), 0
                index.unused[rest[0]] = False
        windows.append(window)


def powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that isn't full, cut into runs whose lengths are falling powers of two."""
    out, waiting = [], window[::-1]
    left = sum(length for _, _, length in window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, length = waiting.pop()
            out[-1].append((doc, start, min(length, room)))
            if length > room:
                waiting.append((doc, start + room, length - room))
            room -= min(length, room)
    return out


OUT = [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def pack(
    df: DataFrame,
    path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    let_workers_import(spark)
    kind = id_type(path)
    size = max(SPECIAL_ID, *rank_table(path).values()) + 1
    rows = staged(_tokenised(df, path, pattern, doc_id, text, kind), "retrieval-ids")
    documents, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    corpus = spark.sparkContext.broadcast(Corpus.of(_holding(rows, kind, size), documents, tokens))

    def keys(terms: pa.Array, counts: pa.Array, n: pa.Array) -> pa.Array:
        sizes = np.array([len(c) // 4 for c in counts.to_pylist()], np.int64)
        return pa.array(
            keys_of(corpus.value, _joined(terms, kind), _joined(counts, "<u4"), sizes, n.to_numpy() - 1), pa.int32()
        )

    keyed = rows.withColumn("key", F.arrow_udf(keys, "int")("terms", "counts", "n"))
    plan = shard_plan({r.key: r.n for r in keyed.groupBy("key").agg(F.sum("n").alias("n")).collect()}, shard_tokens)
    shards = spark.createDataFrame([(k, *v) for k, v in plan.items()], "key int, first int, parts int")
    dealt = keyed.join(F.broadcast(shards), "key").withColumn(
        "shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    )
    given = df.schema[doc_id].dataType.simpleString()

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("row", "ascending")])
        shard = table["shard"][0].as_py()
        ids = [np.frombuffer(x, kind) for x in table["ids"].to_pylist()]
        windows = fill_windows([len(x) + 1 for x in ids], profiles(corpus.value, ids), capacity)
        if windows and sum(length for _, _, length in windows[-1]) < capacity:
            windows[-1:] = powers(windows[-1])
        ended = {}
        out, docs = [], []
        for number, window in enumerate(windows):
            offset = 0
            for doc, start, length in window:
                if doc not in ended:
                    ended[doc] = np.append(ids[doc], END_ID).astype("<u4")
                whole = ended[doc]
                crc = zlib.crc32(whole[start : start + length])
                out.append((start, length, crc, len(whole), shard << 32 | number, offset))
                docs.append(doc)
                offset += length
                if start + length == len(whole):
                    del ended[doc]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), OUT)]
        return pa.table([table["doc_id"].take(pa.array(docs)), *columns], ["doc_id", *(n for n, _ in OUT)])

    packed = dealt.select("shard", "key", "row", "doc_id", "ids").groupBy("shard")
    schema = f"doc_id {given}, " + ", ".join(f"`{n}` bigint" for n, _ in OUT)
    return packed.applyInArrow(pack_shard, schema).withColumnRenamed("doc_id", doc_id)
