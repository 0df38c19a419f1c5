"""The best documents for each query item by BM25 in whole numbers, by presence masks.

Documents become postings of the terms that any item holds.  A block of documents is
searched at a time: for every item a bit per term tells which documents hold it, so the
bits of a document are its mask, and documents of one mask form a group.  A group's score
is at most the sum, over its terms, of what the term gives at most in the block.  Groups
are taken by falling bound, their documents scored exactly, until the next bound is below
the k-th best score that the task has seen for the item.  Each task returns its k best per
item, which are merged in two steps.

Items are the queries: they pass through the driver in batches of at most `most_terms`
distinct terms, which is what is broadcast (an item with more is a batch of its own).
Documents are never collected, and all of them count for all figures.

Defined results: a null or empty text holds no term, so it is neither found nor counted
and as an item has no rows; equal scores go by ascending id, null ids last; repeated rows
are documents and items of their own (rows of an item id that occurs twice are ranked
for each); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloakwork.llm.shared import let_workers_import, staged

#: In bytes of lower-cased text: letters and digits of ASCII, and all that isn't ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
MOST_TERMS = 100_000
#: A block ends at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 2_000_000
#: At least so many documents are scored at once.
SCORED_AT_ONCE = 64
SALTS = 64


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; only A to Z are lower-cased, since these are bytes."""
    return TERM.findall(text.lower()) if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(n: int, documents: int, all_terms: int) -> int:
    return 100 - 25 + 25 * n * documents // max(1, all_terms)


def _postings(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (those in the vocabulary) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch in batches:
            ns, offsets, numbers, counts = [], [0], [], []
            for body in batch.column(1).to_pylist():
                words = terms(body)
                held = Counter(map(find, words))
                held.pop(None, None)
                ns.append(len(words))
                numbers.extend(held.keys())
                counts.extend(held.values())
                offsets.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (numbers, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
            )

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(index, schema)


class Block:
    """The postings of some documents, by term."""

    def __init__(self, m: list[int], sizes: np.ndarray, numbers: np.ndarray, tfs: np.ndarray):
        docs = np.repeat(np.arange(len(m)), sizes)
        tf = tfs.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.array(m, np.int64)[docs])
        order = np.argsort(numbers, kind="stable")
        self.size = len(m)
        self.docs, self.impact = docs[order], impact[order]
        present, starts = np.unique(numbers[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        most = np.maximum.reduceat(self.impact, starts) if len(starts) else []
        self.lists = {int(t): (int(a), int(z), int(x)) for t, a, z, x in zip(present, starts, ends, most)}

    def groups(self, held: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """Documents that hold any of the terms, by mask: the bound of the score, falling, and the places.

        `held` are terms that the block has, with their weights.
        """
        bits = np.zeros((len(held), self.size), bool)
        for row, (term, _) in zip(bits, held):
            start, end, _ = self.lists[term]
            row[self.docs[start:end]] = True
        found = np.flatnonzero(bits.any(axis=0))
        packed = np.packbits(bits[:, found], axis=0)
        padded = np.zeros((-(-len(packed) // 8) * 8, len(found)), np.uint8)
        padded[: len(packed)] = packed
        words = np.ascontiguousarray(padded.T).view(np.uint64)
        mask = np.zeros(len(found), np.int64)
        for word in words.T:
            of_word = np.unique(word, return_inverse=True)[1]
            mask = np.unique(mask * len(found) + of_word, return_inverse=True)[1]
        order = np.argsort(mask, kind="stable")
        starts = np.flatnonzero(np.diff(mask[order], prepend=-1))
        gives = np.array([w * self.lists[term][2] for term, w in held], np.int64)
        bounds = gives @ bits[:, found[order[starts]]]
        ends = np.append(starts[1:], len(order))
        for k in np.argsort(-bounds, kind="stable"):
            yield int(bounds[k]), found[order[starts[k] : ends[k]]]

    def scores(self, held: list[tuple[int, int]], places: np.ndarray) -> np.ndarray:
        total = np.zeros(len(places), np.int64)
        for term, w in held:
            start, end, _ = self.lists[term]
            at = np.searchsorted(self.docs[start:end], places)
            at[at == end - start] = 0
            here = self.docs[start + at] == places
            total += np.where(here, w * self.impact[start + at], 0)
        return total


class Best:
    """The k best (score, id) seen so far for an item."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this is of no use."""
        return max(1, self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[: self.k]


def search_block(block: Block, ids: list, item: list[tuple[int, int]], best: Best) -> int:
    """Improve the best of an item by the documents of a block; how many were scored."""
    held = [(term, w) for term, w in item if w > 0 and term in block.lists]
    if not held:
        return 0
    scored, waiting = 0, []

    def score() -> None:
        nonlocal scored
        places = np.concatenate(waiting)
        scored += len(places)
        found = block.scores(held, places)
        good = np.flatnonzero(found >= best.least)
        best.add([(int(found[k]), ids[places[k]]) for k in good])
        waiting.clear()

    for bound, places in block.groups(held):
        if bound < best.least:
            break
        waiting.append(places)
        if sum(map(len, waiting)) >= SCORED_AT_ONCE:
            score()
    if waiting:
        score()
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[tuple[Block, list]]:
    ids, m, sizes, numbers, tfs, held = [], [], [], [], [], 0
    for batch in batches:
        lengths = [length_part(n, documents, all_terms) for n in batch.column(1).to_pylist()]
        ends = batch.column(2).offsets.to_numpy()
        own_ids = batch.column(0).to_pylist()
        start = 0
        while start < batch.num_rows:
            room = ends[start] + max(1, BLOCK_POSTINGS - held)
            stop = min(batch.num_rows, start + BLOCK_DOCS - len(ids), int(np.searchsorted(ends, room, "right")) - 1)
            stop = max(stop, start + 1)
            low, high = int(ends[start]), int(ends[stop])
            ids += own_ids[start:stop]
            m += lengths[start:stop]
            sizes.append(np.diff(ends[start : stop + 1]))
            numbers.append(batch.column(2).values[low:high].to_numpy())
            tfs.append(batch.column(3).values[low:high].to_numpy())
            held += high - low
            start = stop
            if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                yield Block(m, *map(np.concatenate, (sizes, numbers, tfs))), ids
                ids, m, sizes, numbers, tfs, held = [], [], [], [], [], 0
    if ids:
        yield Block(m, *map(np.concatenate, (sizes, numbers, tfs))), ids


def _searched(docs: DataFrame, items: list[tuple], item_kind, k: int, doc_id: str, text: str) -> DataFrame:
    """The ranked rows of one batch of items, each an id and its terms with counts."""
    spark = docs.sparkSession
    vocabulary = {term: number for number, term in enumerate(dict.fromkeys(t for _, held in items for t in held))}
    postings = staged(_postings(docs, doc_id, text, vocabulary), "lexical-postings")
    documents, all_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = {r.term: weight(documents, r["count"]) for r in holding.collect()}
    queries = [[(vocabulary[t], weights.get(vocabulary[t], 0) * c) for t, c in held.items()] for _, held in items]
    shared = spark.sparkContext.broadcast(queries)
    id_kind = postings.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked]
        for block, ids in _blocks(batches, documents, all_terms):
            for item, own in zip(asked, best):
                search_block(block, ids, item, own)
        for number, own in enumerate(best):
            if own.rows:
                columns = [
                    pa.array([number] * len(own.rows), pa.int32()),
                    pa.array([r[1] for r in own.rows], to_arrow_type(id_kind)),
                    pa.array([r[0] for r in own.rows], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    found = postings.mapInArrow(run, f"item int, doc_id {id_kind.simpleString()}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    number = F.row_number()
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("rank", number.over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", number.over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], f"item int, item_id {item_kind.simpleString()}")
    return last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _item_batches(items: DataFrame, item_id: str, item_text: str, most_terms: int) -> Iterator[list[tuple]]:
    """Items with their terms, in runs of at most so many distinct terms."""
    batch, seen = [], set()
    for row in items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`").cast("binary")).toLocalIterator():
        held = Counter(terms(bytes(row[1]) if row[1] is not None else None))
        if batch and len(seen | held.keys()) > most_terms:
            yield batch
            batch, seen = [], set()
        if held:
            batch.append((row[0], held))
            seen |= held.keys()
    if batch:
        yield batch


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank, doc_id, score.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))) and gives, in whole numbers, that
    times 10^9 tf div (1000 tf + 12 m), with m = 75 + 25 n N div L, once for each time
    that the item holds it.
    """
    let_workers_import(docs.sparkSession)
    kind, id_kind = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    found = [_searched(docs, batch, kind, k, doc_id, text) for batch in _item_batches(items, item_id, item_text, most_terms)]
    none = f"item_id {kind.simpleString()}, rank int, doc_id {id_kind.simpleString()}, score bigint"
    return functools.reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], none)
