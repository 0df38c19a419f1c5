"""Documents packed into sequences of a fixed length.

The lengths of all pieces form a histogram of at most `capacity` entries.  A
configuration is a multiset of lengths that fits into one sequence.  The linear
program that covers the histogram with the fewest configurations is solved by
multiplicative weights: every length has a price, a knapsack dynamic program finds
the configuration of the highest price, a step of it is taken, and the prices of the
lengths it covers fall.  The whole part of each configuration is kept; what remains,
a few copies of each configuration at most, is placed by best fit.  Histogram and
program are bounded by the capacity, whatever the corpus; pieces find their places
by their rank among those of their length.

Defined results: a null text is the empty text, a piece is at least the end id, equal
rows and equal or null ids get places of their own, an empty table gives no rows, and
columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.bpe import rank_table
from cloakwork.llm.shared import staged

CAPACITY, END_ID = 2_048, 0
#: The string that the vocabulary keeps as one token of its own, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256
#: A step covers at most this part of a length; less of each where lengths are few, and
#: prices then fall the faster.  So many steps are taken at most, about.
LEAST_STEP, MOST_STEP, STEPS, RATE = 0.01, 0.5, 4_000, 0.05
#: A configuration that leaves more than this part of a sequence empty and is used at
#: most so often is taken apart again and its pieces placed by best fit.
SPARE, FEW = 0.001, 4
ROWS_PER_RANK = 500_000
MOST_SALTS = 1_024


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})


def token_ids(path: str, pattern: str, text: str) -> np.ndarray:
    """The ids that the vocabulary's own library gives, whose special token is found in texts too."""
    coder = _coder(path, pattern)
    if SPECIAL not in text:
        return coder.encode_to_numpy(text, disallowed_special=())
    parts = []
    for k, part in enumerate(text.split(SPECIAL)):
        parts += [np.array([SPECIAL_ID], np.uint32)] * (k > 0)
        parts.append(coder.encode_to_numpy(part, disallowed_special=()))
    return np.concatenate(parts)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of `n` ids: whole sequences, but for the first piece."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, np.diff([*starts, n]).tolist()))


def pieces(
    df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32."""
    kind = pa.list_(
        pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    )

    def tokenised(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            ids = np.append(token_ids(path, pattern, text or ""), END_ID).astype("<u4")
            rows.append(
                [
                    {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n])}
                    for k, (s, n) in enumerate(cut(len(ids), capacity))
                ]
            )
        return pa.array(rows, kind)

    found = F.arrow_udf(tokenised, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    return df.select(F.col(doc_id), F.explode(found(F.col(text))).alias("p")).select(doc_id, "p.*")


def priciest(prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths, as counts, that fits and whose prices sum highest.

    `prices[n]` is that of length n, minus infinity for lengths that may not be used.
    """
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    offered = prices[1:]
    for room in range(1, capacity + 1):
        sums = best[room - 1 :: -1] + offered[:room]
        k = int(sums.argmax())
        if sums[k] > best[room - 1]:
            best[room], taken[room] = sums[k], k + 1
        else:
            best[room] = best[room - 1]
    chosen: dict[int, int] = {}
    room = capacity
    while room > 0:
        if n := int(taken[room]):
            chosen[n] = chosen.get(n, 0) + 1
            room -= n
        else:
            room -= 1
    return chosen


def fractional(histogram: dict[int, int], capacity: int) -> dict:
    """Configurations (sorted pairs of length and count) and how often each is used."""
    step = min(MOST_STEP, max(LEAST_STEP, len(histogram) / STEPS))
    rate = RATE / step
    wanted = np.zeros(capacity + 1)
    for n, count in histogram.items():
        wanted[n] = count
    left, sizes, uses = wanted.copy(), np.arange(capacity + 1) / capacity, {}
    done = 0.0
    while (open_lengths := left > 1e-9).any():
        covered = np.where(open_lengths, 1 - left / np.maximum(wanted, 1), 0)
        prices = np.where(open_lengths, sizes * np.exp(-rate * (covered - done)), -np.inf)
        chosen = priciest(prices, capacity)
        if not all(wanted[n] >= count for n, count in chosen.items()):
            # More of a length than there is at all: as many as there are.
            chosen = {n: int(min(count, wanted[n])) for n, count in chosen.items()}
        use = min(min(max(step * wanted[n], 1.0), left[n]) / count for n, count in chosen.items())
        key = tuple(sorted(chosen.items()))
        uses[key] = uses.get(key, 0.0) + use
        for n, count in chosen.items():
            left[n] = max(0.0, left[n] - use * count)
            if left[n] <= 1e-9:
                left[n] = 0.0
        done = 1 - left.sum() / wanted.sum()
    return uses


def best_fit(lengths: list[int], capacity: int) -> list[tuple]:
    """The longest first, each into the fullest sequence that has room; configurations."""
    rooms: list[tuple[int, int]] = []
    bins: list[dict[int, int]] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            room, at = capacity, len(bins)
            bins.append({})
        bins[at][n] = bins[at].get(n, 0) + 1
        if room > n:
            bisect.insort(rooms, (room - n, at))
    return [tuple(sorted(b.items())) for b in bins]


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Configurations with whole numbers of uses that hold exactly the histogram."""
    rest, out = dict(histogram), {}
    for config, use in fractional(histogram, capacity).items():
        copies = min(int(use + 1e-6), *(rest[n] // count for n, count in config))
        spare = 1 - sum(n * count for n, count in config) / capacity
        if copies > (FEW if spare > SPARE else 0):
            out[config] = out.get(config, 0) + copies
            for n, count in config:
                rest[n] -= copies * count
    for config in best_fit([n for n, count in rest.items() for _ in range(count)], capacity):
        out[config] = out.get(config, 0) + 1
    return list(out.items())


@dataclass
class Places:
    """For each length, intervals of ranks and where their pieces go; sorted by key."""

    keys: np.ndarray  # length << 40 | first rank
    base: np.ndarray
    per: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, configs: list[tuple[tuple, int]]) -> Places:
        used: dict[int, int] = {}
        rows, base = [], 0
        for config, copies in configs:
            offset = 0
            for n, count in config:
                rows.append((n << 40 | used.get(n, 0), base, count, offset))
                used[n] = used.get(n, 0) + copies * count
                offset += n * count
            base += copies
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [], []))))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 40 | rank
        at = np.searchsorted(self.keys, key, "right") - 1
        local = key - self.keys[at]
        return self.base[at] + local // self.per[at], self.offset[at] + local % self.per[at] * length


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a `length` get `sequence_id` and `offset`; other columns stay.

    The rows are staged, ranked by salted length so that a length that a third of all
    rows have goes to many tasks, and looked up.  The driver gets a count for each
    length and salt.
    """
    spark = rows.sparkSession
    columns = rows.columns
    rows = staged(rows, "packing-pieces")
    total = rows.count()
    salts = int(min(MOST_SALTS, max(8, -(-total // ROWS_PER_RANK))))
    order = [c for c in columns if c != "length"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = np.zeros((capacity + 1, salts), np.int64)
    for n, salt, count in salted.groupBy("length", "salt").count().toLocalIterator():
        counts[n, salt] = count
    before = np.cumsum(counts, axis=1) - counts
    sums = counts.sum(axis=1)
    found = Places.of(configurations({n: int(c) for n, c in enumerate(sums) if c}, capacity))
    shared = spark.sparkContext.broadcast((before, found))
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def look_up(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        first, places = shared.value
        n, s, r = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, salt, rank))
        sequence, offset = places.find(n, r - 1 + first[n, s])
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], fields=list(kind))

    ranked = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)).cast("long")
    )
    where = F.arrow_udf(look_up, "struct<sequence_id:bigint,offset:bigint>")
    return ranked.withColumn("place", where("length", "salt", "rank")).select(*columns, "place.*")


def pack(
    df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(pieces(df, path, pattern, doc_id, text, capacity), capacity)
