"""Near-duplicate texts by order MinHash, verified by alignment of their words.

A text is its words in lower case.  Its k-mers are shingles of five words, labelled with
the number of the occurrence, so that each is unique in its text.  Each of `SKETCHES`
hash functions picks the `PICKED` k-mers it maps lowest, and a sketch holds them in the
order they have in the text; sketches agree for texts that are alike in edits, not only
in words.  Texts that agree in a sketch are candidates, if the lowest k-mers of
`AGREEING` functions are the same, as they are in texts that edits have left alike.

Two texts are similar when their words need at most `(1 - THRESHOLD) * max(n1, n2)`
edits.  A chain of the k-mers that both have, in the order of both, bounds the edits from
above, as the words between count as replaced: if it stays within the limit, the pair is
taken.  If not, as where texts repeat passages and k-mers are matched one repeat off, the
words that only one has, which are edited in any alignment, bound them from below; and
where the limit is between the bounds, the words are aligned exactly inside a band of twice
the limit, row by row, until it is passed.  A passage that has moved counts as edited,
however many shingles it leaves alike.

Texts with the same words form one node from the start.  The members of a bucket are
not paired with each other: in some rounds each is aligned with one of them, and what
that links is one component.  Then the pairs of a bucket that are in different components
are looked at, each in the first bucket that holds it, so no candidate pair that could
join two components is left out.  Small buckets give pairs; in large ones, such as those
of a passage that very many texts share, blocks of members are aligned where they are
and only links leave the task.  The classes are the components.

Defined results: texts without words are the same only if they are equal and not empty;
null and empty texts are alone; a text of fewer than five words is one k-mer; repeated
rows and ids stay rows, of which one per class is kept; null ids come last in the choice;
an empty table gives no rows; other columns are kept, those named like an output are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import components
from cloakwork.llm.shared import free_name, staged

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, PICKED = 32, 3
#: Of the lowest k-mers of 32 functions, texts that share 45 of 100 k-mers agree in some 14,
#: and in fewer than 5 once in ten thousand times.
AGREEING = 5
HUB_ROUNDS = 2
#: Buckets of more members are paired in blocks, of so many members or words, that align their texts.
SMALL, BLOCK, BLOCK_WORDS = 32, 2_000, 2_000_000
BYTES_AT_ONCE, KMERS_AT_ONCE = 1 << 20, 8_192
#: Longer sequences look up a word's places at each row.
MASKED = 4_096
SEED = 42

_GAP = re.compile(r"\W+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal_form(text: str | None) -> bytes:
    """Words in lower case, with one space between them."""
    return _GAP.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text else b""


def word_hashes(words: bytes) -> np.ndarray:
    """A hash of each word; the bytes are read a piece at a time."""
    out, at = [], 0
    while at < len(words):
        upto = len(words) if at + BYTES_AT_ONCE >= len(words) else words.find(b" ", at + BYTES_AT_ONCE)
        upto = len(words) if upto < 0 else upto
        part = np.frombuffer(words, np.uint8, upto - at, at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * _powers(_BASE, len(part)), dtype=np.uint64)])
        gaps = np.flatnonzero(part == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(part)]])
        out.append(mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(part) + 1)[starts]))
        at = upto + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def labelled(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers of words in text order, each with the number of its occurrence."""
    hashes = hashes.astype(np.uint64)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - k + 1)
    kmers = np.zeros(n, np.uint64)
    for j in range(min(k, len(hashes))):
        kmers = kmers * _ODD + hashes[j : j + n]
    kmers = mixed(kmers)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if fresh.all():
        return mixed(kmers)
    firsts = np.flatnonzero(fresh)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
    return mixed(kmers + occurrence * _ODD)


_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def sketches(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the lowest k-mers, hashed in the order of the text, and the lowest one."""
    values, places = [], []
    rows = np.arange(SKETCHES)
    for at in range(0, len(kmers), KMERS_AT_ONCE):
        v = kmers[at : at + KMERS_AT_ONCE] * _FACTORS[:, None] + _OFFSETS[:, None]
        for _ in range(min(PICKED, v.shape[1])):
            lowest = v.argmin(axis=1)
            values.append(v[rows, lowest])
            places.append(lowest + at)
            v[rows, lowest] = np.uint64(0xFFFFFFFFFFFFFFFF)
    value, place = np.stack(values, axis=1), np.stack(places, axis=1)
    picked = np.take_along_axis(place, np.argsort(value, axis=1, kind="stable")[:, :PICKED], axis=1)
    in_order = np.sort(picked, axis=1)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for j in range(in_order.shape[1]):
        out = mixed(out * _ODD + kmers[in_order[:, j]])
    return out, kmers[picked[:, 0]]


def _increasing(path: np.ndarray) -> np.ndarray:
    """Places of a longest increasing run."""
    if (np.diff(path) > 0).all():
        return np.arange(len(path))
    tails, ends, before = [], [], np.empty(len(path), np.int64)
    for i, value in enumerate(path.tolist()):
        k = bisect_left(tails, value)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(value)
            ends.append(i)
        else:
            tails[k], ends[k] = value, i
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def sorted_kmers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labelled k-mers by value, and their places."""
    kmers = labelled(words)
    order = np.argsort(kmers)
    return kmers[order], order


def edits(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edits of the alignment of word sequences along their common k-mers, or more than `most`."""
    (sorted_x, order_x), (sorted_y, order_y) = sorted_kmers(x), sorted_kmers(y)
    if not len(sorted_x) or not len(sorted_y):
        return most + 1
    at = np.minimum(np.searchsorted(sorted_x, sorted_y), len(sorted_x) - 1)
    common = sorted_x[at] == sorted_y
    at_x, at_y = order_x[at[common]], order_y[common]
    order = np.argsort(at_x)
    return edits_along(at_x[order], at_y[order], len(x), len(y), most)


def edits_along(at_x: np.ndarray, at_y: np.ndarray, n_x: int, n_y: int, most: int) -> int:
    """The same by the places of the common k-mers, ordered by those in the first sequence.

    Words between matched k-mers are replaced by one another, as many as the longer side has.
    """
    if abs(n_x - n_y) > most:
        return most + 1
    inside = np.abs(at_x - at_y) <= most
    at_x, at_y = at_x[inside], at_y[inside]
    if not len(at_x):
        return most + 1
    chain = _increasing(at_y)
    at_x, at_y = at_x[chain], at_y[chain]
    # Runs of k-mers on one diagonal match all their words; a run begins after the words of the one before.
    first = np.flatnonzero(np.diff(at_x - at_y, prepend=at_x[0] - at_y[0] - 1))
    k = min(SHINGLE, n_x, n_y)
    gaps, end_x, end_y = [], 0, 0
    # On one diagonal, k-mers may be apart as well.
    begins = np.unique(np.concatenate([first, np.flatnonzero(np.diff(at_x, prepend=at_x[0]) > k)]))
    for i, until in zip(begins.tolist(), (np.append(begins[1:], len(at_x)) - 1).tolist()):
        skip = max(0, end_x - int(at_x[i]), end_y - int(at_y[i]))
        start_x, start_y = int(at_x[i]) + skip, int(at_y[i]) + skip
        if start_x > int(at_x[until]) + k:
            continue
        gaps.append((end_x, start_x, end_y, start_y))
        end_x, end_y = int(at_x[until]) + k, int(at_y[until]) + k
    gaps.append((end_x, n_x, end_y, n_y))
    total = sum(max(b - a, d - c) for a, b, c, d in gaps)
    return total if total <= most else most + 1


def word_masks(words: np.ndarray) -> dict[int, int] | None:
    """The places of each word as bits; None for sequences whose masks would take much memory."""
    if len(words) > MASKED:
        return None
    masks: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def distance(x: np.ndarray, y: np.ndarray, most: int, masks: dict[int, int] | None = None) -> int:
    """The least edits between word sequences, or `most + 1` if there are more.

    Only the band of `most` cells on either side of the diagonal is looked at.  Rows of the
    alignment are the words of x; a row of the band holds, as bits, where it goes up or down
    by one along y, and moves along y with the diagonal (Hyyrö 2003).  `masks` are those
    of y.
    """
    n_x, n_y = len(x), len(y)
    if abs(n_x - n_y) > most:
        return most + 1
    if most >= n_y:
        # A common end changes no distance, and the band then begins inside the alignment.
        end = np.arange(1 << 40, (1 << 40) + most - n_y + 1)
        return distance(np.append(x.astype(np.int64), end), np.append(y.astype(np.int64), end), most)
    masks = masks or word_masks(y)
    wide = 2 * most + 1
    full, top = (1 << wide) - 1, 1 << 2 * most
    up, down = full ^ ((1 << most) - 1), 0
    # First along the band's upper edge, whose cells never fall, then along the last column.
    score, edge, worst = most, top >> 1, 2 * most + n_x - n_y
    for i, word in enumerate(x.tolist()):
        at = i - most
        if masks is not None:
            held = masks.get(word, 0)
            same = (held >> at if at >= 0 else held << -at) & full
        else:
            window = np.packbits(y[max(0, at) : at + wide] == word, bitorder="little")
            same = int.from_bytes(window.tobytes(), "little") << max(0, -at)
        level = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (level | up) ^ full, level & up
        if i < n_y - most:
            score += not level & top
            if score > worst:
                return most + 1
        else:
            score += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        up = right_down | (level >> 1 | right_up) ^ full
        down = level >> 1 & right_up
    return min(score, most + 1)


def words_in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many words both have, repeats included; all others of the longer one are edited."""
    return len(np.intersect1d(labelled(x, 1), labelled(y, 1), assume_unique=True))


def most_edits(n_x: int, n_y: int, threshold: float) -> int:
    return int((1 - threshold) * max(n_x, n_y) + 1e-9)


def similar(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> bool:
    most = most_edits(len(x), len(y), threshold)
    if edits(x, y, most) <= most:
        return True
    return max(len(x), len(y)) - words_in_common(x, y) <= most and distance(x, y, most) <= most


def _summaries(texts: pa.Array) -> pa.Array:
    """Key of the words, their number, lowest k-mers and sketches; no key for empty texts, no sketches without words."""
    rows = []
    for text in texts.to_pylist():
        words = normal_form(text)
        if not words:
            key = hashlib.md5(b"\x00" + text.encode("utf-8", "replace")).digest() if text else None
            rows.append({"key": key, "n": 0, "lowest": None, "sketch": None, "buckets": None})
            continue
        hashes = word_hashes(words)
        sketch, lowest = sketches(labelled(hashes))
        rows.append(
            {
                "key": hashlib.md5(words).digest(),
                "n": len(hashes),
                "lowest": (lowest & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                "sketch": (sketch & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                "buckets": sketch.view(np.int64).tolist(),
            }
        )
    return pa.array(
        rows,
        pa.struct(
            [
                ("key", pa.binary()),
                ("n", pa.int32()),
                ("lowest", pa.binary()),
                ("sketch", pa.binary()),
                ("buckets", pa.list_(pa.int64())),
            ]
        ),
    )


def _word_bytes(texts: pa.Array) -> pa.Array:
    return pa.array(
        [(word_hashes(normal_form(t)) >> np.uint64(32)).astype("<u4").tobytes() for t in texts.to_pylist()], pa.binary()
    )


def _agreeing_lowest(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array(
        [
            int((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).sum()) >= AGREEING
            for a, b in zip(x.to_pylist(), y.to_pylist())
        ],
        pa.bool_(),
    )


def _aligned(threshold: float):
    def aligned(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(
            [
                similar(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), threshold)
                for a, b in zip(x.to_pylist(), y.to_pylist())
            ],
            pa.bool_(),
        )

    return F.arrow_udf(aligned, "boolean")


def _first_shared(sketch: np.ndarray, i: int, at: np.ndarray, function: int) -> np.ndarray:
    """Whether no earlier function's sketch is the same, so that this bucket is the pair's first."""
    return ~(sketch[at, :function] == sketch[i, :function]).any(axis=1)


def _candidates(i: int, n, label, side, lowest, sketch, function: int, same: bool, threshold: float) -> np.ndarray:
    """Later members that `i` has to be aligned with."""
    rest = slice(i + 1, None)
    fits = (label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]) - 1e-9)
    if not same:
        fits &= side[rest] != side[i]
    at = np.flatnonzero(fits) + i + 1
    at = at[(lowest[at] == lowest[i]).sum(axis=1) >= AGREEING]
    return at[_first_shared(sketch, i, at, function)]


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u4").reshape(len(values), -1)


def _agreeing(threshold: float):
    """Pairs of a small bucket's members."""

    def agreeing(groups: pa.Array, functions: pa.Array) -> pa.Array:
        out = []
        for members, function in zip(groups.to_pylist(), functions.to_pylist()):
            lowest, sketch = (_matrix([m[c] for m in members]) for c in ("lowest", "sketch"))
            n, label = (np.array([m[c] for m in members]) for c in ("n", "component"))
            pairs = []
            for i in range(len(members) - 1):
                for j in _candidates(i, n, label, None, lowest, sketch, function, True, threshold).tolist():
                    a, b = sorted((members[i]["node"], members[j]["node"]))
                    pairs.append({"a": a, "b": b})
            out.append(pairs)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return F.arrow_udf(agreeing, "array<struct<a:bigint,b:bigint>>")


def _numbered(values: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Numbers from 0 for the values, alike for equal ones, and how many there are."""
    distinct, numbers = np.unique(np.concatenate(values), return_inverse=True)
    return np.split(numbers, np.cumsum([len(v) for v in values])[:-1]), len(distinct)


def _block_links(threshold: float):
    """Links of two blocks of a large bucket; once two components are linked, they count as one."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> pa.Table:
        same, function = table["one"][0] == table["two"][0], table["function"][0].as_py()
        n, label, side, node = (table[c].to_numpy() for c in ("n", "component", "side", "node"))
        label = np.unique(label, return_inverse=True)[1]
        lowest, sketch = (_matrix(table[c].to_pylist()) for c in ("lowest", "sketch"))
        words = [np.frombuffer(w, "<u4") for w in table["words"].to_pylist()]
        # Numbers for the words and k-mers of the block, so that one member's can be looked up for all others.
        (single, singles), (numbers, kmers) = _numbered([labelled(w, 1) for w in words]), _numbered([labelled(w) for w in words])
        place, has = np.full(kmers, -1), np.zeros(singles, bool)
        found: tuple[list, list] = ([], [])
        for i in range(len(n) - 1):
            candidates = _candidates(i, n, label, side, lowest, sketch, function, same, threshold).tolist()
            place[numbers[i]] = np.arange(len(numbers[i]))
            has[single[i]] = True
            masks = None
            for j in candidates:
                if label[i] == label[j]:
                    continue
                most = most_edits(n[i], n[j], threshold)
                if max(n[i], n[j]) - np.count_nonzero(has[single[j]]) > most:
                    continue
                in_i = place[numbers[j]]
                at = np.flatnonzero(in_i >= 0)
                near = edits_along(at, in_i[at], int(n[j]), int(n[i]), most) <= most
                if not near:
                    masks = masks or word_masks(words[i])
                    near = distance(words[j], words[i], most, masks) <= most
                if near:
                    label[label == label[j]] = label[i]
                    found[0].append(min(node[i], node[j]))
                    found[1].append(max(node[i], node[j]))
            place[numbers[i]] = -1
            has[single[i]] = False
        return pa.table([pa.array(x, pa.int64()) for x in found], schema=kind)

    return links


def _both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """The pairs with a column of either node as x and y."""
    x = nodes.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after some more links; only these are followed."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("one"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("two"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    ends = staged(ends.select("a", "b", F.coalesce("one", "a").alias("one"), F.coalesce("two", "b").alias("two")), "omh-ends")
    moved = components(ends, "one", "two").select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    fresh = nodes.join(labels, "node", "left_anti").withColumn("component", F.col("node"))
    every = labels.unionByName(fresh).join(moved, "component", "left")
    return staged(every.select("node", F.coalesce("to", "component").alias("component")), "omh-labels")


def _several(placed: DataFrame, *more: Column) -> DataFrame:
    """Buckets that hold more than one component."""
    ends = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), *more)
    return ends.where("low <> high").drop("low", "high")


def _node_links(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that are similar to another one."""
    members = nodes.where(F.size("buckets") > 0).select("node", "n", F.posexplode("buckets").alias("function", "bucket"))
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = staged(members.join(shared, "bucket"), "omh-members")
    candidates = members.select("node").distinct()
    lowest = nodes.select("node", "lowest")
    words = staged(
        texts.join(candidates, "node", "left_semi").select("node", F.arrow_udf(_word_bytes, "binary")("text").alias("words")),
        "omh-words",
    )

    def found_in(pairs: DataFrame) -> DataFrame:
        return staged(_both(pairs, words, "words").where(_aligned(threshold)("x", "y")).select("a", "b"), "omh-links")

    labels, tested = None, None
    for turn in range(HUB_ROUNDS):
        placed = _with_component(members, labels)
        hubs = _several(placed, F.min_by(F.struct("node", "component", "n"), F.xxhash64("node", F.lit(turn))).alias("hub"))
        pairs = (
            placed.join(hubs, "bucket")
            .where(F.col("component") != F.col("hub.component"))
            .where(F.least("n", "hub.n") >= F.greatest("n", "hub.n") * threshold - 1e-9)
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        agreeing = F.arrow_udf(_agreeing_lowest, "boolean")("x", "y")
        pairs = staged(_both(pairs, lowest, "lowest").where(agreeing).select("a", "b"), "omh-pairs")
        found = found_in(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _joined(labels, found)
    own = _unresolved(members, labels)
    own = staged(own.join(nodes.select("node", "lowest", "sketch"), "node"), "omh-unresolved")
    small = own.where(F.col("size") <= SMALL).groupBy("bucket", "function")
    small = small.agg(F.collect_list(F.struct("node", "n", "lowest", "sketch", "component")).alias("members"))
    pairs = small.select(F.explode(_agreeing(threshold)("members", "function")).alias("pair")).select("pair.*")
    rest = staged(pairs.join(tested, ["a", "b"], "left_anti"), "omh-pairs")
    found = found_in(rest).unionByName(_large_links(own.where(F.col("size") > SMALL), words, threshold))
    found = staged(found, "omh-links")
    return _joined(labels, found)


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    placed = _with_component(members, labels)
    return placed.join(_several(placed, F.count("*").alias("size"), F.sum("n").alias("held")), "bucket")


def _large_links(own: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("held") / F.lit(BLOCK_WORDS)))
    placed = own.withColumn("side", F.pmod(F.xxhash64("node"), blocks))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    ends = spread.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))
    columns = ("bucket", "function", "one", "two", "node", "n", "component", "side", "lowest", "sketch", "words")
    grouped = ends.join(words, "node").select(*columns).groupBy("bucket", "one", "two")
    return grouped.applyInArrow(_block_links(threshold), "a long, b long")


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    class_as: str = "class_id",
    size_as: str = "class_size",
    kept_as: str = "kept",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The frame with each document's class (the least id in it), its size, and whether the document stays."""
    outputs = {class_as.lower(), size_as.lower(), kept_as.lower()}
    columns = [c for c in df.columns if c.lower() not in outputs]
    at = free_name(df, "place")
    found = free_name(df, "summary")
    rows = staged(
        df.select(
            *(df[f"`{c}`"] for c in columns),
            F.monotonically_increasing_id().alias(at),
            F.arrow_udf(_summaries, "struct<key:binary,n:int,lowest:binary,sketch:binary,buckets:array<bigint>>")(df[f"`{text}`"]).alias(found),
        ),
        "omh-rows",
    )
    # Empty texts are nodes of their own.
    key = F.coalesce(F.col(found)["key"], F.col(at).cast("string").cast("binary"))
    first = F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(at).alias("at")))
    nodes = staged(
        rows.groupBy(key.alias("key")).agg(
            F.min(at).alias("node"),
            first.alias("first"),
            F.count("*").alias("copies"),
            *(F.any_value(F.col(found)[c]).alias(c) for c in ("n", "lowest", "sketch", "buckets")),
        ),
        "omh-nodes",
    )
    texts = rows.select(F.col(at).alias("node"), F.col(text).alias("text"))
    labels = _node_links(nodes.select("node", "n", "lowest", "sketch", "buckets"), texts, threshold)
    placed = _with_component(nodes.select("key", "node", "first", "copies"), labels)
    classes = placed.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("size"))
    # Documents alone in their class need no join.
    shared = staged(
        placed.select("key", "component")
        .join(classes.where("size > 1"), "component")
        .select("key", F.col("first").alias("class_first"), F.col("size").alias("class_size")),
        "omh-classes",
    )
    label = free_name(df, "label")
    node = free_name(df, "node")
    known = shared.select(F.col("key").alias(node), F.struct("class_first", "class_size").alias(label))
    out = rows.withColumn(node, key).join(known, node, "left")
    class_first = F.col(label)["class_first"]
    return out.select(
        *(out[f"`{c}`"] for c in columns),
        F.when(F.col(label).isNull(), F.col(doc_id)).otherwise(class_first["id"]).alias(class_as),
        F.coalesce(F.col(label)["class_size"], F.lit(1)).alias(size_as),
        F.coalesce(class_first["at"] == F.col(at), F.lit(True)).alias(kept_as),
    )
