"""A Merkle manifest of a dataset: a root per group, a root of all, and proofs of rows.

The leaves of a group ascend by their order columns; every two consecutive nodes become
the hash of their hex digests, a last odd one the hash of its own, until one remains:
the group's subroot.  Subroots, by group, give the root in the same way.

Leaves are numbered by a range partitioning and counts per partition, so a group may
hold any part of the rows.  Aligned runs of `2**height` leaves are blocks.  A block's
subtree is one array in van Emde Boas order: the upper half of its levels first, then
each subtree below it, every part laid out alike; a node's place follows from its depth
and number by arithmetic alone.  The roots of blocks are the leaves of the next round,
until each group is one block.  A block is all that a task holds.

The manifest is a folder: `leaves`, a table `round-k` of blocks per round, and the same
for the subroots below `top`.

Defined results: null and empty values hash apart (`-` and `0:`); null groups and null
order values come first; leaves that tie are ordered by their digest, so repeated rows
are leaves of their own; a lone leaf is its own subroot; an empty table gives an empty
manifest whose root is null; columns that are not named are not read.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import let_workers_import
from cloakwork.sources.shared import fresh_dir

HEIGHT, SIZE = 10, 32
#: One step of a path: where the sibling stands, then its digest.
NONE, LEFT, RIGHT = b"\0" + bytes(SIZE), b"\1", b"\2"
STEP = SIZE + 1

BLOCKS = "group string, block bigint, size bigint, tree binary, root binary"


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text, `-` for null."""
    values = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels_of(size: int, height: int) -> int:
    """How often the nodes of a block are paired: to one node where the group is one block."""
    return height if size > 1 << height else max(0, size - 1).bit_length()


@functools.lru_cache(maxsize=1024)
def places(tall: int, depth: int) -> np.ndarray:
    """Where the nodes of a depth stand in the array of a tree that is `tall` levels high."""
    if tall == 1:
        return np.zeros(1, np.int64)
    upper = tall // 2
    if depth < upper:
        return places(upper, depth)
    lower, below = tall - upper, depth - upper
    number = np.arange(1 << depth)
    subtree, within = number >> below, number & ((1 << below) - 1)
    return (1 << upper) - 1 + subtree * ((1 << lower) - 1) + places(lower, below)[within]


def grow(digests: list[bytes], levels: int) -> bytes:
    """The array of the subtree above these leaves; zeros where there is no node."""
    nodes = [bytes(SIZE)] * ((2 << levels) - 1)
    row = digests
    for depth in range(levels, -1, -1):
        for at, node in zip(places(levels + 1, depth).tolist(), row):
            nodes[at] = node
        row = [parent(*row[k : k + 2]) for k in range(0, len(row), 2)]
    return b"".join(nodes)


def paths(tree: bytes, leaves: int, levels: int) -> list[bytes]:
    """For each leaf the steps to the root of its subtree, found by address."""
    rows = []
    for up in range(levels):
        present = -(-leaves >> up)
        rows.append((up, present, (places(levels + 1, levels - up) * SIZE).tolist()))
    out = []
    for slot in range(leaves):
        steps = []
        for up, present, at in rows:
            other = (slot >> up) ^ 1
            if other < present:
                steps += [LEFT if other & 1 == 0 else RIGHT, tree[at[other] : at[other] + SIZE]]
            else:
                steps.append(NONE)
        out.append(b"".join(steps))
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path lead to."""
    for k in range(0, len(path), STEP):
        side, other = path[k : k + 1], path[k + 1 : k + STEP]
        digest = parent(digest) if side == NONE[:1] else parent(other, digest) if side == LEFT else parent(digest, other)
    return digest


def siblings(path: bytes) -> list[bytes]:
    return [path[k + 1 : k + STEP] for k in range(0, len(path), STEP) if path[k] != NONE[0]]


@dataclass
class Manifest:
    """The tables of a manifest; `top` is that of the subroots."""

    leaves: DataFrame  # group, rank, size, digest, and the columns kept
    rounds: list[DataFrame]  # BLOCKS
    height: int
    top: Manifest | None = None

    def roots(self) -> DataFrame:
        """group, root."""
        done = [r.where(F.col("size") <= 1 << self.height).select("group", "root") for r in self.rounds]
        return functools.reduce(DataFrame.unionAll, done)

    def root(self) -> str | None:
        """The root of everything, as hex text."""
        found = self.top.roots().first()
        return found.root.hex() if found else None


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(df: DataFrame, order: list[str], folder: str) -> DataFrame:
    """The rows with `rank`, their number in their group, and `size`, the group's rows."""
    # The tie keeps equal rows from meeting in one range; their order changes nothing.
    given = _written(df.withColumn("tie", F.monotonically_increasing_id()), f"{folder}/unordered")
    by = ["group", *order, "digest", "tie"]
    placed = given.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = _written(placed.withColumn("part", F.shiftright("at", 33)).drop("tie"), f"{folder}/ordered")
    ranges = placed.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    all_parts = Window.partitionBy("group")
    before = F.sum("rows").over(all_parts.orderBy("part")) - F.col("rows")
    ranges = ranges.select(
        "group", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(all_parts).alias("size")
    )
    ranked = placed.join(ranges, ["group", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    return ranked.drop("at", "shift", "part")


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """BLOCKS of leaves with group, rank, size and digest."""
    schema = pa.schema(
        [("group", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("tree", pa.binary()), ("root", pa.binary())]
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size = table["size"][0].as_py()
        tree = grow(table["digest"].to_pylist(), levels_of(size, height))
        return pa.table([[table["group"][0].as_py()], [table["block"][0].as_py()], [size], [tree], [tree[:SIZE]]], schema)

    narrow = leaves.select("group", "size", "rank", "digest", F.shiftright("rank", height).alias("block"))
    return narrow.groupBy("group", "block").applyInArrow(build, BLOCKS)


def _forest(leaves: DataFrame, height: int, folder: str) -> Manifest:
    leaves = _written(leaves, f"{folder}/leaves")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    rounds, rows = [], leaves
    while True:
        rounds.append(_written(_blocks(rows, height), f"{folder}/round-{len(rounds)}"))
        if largest <= 1 << height:
            return Manifest(leaves, rounds, height)
        largest = -(-largest >> height)
        open_blocks = rounds[-1].where(F.col("size") > 1 << height)
        rows = open_blocks.select(
            "group",
            F.col("block").alias("rank"),
            F.ceil(F.col("size") / F.lit(1 << height)).cast("long").alias("size"),
            F.col("root").alias("digest"),
        )


def build(
    df: DataFrame,
    digest: Column,
    group: str,
    order: list[str],
    keep: dict[str, Column] | None = None,
    height: int = HEIGHT,
    folder: str | None = None,
) -> Manifest:
    """The manifest of the rows; `keep` are columns that stay with the leaves."""
    let_workers_import(df.sparkSession)
    folder = folder or fresh_dir(df.sparkSession, "merkle")
    named = {f"order_{k}": F.col(f"`{c}`") for k, c in enumerate(order)}
    kept = {f"kept_{name}": value for name, value in (keep or {}).items()}
    # Present names begin with a sign, so the null group is the first and no other is like it.
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group")
    columns = {"digest": digest, **named, **kept}
    rows = df.select(key, *(value.alias(name) for name, value in columns.items()))
    ranked = _ranked(rows, list(named), folder).drop(*named)
    found = _forest(ranked, height, folder)
    subroots = found.roots().select(F.lit("").alias("group"), F.col("group").alias("order_0"), F.col("root").alias("digest"))
    above = _ranked(subroots, ["order_0"], f"{folder}/top").withColumnRenamed("order_0", "kept_group")
    found.top = _forest(above, height, f"{folder}/top")
    return found


def _proved(leaves: DataFrame, blocks: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """The leaves with `path`, from their block's tree and the path that the block has above it."""
    names = [f for f in leaves.columns if f not in ("size", "digest")] + ["digest", "path"]
    rows = leaves.withColumn("block", F.shiftright("rank", height))
    if above is None:
        blocks = blocks.withColumn("above", F.lit(b""))
    else:
        over = above.select("group", F.col("rank").alias("block"), F.col("path").alias("above"))
        blocks = blocks.join(over, ["group", "block"], "left").withColumn("above", F.coalesce("above", F.lit(b"")))

    def prove(members: pa.Table, block: pa.Table) -> pa.Table:
        members = members.sort_by("rank")
        found = block.to_pylist()[0]
        own = paths(found["tree"], members.num_rows, levels_of(found["size"], height))
        whole = pa.array([p + found["above"] for p in own], pa.binary())
        return members.append_column("path", whole).select(names)

    schema = ", ".join(f"`{f}` {'binary' if f == 'path' else rows.schema[f].dataType.simpleString()}" for f in names)
    grouped = rows.groupBy("group", "block"), blocks.drop("root").groupBy("group", "block")
    return grouped[0].cogroup(grouped[1]).applyInArrow(prove, schema)


def _leaf_paths(found: Manifest) -> DataFrame:
    above = None
    for k in range(len(found.rounds) - 1, 0, -1):
        below = found.rounds[k - 1].where(F.col("size") > 1 << found.height)
        rows = below.select("group", F.col("block").alias("rank"), F.lit(0).alias("size"), F.col("root").alias("digest"))
        above = _proved(rows, found.rounds[k], above, found.height)
    return _proved(found.leaves, found.rounds[0], above, found.height)


def proofs(found: Manifest) -> DataFrame:
    """A row per leaf: the columns kept, group, rank, digest, subroot, and the path to the root.

    A path is a run of steps of 33 bytes, the lowest first: 0 for no sibling, 1 for one
    on the left, 2 for one on the right, and its digest.
    """
    upper = _leaf_paths(found.top).select(
        F.col("kept_group").alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("upper")
    )
    own = _leaf_paths(found).join(upper, "group")
    names = {c: c.removeprefix("kept_") for c in found.leaves.columns if c.startswith("kept_")}
    return own.select(
        *(F.col(c).alias(name) for c, name in names.items()),
        F.when(F.col("group") != "", F.substr("group", F.lit(2))).alias("group"),
        "rank",
        "digest",
        "subroot",
        F.concat("path", "upper").alias("path"),
    )


def folded(digest: Column, path: Column) -> Column:
    """The root that each leaf leads to, as hex text."""

    def run(digests: pa.Array, steps: pa.Array) -> pa.Array:
        return pa.array([fold(d, p).hex() for d, p in zip(digests.to_pylist(), steps.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(digest, path)


def proof_digest(path: Column) -> Column:
    """The hash of the siblings on a path, as hex text."""

    def run(steps: pa.Array) -> pa.Array:
        return pa.array([parent(*siblings(p)).hex() for p in steps.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(path)
