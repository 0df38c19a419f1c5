"""Near-duplicate vectors of one label by nearest-neighbour descent.

Equal vectors of a label are one entry.  Entries within half the threshold's angle of
another are its ball: any two members of a ball are linked, which needs no pairs, so a
thousand copies of a vector are a ball and not half a million links.  Random
hyperplanes bring entries together that may share a ball.

The hubs of the balls get a neighbour graph, started from hyperplane buckets and refined
by neighbour descent: each hub brings all it is a neighbour of, in either direction,
together; those that are nearer to each other than their lists know replace the
farthest, until few do.  A hub is saturated if its whole list is near enough for a link
between members of the balls; its list is made twice as long and the descent goes on.
Then hubs of every label are compared with all others of it, a label of few hubs whole
and a large one as far as it takes to see enough pairs that may hold links, if need be
whole.  Pairs that the lists lack are put into them and the descent goes on, until an
audit of other hubs lacks none; while many are lacking, all lists are made longer too.

Hubs within the threshold's angle plus both balls' radii may have linked members.  If the
three angles allow no other, all members are linked; else the members are compared in
double precision, block by block, and only counts go on.  Components are those of hubs.

Defined results: vectors that are null, empty, zero, hold null or non-finite components,
or have no label, have no links and are their own component; vectors of different
lengths do not link; rows are compared as rows, so rows of equal id link if their vectors
do; a null id counts as a row and is the component of none with ids; an empty table
gives no rows; other columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import components
from cloakwork.llm.permutation_index import valid_vector
from cloakwork.llm.shared import free_name, staged

THRESHOLD = 0.93
#: Tables of random hyperplanes, bits of each, and members of a bucket to aim for and at most.
TABLES, BITS, BUCKET, MOST = 6, 24, 48, 256
#: Length of the lists at first, most rounds between two enlargements, and the part of the lists
#: that has to change for another round.
NEIGHBOURS, ROUNDS, STILL = 12, 6, 0.02
#: What a place brings a member at most, in one round.
BROUGHT = 3
#: Hubs of a label that an audit begins with, pairs it has to see, how many times as many hubs are
#: taken while it has not, and the part of the pairs under which all lists are made longer.
AUDITED, AUDITED_PAIRS, MORE, RECALL = 256, 300, 4, 0.98
MEMBERS_AT_ONCE = 1_024
MARGIN = 1e-5
SEED = 42


def unit_vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _prepared(vectors: pa.Array, labels: pa.Array) -> pa.Array:
    """Unit vector in double precision, and a key of label and vector."""
    rows = []
    for vector, label in zip(vectors.to_pylist(), labels.to_pylist()):
        if vector is None:
            rows.append(None)
            continue
        v = np.array(vector, "<f8") + 0.0
        unit = v / np.abs(v).max()
        unit = unit / np.sqrt((unit * unit).sum())
        rows.append({"unit": unit.tobytes(), "key": hashlib.md5(v.tobytes() + str(label).encode()).digest(), "size": len(v)})
    return pa.array(rows, pa.struct([("unit", pa.binary()), ("key", pa.binary()), ("size", pa.int32())]))


def _signatures(units: pa.Array) -> pa.Array:
    """For each table the sides of random hyperplanes, as bits."""
    out = []
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS)[::-1]
    for unit in units.to_pylist():
        v = np.frombuffer(unit, "<f8")
        if len(v) not in planes:
            planes[len(v)] = np.random.default_rng(SEED).standard_normal((TABLES * BITS, len(v)))
        out.append((((planes[len(v)] @ v) > 0).reshape(TABLES, BITS) @ weights).tolist())
    return pa.array(out, pa.list_(pa.int64()))


_EDGES = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])
_EDGES_SQL = "array<struct<a:bigint,b:bigint,sim:double>>"


def _lists(counts: list[int], parts: list[tuple], kind: pa.StructType) -> pa.Array:
    """A list of structs per row from flat columns."""
    columns = [np.concatenate(c) if c else np.empty(0) for c in (zip(*parts) if parts else [()] * len(kind))]
    values = pa.StructArray.from_arrays(
        [pa.array(c, kind[i].type, safe=False) for i, c in enumerate(columns)], fields=list(kind)
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _of_groups(groups: pa.Array):
    """Bounds of each group's members, and the members' columns."""
    members = groups.flatten()
    sizes = [len(g) if g is not None else 0 for g in groups]
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist())), members


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest in each row that are over -2."""
    k = min(k, sims.shape[1])
    columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(sims)), k)
    columns = columns.reshape(-1)
    real = sims[rows, columns] > -2
    return rows[real], columns[real]


def _bucket_edges(k: int, to_hubs: bool):
    """Of every bucket the k nearest of each member; for k = 0 the least id within half the angle.

    With `to_hubs` that of a hub, for members that are none.
    """
    half = math.cos(math.acos(THRESHOLD) / 2) + MARGIN

    def edges(groups: pa.Array) -> pa.Array:
        bounds, members = _of_groups(groups)
        ids, counts, parts = members.field("id").to_numpy(), [], []
        hubs = members.field("hub").to_numpy(zero_copy_only=False)
        for low, high in bounds:
            x = unit_vectors(members.field("unit").slice(low, high - low))
            own, sims = ids[low:high], x @ x.T
            if k:
                np.fill_diagonal(sims, -3)
                rows, columns = _top(sims, k)
            else:
                hub = hubs[low:high]
                offered = hub[None, :] & ~hub[:, None] if to_hubs else own[None, :] < own[:, None]
                near = (sims >= half) & offered
                columns = np.where(near, own[None, :], np.iinfo(np.int64).max).argmin(axis=1)
                rows = np.flatnonzero(near.any(axis=1))
                columns = columns[rows]
            counts.append(len(rows))
            parts.append((own[rows], own[columns], sims[rows, columns]))
        return _lists(counts, parts, _EDGES)

    return F.arrow_udf(edges, _EDGES_SQL)


def bucketed(nodes: DataFrame, k: int, to_hubs: bool = False) -> DataFrame:
    """(a, b, sim) from the buckets of all tables; `nodes` are (id, label, size, unit) and, with `to_hubs`, hub.

    A large bucket is dealt into parts; hubs then go to all of them.
    """
    if not to_hubs:
        nodes = nodes.withColumn("hub", F.lit(False))
    # As many bits as make buckets of about BUCKET members in each label.
    per_label = nodes.groupBy("label", "size").count()
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("count") / F.lit(BUCKET))), F.lit(0)), F.lit(BITS)).cast("int")
    per_label = per_label.select("label", "size", bits.alias("bits"))
    signed = nodes.withColumn("signatures", F.arrow_udf(_signatures, "array<bigint>")("unit")).join(per_label, ["label", "size"])
    spread = signed.select("id", "unit", "hub", "label", "size", "bits", F.posexplode("signatures").alias("table", "signature"))
    bucket = F.expr(f"shiftright(signature, {BITS} - bits)")
    placed = spread.select("id", "unit", "hub", "label", "size", "table", bucket.alias("bucket"))
    where = ["label", "size", "table", "bucket"]
    sizes = placed.groupBy(*where).agg(
        F.ceil(F.count("*") / F.lit(MOST)).alias("parts"), F.count("*").alias("members"), F.count_if("hub").alias("hubs")
    )
    sizes = sizes.where("hubs > 0 AND hubs < members" if to_hubs else "members > 1").drop("members", "hubs")
    one = F.array(F.pmod(F.xxhash64("id", "table"), "parts"))
    chunks = F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(one)
    groups = placed.join(sizes, where).withColumn("chunk", F.explode(chunks)).groupBy(*where, "chunk")
    return groups.agg(F.collect_list(F.struct("id", "unit", "hub")).alias("members")).select(
        F.explode(_bucket_edges(k, to_hubs)("members")).alias("e")
    ).select("e.*")


def _local_join(groups: pa.Array) -> pa.Array:
    """Members of a place that are nearer to each other than the farthest in their lists."""
    bounds, members = _of_groups(groups)
    ids, kth = members.field("id").to_numpy(), members.field("kth").to_numpy()
    fresh = members.field("fresh").to_numpy(zero_copy_only=False)
    counts, parts = [], []
    for low, high in bounds:
        x = unit_vectors(members.field("unit").slice(low, high - low))
        own, new = ids[low:high], fresh[low:high]
        sims = x @ x.T
        sims[~(new[:, None] | new[None, :]) | (sims <= kth[low:high, None])] = -3
        np.fill_diagonal(sims, -3)
        rows, columns = _top(sims, BROUGHT)
        counts.append(len(rows))
        parts.append((own[rows], own[columns], sims[rows, columns]))
    return _lists(counts, parts, _EDGES)


_NEIGHBOURS = pa.struct([("id", pa.int64()), ("sim", pa.float64()), ("fresh", pa.bool_())])
_NEIGHBOURS_SQL = "array<struct<id:bigint,sim:double,fresh:boolean>>"


def _merged(groups: pa.Array, lengths: pa.Array) -> pa.Array:
    """The nearest of each list, nearest first, each once; known ones stay known."""
    bounds, members = _of_groups(groups)
    ids, sims = members.field("b").to_numpy(), members.field("sim").to_numpy()
    fresh = members.field("fresh").to_numpy(zero_copy_only=False)
    counts, parts = [], []
    for (low, high), k in zip(bounds, lengths.to_pylist()):
        order = np.lexsort((fresh[low:high], ids[low:high]))
        once = order[np.flatnonzero(np.diff(ids[low:high][order], prepend=-1 - abs(int(ids[low:high].min()))))]
        best = low + once[np.lexsort((ids[low:high][once], -sims[low:high][once]))[:k]]
        counts.append(len(best))
        parts.append((ids[best], sims[best], fresh[best]))
    return _lists(counts, parts, _NEIGHBOURS)


def _graph(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, k, near) from edges (a, b, sim, fresh) and (node, k)."""
    lists = edges.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "sim", "fresh")).alias("all"))
    near = F.arrow_udf(_merged, _NEIGHBOURS_SQL)("all", "k")
    return staged(lists.join(lengths, "node").select("node", "k", near.alias("near")), "descent-graph")


def _edges_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("node").alias("a"), "k", F.explode("near").alias("n")).select(
        "a", "k", F.col("n.id").alias("b"), F.col("n.sim").alias("sim"), F.col("n.fresh").alias("fresh")
    )


def _kth() -> Column:
    return F.when(F.size("near") < F.col("k"), F.lit(-2.0)).otherwise(F.element_at("near", -1)["sim"])


def descended(graph: DataFrame, nodes: DataFrame, turn: int = 0) -> DataFrame:
    """The graph after rounds of neighbours-of-neighbours joins; the turn is which descent it is."""
    for count in range(ROUNDS):
        edges = _edges_of(graph)
        met = (
            edges.select(F.col("a").alias("place"), F.col("b").alias("id"), "fresh")
            .unionByName(edges.select(F.col("b").alias("place"), F.col("a").alias("id"), "fresh"))
            .groupBy("place", "id")
            .agg(F.max("fresh").alias("fresh"))
        )
        # A place that very many meet at is split, each time in another way.
        parts = met.groupBy("place").agg(F.ceil(F.count("*") / F.lit(MOST)).alias("parts"), F.max("fresh").alias("any"))
        met = met.join(parts.where("any").select("place", "parts"), "place")
        known = graph.select(F.col("node").alias("id"), _kth().alias("kth")).join(nodes.select("id", "unit"), "id")
        places = met.join(known, "id").groupBy("place", F.pmod(F.xxhash64("id", "place", F.lit(turn * ROUNDS + count)), "parts").alias("part"))
        gathered = places.agg(F.collect_list(F.struct("id", "unit", "kth", "fresh")).alias("members"))
        brought = gathered.select(F.explode(F.arrow_udf(_local_join, _EDGES_SQL)("members")).alias("e")).select("e.*")
        old = edges.select("a", "b", "sim", F.lit(False).alias("fresh"))
        graph = _graph(old.unionByName(brought.withColumn("fresh", F.lit(True))), graph.select("node", "k"))
        change = graph.agg(
            F.sum(F.size(F.filter("near", lambda n: n["fresh"]))).alias("fresh"), F.sum("k").alias("all")
        ).first()
        if not change["fresh"] or change["fresh"] < STILL * change["all"]:
            break
    return graph


def _longer(graph: DataFrame, which: Column) -> DataFrame:
    """Lists of the nodes `which` get twice the length, and their neighbours count as fresh."""
    again = F.transform("near", lambda n: F.struct(n["id"].alias("id"), n["sim"].alias("sim"), F.lit(True).alias("fresh")))
    return staged(
        graph.select(
            "node", F.when(which, F.col("k") * 2).otherwise(F.col("k")).alias("k"), F.when(which, again).otherwise(F.col("near")).alias("near")
        ),
        "descent-graph",
    )


def _near_pairs(angle: float):
    """Pairs of two blocks' members that are within the angle and both radii, each once and least id first."""

    def near(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(ones.to_pylist(), others.to_pylist()):
            x, y = (np.stack([np.frombuffer(m["unit"], "<f8") for m in side]) for side in (one, other))
            (i, r), (j, q) = ([np.array([m[c] for m in side]) for c in ("id", "radius")] for side in (one, other))
            sims = x @ y.T
            apart = np.arccos(np.clip(sims, -1, 1))
            rows, columns = np.nonzero((apart <= angle + r[:, None] + q[None, :] + MARGIN) & (i[:, None] != j[None, :]))
            ends = np.sort(np.stack([i[rows], j[columns]], axis=1), axis=1)
            out.append([{"a": a, "b": b, "sim": s} for (a, b), s in zip(ends.tolist(), sims[rows, columns].tolist())])
        return pa.array(out, pa.list_(_EDGES))

    return F.arrow_udf(near, _EDGES_SQL)


def audit(graph: DataFrame, nodes: DataFrame, angle: float, turn: int) -> tuple[DataFrame, int, int]:
    """Pairs (a, b, sim) of hubs that may hold links and that the graph lacks, their number, and that of all seen.

    Hubs of each label, in the order of a hash, are compared with all of the label, block by
    block, until `AUDITED_PAIRS` pairs were seen or the label is through.
    """
    where = ["label", "size"]
    first = nodes.groupBy(*where).agg(F.count("*").alias("n"))
    todo = staged(
        first.select(*where, "n", F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("low"), F.least(F.lit(1.0), AUDITED / F.col("n")).alias("high")),
        "descent-audit",
    )
    at = F.pmod(F.xxhash64("id", F.lit(f"audit {turn}")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    member = F.collect_list(F.struct("id", "unit", "radius"))
    all_found = None
    while not todo.isEmpty():
        placed = nodes.join(todo, where)
        n_blocks = F.ceil(F.col("n") / F.lit(MEMBERS_AT_ONCE))
        blocks = placed.groupBy(*where, F.pmod(F.xxhash64("id"), n_blocks).alias("block")).agg(member.alias("others"))
        some = placed.where((at >= F.col("low")) & (at < F.col("high")))
        asked = F.ceil(F.col("n") * (F.col("high") - F.col("low")) / F.lit(MEMBERS_AT_ONCE))
        some = some.groupBy(*where, n_blocks.alias("blocks"), F.pmod(F.xxhash64("id", F.lit(turn)), asked).alias("part")).agg(member.alias("ones"))
        some = some.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = some.join(blocks, [*where, "block"]).select(*where, F.explode(_near_pairs(angle)("ones", "others")).alias("e"))
        found = staged(pairs.select(*where, "e.*"), "descent-audit")
        all_found = found if all_found is None else all_found.unionByName(found)
        counts = found.groupBy(*where).agg(F.count("*").alias("more"))
        left = todo.where("high < 1").join(counts, where, "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0)))
        left = left.where(F.col("seen") < AUDITED_PAIRS)
        todo = staged(
            left.select(*where, "n", "seen", F.col("high").alias("low"), F.least(F.lit(1.0), F.col("high") * MORE).alias("high")),
            "descent-audit",
        )
    if all_found is None:
        return nodes.sparkSession.createDataFrame([], "a long, b long, sim double"), 0, 0
    seen = all_found.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    edges = _edges_of(graph).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    flagged = staged(seen.join(edges.withColumn("known", F.lit(True)), ["a", "b"], "left"), "descent-audit")
    n = flagged.agg(F.count("*").alias("all"), F.count_if(F.col("known").isNull()).alias("lacking")).first()
    return flagged.where("known IS NULL").drop("known"), n["lacking"], n["all"]


def _with_pairs(graph: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The graph with pairs put into the lists of both; nodes without a list get one."""
    both = pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    edges = _edges_of(graph).select("a", "b", "sim", "fresh").unionByName(both.withColumn("fresh", F.lit(True)))
    lengths = nodes.select(F.col("id").alias("node")).join(graph.select("node", "k"), "node", "left")
    return _graph(edges, lengths.select("node", F.coalesce("k", F.lit(k)).alias("k")))


def neighbour_graph(nodes: DataFrame, angle: float, reach: float, k: int = NEIGHBOURS) -> DataFrame:
    """A graph whose lists hold the neighbours within the angle `reach` as far as found.

    `nodes` are (id, label, size, unit, radius); pairs within `angle` and both radii are audited.
    """
    least = math.cos(min(math.pi, reach))
    edges = bucketed(nodes, -(-k // 2)).withColumn("fresh", F.lit(True))
    graph = descended(_graph(edges, nodes.select(F.col("id").alias("node"), F.lit(k).alias("k"))), nodes)
    total, turn = nodes.count(), 0
    while True:
        turn += 1
        saturated = (F.size("near") >= F.col("k")) & (_kth() >= least) & (F.col("k") < total)
        if graph.where(saturated).isEmpty():
            pairs, lacking, seen = audit(graph, nodes, angle, turn)
            if not lacking:
                return graph
            graph = _with_pairs(graph, nodes, pairs, k)
            saturated = (F.col("k") < total) & F.lit(lacking > (1 - RECALL) * seen)
        graph = descended(_longer(graph, saturated), nodes, turn)


def _balls(entries: DataFrame) -> DataFrame:
    """(id, hub, angle): each entry's hub and its angle to it."""
    # Hubs are those that no smaller one was found near; the others look for the hubs.
    others = staged(bucketed(entries, 0).select(F.col("a").alias("id")).distinct(), "descent-near")
    flagged = entries.join(others.withColumn("other", F.lit(True)), "id", "left").withColumn("hub", F.col("other").isNull())
    to_hubs = bucketed(flagged.drop("other"), 0, to_hubs=True).groupBy("a").agg(F.min(F.struct("b", "sim")).alias("hub"))
    held = entries.select("id").join(staged(to_hubs.withColumnRenamed("a", "id"), "descent-near"), "id", "left")
    angle = F.acos(F.least(F.col("hub.sim"), F.lit(1.0)))
    return held.select(
        "id", F.coalesce("hub.b", "id").alias("hub"), F.when(F.col("hub").isNull(), 0.0).otherwise(angle + MARGIN / 10).alias("angle")
    )


def _compared(threshold: float):
    """Links of each member of one block with those of another: (id, n) of both sides."""
    kind = pa.struct([("id", pa.int64()), ("n", pa.int64())])

    def compared(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(ones.to_pylist(), others.to_pylist()):
            x, y = (np.stack([np.frombuffer(m["unit"], "<f8") for m in side]) for side in (one, other))
            linked = x @ y.T >= threshold
            rows = [{"id": m["id"], "n": int(n)} for m, n in zip(one, linked @ np.array([m["copies"] for m in other])) if n]
            rows += [{"id": m["id"], "n": int(n)} for m, n in zip(other, np.array([m["copies"] for m in one]) @ linked) if n]
            out.append(rows)
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(compared, "array<struct<id:bigint,n:bigint>>")


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    links_as: str = "n_links",
    component_as: str = "component_id",
    kept_as: str = "kept",
) -> DataFrame:
    """The frame with each vector's number of links, component (least id) and whether it is that."""
    if threshold != THRESHOLD:
        raise ValueError("the threshold is a constant of the module")
    outputs = {links_as.lower(), component_as.lower(), kept_as.lower()}
    columns = [c for c in df.columns if c.lower() not in outputs]
    at, found = free_name(df, "place"), free_name(df, "prepared")
    part = valid_vector(vector) & F.col(label).isNotNull()
    doubles = F.transform(vector, lambda x: x.cast("double"))
    rows = staged(
        df.select(
            *(df[f"`{c}`"] for c in columns),
            F.monotonically_increasing_id().alias(at),
            F.arrow_udf(_prepared, "struct<unit:binary,key:binary,size:int>")(
                F.when(part, doubles), F.col(label).cast("string")
            ).alias(found),
        ),
        "descent-rows",
    )
    least_id = F.min(F.struct(F.col(vec_id).isNull().alias("no_id"), F.col(vec_id).alias("id")))
    entries = staged(
        rows.where(F.col(found).isNotNull())
        .groupBy(F.col(found)["key"].alias("key"))
        .agg(
            F.min(at).alias("id"),
            F.any_value(F.col(label).cast("string")).alias("label"),
            F.any_value(F.col(found)["unit"]).alias("unit"),
            F.any_value(F.col(found)["size"]).alias("size"),
            F.count("*").alias("copies"),
            least_id.alias("least"),
        ),
        "descent-entries",
    )
    members = staged(entries.join(_balls(entries.select("id", "label", "size", "unit")), "id"), "descent-members")
    balls = members.groupBy("hub").agg(
        F.max("angle").alias("radius"), F.sum("copies").alias("rows"), F.count("*").alias("entries"), F.min("least").alias("least")
    )
    hubs = staged(
        members.where("id = hub").select("id", "label", "size", "unit").join(balls.withColumnRenamed("hub", "id"), "id"),
        "descent-hubs",
    )
    angle = math.acos(threshold)
    widest = hubs.agg(F.max("radius")).first()[0] or 0.0
    graph = neighbour_graph(hubs.select("id", "label", "size", "unit", "radius"), angle, angle + 2 * widest + MARGIN)
    pairs = _edges_of(graph).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    pairs = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))

    def side(name: str) -> DataFrame:
        return hubs.select(F.col("id").alias(name), F.col("radius").alias(f"{name}_radius"), F.col("rows").alias(f"{name}_rows"))

    apart = F.acos(F.least(F.col("sim"), F.lit(1.0)))
    around = F.col("a_radius") + F.col("b_radius")
    pairs = staged(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(apart <= angle + around + MARGIN)
        .withColumn("all", apart + around <= angle - MARGIN),
        "descent-pairs",
    )
    # Balls all of whose members are linked.
    whole = pairs.where("all")
    of_ball = (
        whole.select(F.col("a").alias("hub"), F.col("b_rows").alias("n"))
        .unionByName(whole.select(F.col("b").alias("hub"), F.col("a_rows").alias("n")))
        .groupBy("hub")
        .agg(F.sum("n").alias("of_ball"))
    )
    # The others, member by member, in blocks.
    of_blocks = members.join(balls.select("hub", "entries"), "hub").groupBy(
        "hub", F.pmod(F.xxhash64("id"), F.ceil(F.col("entries") / F.lit(MEMBERS_AT_ONCE))).alias("block")
    )
    blocks = of_blocks.agg(F.collect_list(F.struct("id", "unit", "copies")).alias("members"))

    def block_of(name: str) -> DataFrame:
        return blocks.select(F.col("hub").alias(name), F.col("members").alias(f"{name}_members"))

    some = pairs.where(~F.col("all")).select("a", "b").join(block_of("a"), "a").join(block_of("b"), "b")
    some = staged(some.select("a", "b", _compared(threshold)("a_members", "b_members").alias("links")), "descent-some")
    of_member = some.select(F.explode("links").alias("l")).groupBy(F.col("l.id").alias("id")).agg(F.sum("l.n").alias("of_member"))
    linked = whole.select("a", "b").unionByName(some.where(F.size("links") > 0).select("a", "b")).distinct()
    labels = components(linked).withColumnRenamed("node", "hub")
    places = hubs.select(F.col("id").alias("hub"), "rows", "least").join(labels, "hub", "left")
    places = places.withColumn("component", F.coalesce("component", "hub"))
    least = places.groupBy("component").agg(F.min("least").alias("first"))
    of_hub = places.join(least, "component").join(of_ball, "hub", "left").select(
        "hub", "first", (F.col("rows") - 1 + F.coalesce("of_ball", F.lit(0))).alias("of_hub")
    )
    result = free_name(df, "result")
    key = free_name(df, "key")
    placed = members.join(of_hub, "hub").join(of_member, "id", "left").select(
        F.col("key").alias(key),
        F.struct((F.col("of_hub") + F.coalesce("of_member", F.lit(0))).alias("links"), F.col("first.id").alias("component")).alias(result),
    )
    out = rows.withColumn(key, F.col(found)["key"]).join(staged(placed, "descent-result"), key, "left")
    component = F.when(F.col(result).isNull(), F.col(vec_id)).otherwise(F.col(result)["component"])
    return out.select(
        *(out[f"`{c}`"] for c in columns),
        F.coalesce(F.col(result)["links"], F.lit(0)).cast("long").alias(links_as),
        component.alias(component_as),
        F.coalesce(component == F.col(vec_id), F.lit(False)).alias(kept_as),
    )
