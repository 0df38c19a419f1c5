import numpy as np

from cloakwork.llm import embedding_dedup as D
from cloakwork.llm import permutation_index as I
from cloakwork.llm.components import components

ODD = "vec_id long, embedding array<double>, label int, kept string"


def test_footrule_by_definition():
    rng = np.random.default_rng(0)
    orders = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = I.inverted_files(orders, 12)
    query = rng.permutation(12)[:5]

    def place(order, pivot):
        at = np.flatnonzero(order == pivot)
        return at[0] if len(at) else 5

    want = [sum(abs(place(o, p) - place(query, p)) for p in range(12)) for o in orders]
    got = I.footrule(files, query, 40)
    assert len(set(np.array(want) - got)) == 1


def test_nearest_odd_rows(llm):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [1.0]), (20, [float("inf"), 1.0])]
    df = llm.createDataFrame([(*r, 0, "x") for r in rows], ODD)
    got = I.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.5)]
    assert I.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_of_every_length_are_answered_among_their_own(llm):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0]), (20, [3.0]), (21, [1.0]), (22, [-2.0]), (40, [1.0, 1.0, 1.0])]
    df = llm.createDataFrame([(*r, 0, "x") for r in rows], ODD)
    got = I.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5), (20, 1, 21, 3.0), (20, 2, 22, -6.0)]


def test_many_copies_give_the_smallest_ids(llm):
    from pyspark.sql import functions as F

    df = llm.createDataFrame([(i, [1.0, 2.0], 0, "x") for i in range(100)] + [(100, [0.5, 0.5], 0, "x")], ODD)
    got = I.nearest(df, F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 3]


def test_index_recall(llm):
    from cloakwork.llm import queries

    path = "/root/testdata/sf0.1"
    table = llm.read.parquet(f"{path}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    got = queries.op3_permutation_index(llm, path).toPandas()
    recalls = []
    for query, rows in got.groupby("query_id"):
        scores = x @ x[np.searchsorted(ids, query)]
        scores[ids == query] = -9
        best = ids[np.lexsort((ids, -scores))[:20]]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21))
        assert np.allclose(scores[np.searchsorted(ids, rows["vec_id"])], rows["score"], atol=1e-12)
        recalls.append(len(set(best) & set(rows["vec_id"])) / 20)
    assert len(recalls) == (ids % 20 == 0).sum() and np.mean(recalls) >= 0.95


def brute(rows):
    """Links and components of (id, vector, label) rows, all valid."""
    n = len(rows)
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= D.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    group = np.arange(n)
    while True:
        lower = np.array([min([group[i], *group[linked[i]]]) for i in range(n)])
        if (lower == group).all():
            break
        group = lower
    least = {g: min(rows[i][0] for i in range(n) if group[i] == g) for g in set(group)}
    return linked.sum(axis=1).tolist(), [least[g] for g in group]


def test_descent_against_all_pairs(llm):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 8))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist(), 0) for i in range(40)]
    rows += [(200 + i, (base[1] + 0.25 * rng.standard_normal(8) * np.linalg.norm(base[1]) / 8**0.5).tolist(), 1) for i in range(120)]
    rows += [(400 + i, (base[2] + 0.1 * i * rng.standard_normal(8)).tolist(), 2) for i in range(20)]
    df = llm.createDataFrame([(*r, "x") for r in rows], ODD)
    got = {r.vec_id: r for r in D.near_duplicates(df).collect()}
    links, least = brute(rows)
    assert [got[r[0]].n_links for r in rows] == links
    assert [got[r[0]].component_id for r in rows] == least
    assert all(got[r[0]].kept == (r[0] == c) for r, c in zip(rows, least))


def test_audit_sees_rare_links_of_small_labels_and_puts_them_into_the_graph(llm):
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((420, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unit[419] = unit[418] + 0.05 * unit[417]
    unit[419] /= np.linalg.norm(unit[419])
    rows = [(i, "hot" if i < 400 else "small", 32, v.astype("<f8").tobytes(), 0.0) for i, v in enumerate(unit)]
    nodes = llm.createDataFrame(rows, "id long, label string, size int, unit binary, radius double")
    # A graph that lacks the only link there is.
    edges = llm.createDataFrame([(0, 1, 0.1, True)], "a long, b long, sim double, fresh boolean")
    graph = D._graph(edges, nodes.selectExpr("id AS node", "12 AS k"))
    pairs, lacking, seen = D.audit(graph, nodes, float(np.arccos(D.THRESHOLD)), 1)
    assert [(r.a, r.b) for r in pairs.collect()] == [(418, 419)] and lacking == seen == 1
    graph = D._with_pairs(graph, nodes, pairs, 12)
    assert {(r.a, r.b) for r in D._edges_of(graph).collect()} == {(0, 1), (418, 419), (419, 418)}
    assert D.audit(graph, nodes, float(np.arccos(D.THRESHOLD)), 2)[1:] == (0, 1)


def test_descent_odd_rows(llm):
    rows = [(5, [1.0, 0.0], 1, "x"), (4, [2.0, 0.0], 1, "x"), (4, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], None, "x"), (2, None, 1, "x"),
            (1, [0.0, 0.0], 1, "x"), (0, [float("nan"), 1.0], 1, "x"), (6, [1.0], 1, "x"), (7, [1.0, 0.0], 2, "x"), (8, [None, 1.0], 1, "x")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in D.near_duplicates(llm.createDataFrame(rows, ODD)).collect())
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3)]
    assert got == [*alone, (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert D.near_duplicates(llm.createDataFrame(rows, ODD).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[1000 + i] == 1000 for i in range(60))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
