"""Filters, reports and changes over scanned tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.text import scanned_at_text
from cloakwork.operators import entities, filters, keyed, reports
from cloakwork.operators.scan import detected_entities, scan_documents
from cloakwork.plans import scans
from cloakwork.plans.scans import (
    scan_unscanned_partitions,
    with_metadata,
)
from cloakwork.policy import Policy
from cloakwork.rules import FIRST_NAMES
from cloakwork.sinks import exports
from cloakwork.sinks.tables import append_documents, create_index, overwrite_partitions
from cloakwork.corpus import generate_corpus
from cloakwork.sources.shared import spread, spread_rows

SCHEMA = "doc_id long, body string, pii_flag boolean, pii_count int, pii_types array<string>, pii_scanned_at timestamp"
DAY = dt.datetime(2025, 5, 1, 10)


@pytest.fixture
def table(spark):
    rows = [
        (1, "one " * 50, True, 3, ["EMAIL", "SSN"], DAY),
        (2, "two " * 50, True, 5, ["NAME"], DAY + dt.timedelta(days=2)),
        (3, "three", False, 0, [], DAY),
        (4, "four", None, None, None, None),
        (5, "five " * 50, True, 3, ["NAME", "PHONE"], DAY + dt.timedelta(days=2)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_row_choices(table):
    assert sorted(ids(filters.unscanned(table))) == [4]
    assert sorted(ids(filters.scanned(table))) == [1, 2, 3, 5]
    assert sorted(ids(filters.flagged(table))) == [1, 2, 5]
    assert sorted(ids(filters.with_any_type(table, ["SSN", "PHONE"]))) == [1, 5]
    assert sorted(ids(filters.high_risk(table))) == [1, 2, 5]
    assert sorted(ids(filters.high_risk(table, 2, by="types"))) == [1, 5]
    routes = {r.doc_id: r.route for r in filters.route_by_sensitivity(table).collect()}
    assert routes == {1: "restricted", 2: "standard", 3: "open", 4: "open", 5: "standard"}


def test_reports(table):
    assert reports.count_all(table).first().total == 5
    assert tuple(reports.coverage(table).first()) == (5, 4, 3)
    assert [tuple(r) for r in reports.type_breakdown(table).collect()] == [
        ("NAME", 2), ("EMAIL", 1), ("PHONE", 1), ("SSN", 1),
    ]
    assert [tuple(r) for r in reports.type_breakdown(table, 1).collect()] == [("NAME", 2)]
    assert {tuple(r) for r in reports.status_breakdown(table).collect()} == {(True, 3), (False, 1)}
    days = {str(r.day): r.docs for r in reports.scanned_per_day(table).collect()}
    assert days == {"2025-05-01": 2, "2025-05-03": 2}
    days = {str(r.day): r.docs for r in reports.scanned_per_day(table, fill_gaps=True).collect()}
    assert days == {"2025-05-01": 2, "2025-05-02": 0, "2025-05-03": 2}
    rates = {r.window_start: (r.docs, r.flagged_share) for r in reports.scan_rate(table).collect()}
    assert rates == {DAY: (2, 0.5), DAY + dt.timedelta(days=2): (2, 1.0)}
    assert ids(reports.top_risk(table)) == [2, 1, 5]


def test_days_and_stamps_are_utc_in_any_session(spark):
    df = spark.createDataFrame([(1, "Write to a@b.org, please, today.")], "doc_id long, body string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        done = scan_documents(df, scanned_at="2025-05-15T01:30:00Z")
        assert done.select(scanned_at_text(F.col("pii_scanned_at"))).first()[0] == "2025-05-15T01:30:00Z"
        assert str(reports.scanned_per_day(done).first().day) == "2025-05-15"
        assert str(reports.audit_rows(done).first().scan_date) == "2025-05-15"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reports_of_an_empty_table(table):
    empty = table.limit(0)
    assert tuple(reports.coverage(empty).first()) == (0, 0, 0)
    assert reports.scanned_per_day(empty, fill_gaps=True).count() == 0
    assert reports.type_breakdown(empty).count() == 0


def test_view_flagged_is_newest_first_with_short_previews(table):
    rows = reports.view_flagged(table, 2).collect()
    assert [r.doc_id for r in rows] == [2, 5]
    assert rows[0].preview == ["body: " + ("two " * 50)[:120] + "..."]


def test_preview_takes_the_first_long_fields(spark):
    df = spark.createDataFrame([(1, "s", "b" * 21, "c" * 200, "d" * 30)], "doc_id int, a string, b string, c string, d string")
    assert df.select(filters.preview(df)).first()[0] == ["b: " + "b" * 21 + "...", "c: " + "c" * 120 + "..."]


def test_cap_documents(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7 % 101, f"d{i}") for i in range(101)], "doc_id long, body string")
    for n in (1, 5, 100, 101, 500):
        assert sorted(ids(filters.cap_documents(df, n))) == list(range(min(n, 101)))
    assert filters.cap_documents(df, 0).count() == filters.cap_documents(df, None).count() == 101
    # More ranges give the same.
    monkeypatch.setattr(filters, "KEYS_PER_RANGE", 3)
    for n in (4, 60, 101, 500):
        assert sorted(ids(filters.cap_documents(df, n))) == list(range(min(n, 101)))
    two = df.withColumn("part", F.col("doc_id") % 2)
    odd = spark.createDataFrame([(None, "n"), (None, "m"), (1, "a"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, body string")
    for n in range(1, 8):
        got = sorted((r.doc_id is not None, r.doc_id or 0) for r in filters.cap_documents(odd, n).collect())
        assert got == [(False, 0), (False, 0), (True, 1), (True, 1), (True, 1), (True, 2)][:n]
    # As a condition: whole keys, never too many but for the first key.
    taken = [odd.where(filters.within_cap(odd, n)).count() for n in range(1, 8)]
    assert taken == [2, 2, 2, 2, 5, 6, 6]
    assert filters.cap_documents(odd.limit(0), 3).count() == odd.limit(0).where(filters.within_cap(odd.limit(0), 3)).count() == 0
    capped = filters.cap_documents(two, 55, ["part", "doc_id"])
    expected = sorted((i % 2, i) for i in range(101))[:55]
    assert sorted((r.part, r.doc_id) for r in capped.collect()) == expected


def test_keyed_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, v string")
    updates = spark.createDataFrame([(2, "B"), (4, "D")], "doc_id int, v string")
    got = sorted(tuple(r) for r in keyed.replace_by_id(target, updates).collect())
    assert got == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    extra = updates.withColumn("w", F.lit(1))
    changed = keyed.update_by_id(target, extra)
    assert changed.columns == ["doc_id", "v", "w"]
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "a", None), (2, "B", 1), (3, "c", None)]
    only = keyed.update_by_id(target, extra, columns=["w"])
    assert sorted(tuple(r) for r in only.collect()) == [(1, "a", None), (2, "b", 1), (3, "c", None)]


def test_an_update_can_set_null(spark):
    target = spark.createDataFrame([(1, "a")], "doc_id int, v string")
    updates = spark.createDataFrame([(1, None)], "doc_id int, v string")
    assert keyed.update_by_id(target, updates).first().v is None


def test_latest_by_id_with_a_hot_id(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("doc_id"), F.col("id").alias("n")
    )
    latest = keyed.latest_by_id(rows, "doc_id", F.col("n"))
    assert latest.count() == 20_001
    assert latest.where("doc_id = 7").first().n == 29_997
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_status_marks(spark, table):
    marked = keyed.mark_in_progress(table, table.where("doc_id in (3, 4)"))
    states = {r.doc_id: r.pii_scan_status for r in marked.collect()}
    assert states == {1: None, 2: None, 3: "in_progress", 4: "in_progress", 5: None}
    assert ids(filters.awaiting_export(marked)) == []
    assert ids(filters.awaiting_export(table)) == [4]
    done = keyed.mark_complete(marked, table.where("doc_id = 4"))
    assert {r.pii_scan_status for r in done.where("doc_id = 4").collect()} == {"complete"}


def test_entities_as_rows(spark):
    docs = spark.createDataFrame(
        [(1, "John Smith lives at home, he does", "call 206-555-0147 right now please"), (2, "nothing of note in here", None)],
        "doc_id long, a string, b string",
    )
    rows = spark.createDataFrame(
        [
            (1, "a", "NAME", 0.9, 0, 10), (1, "b", "PHONE", 0.95, 5, 17), (1, "b", "IP_ADDRESS", 0.99, 0, 3),
            (1, "a", "NAME", 0.3, 11, 16), (2, "a", "NAME", 0.1, 0, 3), (9, "a", "NAME", 0.9, 0, 3),
        ],
        "doc_id long, field string, type string, score double, begin int, end int",
    )
    from cloakwork.operators.scan import scan_with_entities

    for policy in (None, Policy()):
        attached, held = entities.entities_from(docs, rows, policy=policy)
        out = {r.doc_id: r for r in scan_with_entities(attached, held).collect()}
        assert (out[1].a, out[1].b) == ("[NAME] lives at home, he does", "call [PHONE] right now please")
        assert out[1].pii_types == ["NAME", "PHONE"] and out[1].pii_count == 2
        assert out[2].a == "nothing of note in here" and not out[2].pii_flag
    meta = {r.doc_id: (r.pii_flag, r.pii_count, r.pii_types) for r in entities.metadata_from_entities(rows).collect()}
    assert meta == {1: (True, 2, ["NAME", "PHONE"]), 2: (False, 0, []), 9: (True, 1, ["NAME"])}


def test_names_by_join_equal_names_by_rule(spark):
    made = generate_corpus(spark, 300, 250).select("doc_id", "body")
    tricky = spark.createDataFrame(
        [(1000, "Customer Robert Johnson met Thomas Thomas Martin and James Mary Robert Paul Jones, O Mary Lee"),
         (1002, "Thomas Thomas Martin was here"), (1003, "James Mary Robert Paul Jones Mary Thomas Lee, and so on"),
         (1001, "é漢😀 John Smith\nMary  Lee, Paul X and Paul xy. Mark Mc Donald JohnSmith")],
        "doc_id long, body string",
    )
    docs = made.unionByName(tricky)
    names = spark.createDataFrame([(n,) for n in FIRST_NAMES], "name string")
    by_rule = {tuple(r) for r in detected_entities(docs, Policy(types=["NAME"])).collect()}
    assert len(by_rule) > 250
    # Broadcast, and shuffled with salts.
    for most in (10**6, 0):
        by_join = entities.name_entities(docs, names, broadcast_bytes=most)
        assert {tuple(r) for r in by_join.collect()} == by_rule


def test_names_by_join_with_one_name_everywhere(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("It was John Smith again, they said").alias("body"))
    names = spark.createDataFrame([("John",)], "name string")
    assert entities.name_entities(docs, names, broadcast_bytes=0).count() == 3000


def text_table(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Write to user"), F.col("id"), F.lit("@mail.org about it")).alias("body"),
        F.concat(F.lit("d"), F.col("id") % 3).alias("day"),
    )


def test_only_partitions_with_unscanned_documents_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "index")
    start = scan_documents(with_metadata(text_table(spark)), only=F.col("day") != "d1")
    start.write.partitionBy("day").parquet(path)
    before = {p: {f.name for f in (tmp_path / "index" / p).iterdir()} for p in ("day=d0", "day=d1")}
    assert scan_unscanned_partitions(spark, path, "day") == 1
    after = {p: {f.name for f in (tmp_path / "index" / p).iterdir()} for p in ("day=d0", "day=d1")}
    assert after["day=d0"] == before["day=d0"] and not after["day=d1"] & before["day=d1"]
    table = spark.read.parquet(path)
    assert table.count() == 60 and filters.unscanned(table).count() == 0
    assert scan_unscanned_partitions(spark, path, "day") == 0


def test_a_capped_scan_in_place_touches_the_partitions_of_its_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    halves = with_metadata(text_table(spark)).withColumn("day", F.floor(F.col("doc_id") / 20).cast("string"))
    halves.write.partitionBy("day").parquet(path)
    assert scan_unscanned_partitions(spark, path, "day", max_docs=25) == 2
    assert sorted(ids(filters.scanned(spark.read.parquet(path)))) == list(range(25))


def test_create_index_and_append(spark):
    fields = text_table(spark).drop("day").schema
    assert create_index(spark, "docs_plain", fields) is True
    assert create_index(spark, "docs_plain", fields) is False
    append_documents(text_table(spark, 3).drop("day"), "docs_plain")
    append_documents(text_table(spark, 3).drop("day"), "docs_plain")
    table = spark.table("docs_plain")
    assert table.count() == 6 and filters.unscanned(table).count() == 6
    types = dict(table.dtypes)
    assert types["pii_flag"] == "boolean" and types["pii_count"] == "int"
    assert types["pii_types"] == "array<string>" and types["pii_scanned_at"] == "timestamp"


def test_appended_documents_get_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    append_documents(spark.createDataFrame([("x",), ("y",)], "body string"), path)
    got = [r.doc_id for r in spark.read.parquet(path).collect()]
    assert len(set(got)) == 2 and all(len(i) == 36 for i in got)


def test_keyed_joins_leave_a_bucketed_table_in_place(spark):
    create_index(spark, "docs_bucketed", text_table(spark).drop("day").schema, buckets=4)
    append_documents(text_table(spark, 40).drop("day"), "docs_bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        updates = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(True).alias("pii_flag"))
        out = keyed.update_by_id(spark.table("docs_bucketed"), updates)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert out.where("pii_flag").count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_export_files_are_bounded(spark, tmp_path):
    path = tmp_path / "export"
    docs = text_table(spark, 55).drop("day").unionByName(
        spark.createDataFrame([(100, "short"), (101, None)], "doc_id long, body string")
    )
    exports.export_jsonl(docs.coalesce(1), str(path), lines_per_file=20, max_chars=15)
    counts = sorted(len(f.read_text().splitlines()) for f in path.glob("*.txt"))
    assert counts == [15, 20, 20]
    lines = spark.read.schema(exports.LINE_SCHEMA).json(str(path)).collect()
    assert {r.id for r in lines} == {str(i) for i in range(55)}
    assert {len(r.text) for r in lines} == {15}


def test_audit_log_holds_no_text(spark, tmp_path):
    path = str(tmp_path / "audit")
    policy = Policy(mode="FLAG", max_chars=22)
    exports.audit_log(scan_documents(text_table(spark, 12).drop("day"), policy, scanned_at="2025-05-01 10:00:00"), path, policy)
    rows = spark.read.parquet(path).collect()
    assert set(rows[0].asDict()) == {"doc_id", "pii_flag", "pii_types", "pii_count", "pii_scanned_at", "tail_chars", "scan_date"}
    assert {r.tail_chars for r in rows} == {10, 11}
    assert (tmp_path / "audit" / "scan_date=2025-05-01").is_dir()


def test_dual_write_and_routes(spark, tmp_path, table):
    docs = text_table(spark, 5).drop("day")
    exports.dual_write(docs, scan_documents(docs), str(tmp_path / "r"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "r")).where("body like '%@%'").count() == 5
    assert spark.read.parquet(str(tmp_path / "s")).where("body like '%@%'").count() == 0
    exports.write_routes(table, str(tmp_path / "routes"))
    assert sorted(p.name for p in (tmp_path / "routes").iterdir() if p.is_dir()) == [
        "route=open", "route=restricted", "route=standard",
    ]


def test_spread_leaves_tables_with_enough_splits(spark):
    many = spark.range(0, 100, 1, 16)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rewriting_partitions_brings_no_texts_of_a_partition_to_one_task(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "index"), []
    with_metadata(text_table(spark)).write.partitionBy("day").parquet(path)

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return overwrite_partitions(df, *args)

    monkeypatch.setattr(scans, "overwrite_partitions", seen)
    # As the planner sees a large table.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scan_unscanned_partitions(spark, path, "day") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
    assert filters.unscanned(spark.read.parquet(path)).count() == 0


def test_spread_rows_gives_tasks_of_bounded_size(spark):
    rows = spread_rows(spark.range(0, 1000, 1, 1), 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000
    assert max(rows.rdd.glom().map(len).collect()) <= 110
    assert spread_rows(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 16)
    assert spread_rows(many) is many
