import os

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import filters
from cloakwork.operators.reports import coverage
from cloakwork.plans import batch, scans
from cloakwork.plans.scans import coverage_report, scan_unscanned, scheduled_scan
from cloakwork.policy import Policy
from cloakwork.sinks.store import PART, DocumentStore
from cloakwork.sources.shared import fresh_dir

MAIL = "Write to user@mail.org about it"
FLAG = Policy(mode="FLAG")


def texts(spark, first, last):
    mail = F.concat(F.lit("Write to user"), F.col("id"), F.lit("@mail.org about it"))
    return spark.range(first, last).select(F.col("id").alias("doc_id"), mail.alias("body"))


@pytest.fixture
def store(spark, tmp_path):
    """Three partitions of twenty documents."""
    made = DocumentStore.create(spark, texts(spark, 0, 1).schema, folder=str(tmp_path / "store"), buckets=4)
    made.at = str(tmp_path / "store")
    for k in range(3):
        made.append(texts(spark, 20 * k, 20 * k + 20))
    return made


def files(store, table="documents"):
    return {os.path.join(d, n) for d, _, names in os.walk(f"{store.at}/{table}") for n in names if n.startswith("part-")}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_meet_their_states_without_an_exchange(store):
    scan_unscanned(store, FLAG, max_docs=30)
    for df in (store.read(), store.placed([1, 2]), store.states(), filters.unscanned(store.read()), store.places()):
        text = plan(df)
        assert "Exchange" not in text, text
        assert "SortMergeJoin" not in text and "Bucketed: true" in text
    # A scan adds a projection.
    rows = store.placed([1]).withColumn("due", F.col("pii_flag").isNull())
    assert "Exchange" not in plan(scans.scan_documents(rows, only=F.col("due")))
    # Finding what is due reads no text.
    assert "body" not in plan(store.places())


def test_a_run_that_flags_writes_states_only(store):
    before = files(store)
    assert tuple(scan_unscanned(store, FLAG, max_docs=25).first()) == (25, 25)
    assert ids(filters.scanned(store.read())) == list(range(25))
    stamp = store.read().where("doc_id = 0").first().pii_scanned_at
    assert tuple(scan_unscanned(store, FLAG).first()) == (35, 35)
    assert store.read().where("doc_id = 0").first().pii_scanned_at == stamp
    states = files(store, "states")
    assert tuple(scan_unscanned(store, FLAG).first()) == (0, 0)
    assert files(store) == before and files(store, "states") == states
    assert store.read().where("body LIKE '%@mail.org%'").count() == 60


def test_a_run_that_redacts_writes_the_partitions_of_its_documents(store):
    before = {p: {f for f in files(store) if f"{PART}={p}/" in f} for p in (1, 2, 3)}
    assert tuple(scan_unscanned(store, max_docs=15).first()) == (15, 15)
    after = {p: {f for f in files(store) if f"{PART}={p}/" in f} for p in (1, 2, 3)}
    assert after[2] == before[2] and after[3] == before[3] and not after[1] & before[1]
    rows = store.read()
    assert ids(rows.where("body LIKE '%[EMAIL]%'")) == ids(filters.scanned(rows)) == list(range(15))
    assert rows.count() == 60 and rows.columns[:2] == ["doc_id", "body"]
    assert rows.where("pii_scan_status IS NOT NULL").isEmpty()


def test_a_redaction_that_failed_is_finished_without_losing_what_was_found(store, monkeypatch):
    def broken(self, df):
        raise RuntimeError("boom")

    with monkeypatch.context() as m:
        m.setattr(DocumentStore, "overwrite", broken)
        with pytest.raises(RuntimeError, match="boom"):
            scan_unscanned(store, max_docs=15, scanned_at="2025-05-15T01:30:00Z")
    assert ids(store.states().where("pii_scan_status = 'redacting'")) == list(range(15))
    # Fails after the partitions are replaced.
    real = DocumentStore.log
    with monkeypatch.context() as m:
        m.setattr(DocumentStore, "log", lambda self, rows, run: real(self, rows, run) if "redacting" in str(rows.first()) else broken(self, rows))
        with pytest.raises(RuntimeError, match="boom"):
            scan_unscanned(store, max_docs=15)
    assert store.read().where("body LIKE '%[EMAIL]%'").count() == 15
    assert tuple(scan_unscanned(store).first()) == (60, 60)
    rows = store.read()
    assert rows.where("pii_flag AND pii_count = 1 AND pii_scan_status IS NULL AND body LIKE '%[EMAIL]%'").count() == 60
    assert rows.select("pii_scanned_at").distinct().count() == 2


def test_scheduled_scan_takes_what_is_left_next_time(store):
    done = [tuple(scheduled_scan(store, FLAG, rounds=5, batch=5).first())[0] for _ in range(4)]
    assert done == [25, 25, 10, 0]


def test_coverage_report(store):
    report = coverage_report(store, limit=3)
    assert tuple(report["before"].first()) == (60, 0, 0)
    assert tuple(report["after"].first()) == (60, 60, 60)
    assert [tuple(r) for r in report["types"].collect()] == [("EMAIL", 60)]
    assert ids(report["flagged"]) == [0, 1, 2]


def test_replacing_writes_the_partitions_of_the_replaced(spark, store):
    scan_unscanned(store, FLAG)
    before = {p: {f for f in files(store) if f"{PART}={p}/" in f} for p in (1, 2, 3)}
    changed = spark.createDataFrame([(3, "new text of three"), (21, None), (99, "a new document")], "doc_id long, body string")
    store.replace(changed)
    after = {p: {f for f in files(store) if f"{PART}={p}/" in f} for p in (1, 2, 3)}
    assert after[3] == before[3] and not after[1] & before[1] and not after[2] & before[2]
    rows = {r.doc_id: r for r in store.read().collect()}
    assert sorted(rows) == [*range(60), 99]
    assert rows[3].body == "new text of three" and rows[21].body is None and rows[99].body == "a new document"
    assert ids(filters.unscanned(store.read())) == [3, 21, 99]
    store.replace(changed.limit(0))
    assert store.read().count() == 61


def test_a_batch_appends_states_and_a_failed_one_is_reset(store, monkeypatch):
    before = files(store)
    with monkeypatch.context() as m:
        m.setattr(batch, "detect_lines", lambda *_: (_ for _ in ()).throw(RuntimeError("boom")))
        with pytest.raises(RuntimeError, match="boom"):
            batch.run_batch(store, max_docs=10)
    assert store.read().where("pii_scan_status = 'in_progress'").count() == 10
    run = store.next_run() - 1
    assert batch.documents_to_export(store.read()).count() == 50
    assert batch.reset_batch(store, run + 5) == 0 and batch.reset_batch(store, run) == 10
    assert batch.reset_batch(store) == 0
    done = batch.run_batch(store)
    assert tuple(coverage(done).first()) == (60, 60, 60) and done.where("pii_scan_status = 'complete'").count() == 60
    assert files(store) == before


def test_answers_about_unknown_or_repeated_ids(spark, store):
    one = [("EMAIL", 0.9, 0, 5)]
    rows = [("3", one), ("03", [("PHONE", 0.9, 7, 9)]), ("x", one), ("999", one), (None, one), ("4", None)]
    output = spark.createDataFrame(rows, "id string, entities array<struct<type:string,score:double,begin:int,end:int>>")
    batch.import_answers(store, output)
    got = {r.doc_id: (r.pii_flag, r.pii_count, r.pii_types) for r in store.states().collect()}
    assert got == {3: (True, 2, ["EMAIL", "PHONE"]), 4: (False, 0, [])}


def test_rows_of_a_key_share_a_state_and_null_keys_are_refused(spark, store):
    store.append(spark.createDataFrame([(5, MAIL), (5, MAIL), (70, None)], "doc_id long, body string"))
    assert tuple(scan_unscanned(store, FLAG).first()) == (61, 60)
    assert tuple(coverage(store.read()).first()) == (63, 63, 62)
    with pytest.raises(Exception, match="no doc_id"):
        store.append(spark.createDataFrame([(None, MAIL)], "doc_id long, body string"))


def test_appended_metadata_and_other_sessions(spark, store):
    known = scans.scan_documents(texts(spark, 60, 70), FLAG).withColumn("more", F.lit(1))
    store.append(known)
    store.append(known.limit(0))
    assert ids(filters.scanned(store.read())) == list(range(60, 70)) and store.read().count() == 70
    again = DocumentStore.reopen(spark, texts(spark, 0, 1).schema, store.at, buckets=4)
    assert again.name != store.name
    assert sorted(map(str, again.read().collect())) == sorted(map(str, store.read().collect()))
    empty = DocumentStore.create(spark, texts(spark, 0, 1).schema, folder=fresh_dir(spark, "empty"))
    assert tuple(scan_unscanned(empty).first()) == (0, 0) and batch.run_batch(empty) is None
