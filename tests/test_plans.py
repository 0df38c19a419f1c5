"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.operators import filters, keyed, reports
from cloakwork.operators.scan import detected_entities, scan_by_policy, scan_documents, scan_multilingual
from cloakwork.plans.scans import scan_pending, with_metadata
from cloakwork.policy import Policy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "docs")
    spark.range(100).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Write to user"), F.col("id"), F.lit("@mail.org now")).alias("body"),
        F.lit("en").alias("lang"),
        F.lit("unused").alias("source"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "index")
    scan_documents(docs).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_do_not_shuffle(docs):
    for df in (
        scan_documents(docs),
        scan_by_policy(docs, "lang", {"en": Policy(types=["SSN"])}),
        scan_multilingual(docs),
        detected_entities(docs),
        scan_pending(with_metadata(docs)),
    ):
        assert "Exchange" not in plan(df)
        assert "Python" not in plan(df)


def extractions(df):
    """How many searches through a whole text field named body the plan holds."""
    return len(re.findall(r"regexp_extract_all\(body#\d+", plan(df)))


def test_a_filter_on_the_result_does_not_search_twice(docs):
    # Two per search: one pattern for texts with an @ and one for the others.
    once = extractions(scan_documents(docs))
    assert once == 2
    done = scan_documents(docs, Policy(mode="FLAG"))
    for df in (
        filters.flagged(done),
        filters.high_risk(done),
        filters.with_any_type(done, ["EMAIL"]),
        reports.type_breakdown(done),
        reports.top_risk(done),
    ):
        assert extractions(df) == once


def test_entities_are_searched_once(docs):
    found = detected_entities(docs, fields=["body"]).where("type = 'EMAIL'")
    assert plan(found).count("regexp_extract_all(") == 2


def test_reports_read_metadata_columns_only(index):
    for df in (
        reports.coverage(index),
        reports.type_breakdown(index),
        reports.status_breakdown(index),
        reports.scanned_per_day(index),
        reports.scan_rate(index),
        reports.top_risk(index),
        reports.run_summary(index),
    ):
        schema = re.search(r"ReadSchema: struct<(.*?)>\n", df._jdf.queryExecution().toString() + "\n")
        assert "body" not in plan(df).split("FileScan")[1].split("]")[0], schema


def test_filters_reach_the_scan(index):
    assert "IsNull(pii_flag)" in plan(filters.unscanned(index))
    assert "EqualTo(pii_flag,true)" in plan(filters.flagged(index))
    assert "GreaterThanOrEqual(pii_count,3)" in plan(filters.high_risk(index))


def test_top_lists_are_top_n_and_aggregates_are_combined_first(index):
    assert "TakeOrderedAndProject" in plan(reports.view_flagged(index))
    assert "TakeOrderedAndProject" in plan(reports.top_risk(index))
    assert "partial_count" in plan(reports.type_breakdown(index))
    assert "partial_count" in plan(reports.coverage(index))


def test_previews_are_cut_before_the_sort(index):
    text = plan(reports.view_flagged(index))
    assert text.index("TakeOrderedAndProject") < text.index("substring(body")


def test_capping_joins_nothing(spark, index, tmp_path):
    # Keys 0 to 9 twice each, ten of the rows scanned.
    twice = index.where("doc_id < 10").withColumn("pii_flag", F.lit(None).cast("boolean"))
    twice.unionByName(twice).unionByName(index.where("doc_id >= 90")).write.parquet(str(tmp_path / "twice"))
    due = filters.unscanned(spark.read.parquet(str(tmp_path / "twice")))
    # The last key's rows fit, and they don't.
    for n, limited in ((10, False), (9, True)):
        capped = filters.cap_documents(due, n)
        text = plan(capped)
        assert "Join" not in text and "Subquery" in text and ("GlobalLimit" in text) == limited
        assert capped.count() == n
    nothing = filters.cap_documents(filters.unscanned(index), 10)
    assert nothing.count() == 0 and nothing.columns == index.columns


def test_a_capped_scan_takes_exactly_as_many_without_a_shuffle_of_texts(spark, index, tmp_path):
    twice = index.where("doc_id < 10").withColumn("pii_flag", F.lit(None).cast("boolean"))
    twice.unionByName(twice).unionByName(twice).repartition(4).write.parquet(str(tmp_path / "thrice"))
    pending = spark.read.parquet(str(tmp_path / "thrice"))
    for n in (1, 2, 4, 7, 30, 31):
        scanned = scan_pending(pending, max_docs=n)
        assert scanned.columns == pending.columns
        assert "Exchange" not in plan(scanned).split("Subquery")[0] and "Join" not in plan(scanned)
        got = scanned.where("pii_flag IS NOT NULL").select("doc_id").collect()
        assert len(got) == min(n, 30)
        assert sorted(r.doc_id for r in got) == [k // 3 for k in range(len(got))]


def test_keyed_changes_are_equi_joins(spark, index):
    updates = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("body"))
    for df in (keyed.replace_by_id(index, updates), keyed.update_by_id(index, updates)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_policy_leaves_unwanted_patterns_out_of_the_plan(docs):
    text = plan(scan_documents(docs, Policy(types=["SSN"])))
    assert "@" not in text.split("FileScan")[0]
    assert spans.find_matches(F.col("x"), ()) is not None


def test_filters_and_columns_pass_a_scan(docs):
    some = scan_documents(docs, Policy(mode="FLAG"), fields=["body"]).where("lang = 'de'").select("doc_id", "pii_flag")
    text = plan(some)
    assert "EqualTo(lang,de)" in text
    assert "source" not in text.split("FileScan")[1].split("]")[0]


def test_policies_of_one_kind_share_a_branch(docs):
    same = {f"l{i}": Policy(types=["SSN"]) for i in range(50)}
    text = plan(scan_by_policy(docs, "lang", same, Policy(types=["PHONE"]), fields=["body"]))
    assert text.count("regexp_extract_all(body") == 2


def test_streams_keep_no_state(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    logical = scan_documents(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in logical and "Join" not in logical


def test_shared_folder_is_the_named_one(spark):
    from cloakwork.sources.shared import ensure_checkpoint_dir, fresh_dir, shared_dir

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named.rstrip("/")
    assert fresh_dir(spark, "x").startswith(f"{named}/x-") and fresh_dir(spark, "x") != fresh_dir(spark, "x")
    ensure_checkpoint_dir(spark)
    assert named in spark.sparkContext.getCheckpointDir()
