import datetime
import json

import pytest
from pyspark.sql import functions as F

from cloakwork.operators.ragged import scan_ragged_documents, with_metadata_inside
from cloakwork.plans.batch import import_results
from cloakwork.plans.scans import process_ragged_files, with_metadata
from cloakwork.policy import Policy
from cloakwork.sources import checked

MAIL = "Please write to ann@mail.org today"
AT = "2025-05-15T01:30:00Z"


def variants(spark, values):
    rows = [(i, None if v is None else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, text string").select("n", F.parse_json("text").alias("document"))


def documents(df):
    return [None if r.d is None else json.loads(r.d) for r in df.orderBy("n").select(F.to_json("document").alias("d")).collect()]


def test_strings_are_redacted_and_everything_else_stays(spark):
    deep = {"list": [1, "x", None, {"note": MAIL}], "at": 1.25}
    values = [
        {"b": MAIL, "a": f"{MAIL} or call 555-123-4567", "n": 10**17, "x": 0.5, "t": True, "none": None, "deep": deep, "s": "a@b.org"},
        {"only": "nothing to be found in this text"},
        {},
    ]
    out = scan_ragged_documents(variants(spark, values), scanned_at=AT)
    assert documents(out) == [
        {**values[0], "b": "Please write to [EMAIL] today", "a": "Please write to [EMAIL] today or call [PHONE]"},
        *values[1:],
    ]
    rows = out.orderBy("n").collect()
    assert [(r.pii_flag, r.pii_count, r.pii_types) for r in rows] == [(True, 3, ["EMAIL", "PHONE"]), (False, 0, []), (False, 0, [])]
    kinds = out.where("n = 0").select(*(F.schema_of_variant(F.variant_get("document", f"$.{f}", "variant")) for f in "nxt")).first()
    assert list(kinds) == ["BIGINT", "DECIMAL(1,1)", "BOOLEAN"]


def test_what_is_no_object_is_clean_and_stays(spark):
    values = [None, 5, [{"a": MAIL}], MAIL, True]
    out = scan_ragged_documents(variants(spark, values))
    assert documents(out) == values
    assert {(r.pii_flag, r.pii_count, tuple(r.pii_types)) for r in out.collect()} == {(False, 0, ())}
    assert scan_ragged_documents(variants(spark, [])).collect() == []


def test_policies_hold_for_ragged_documents(spark):
    df = variants(spark, [{"text": f"{MAIL} 555-123-4567", "short": "a@b.org"}])
    flagged = scan_ragged_documents(df, Policy(mode="FLAG"))
    assert documents(flagged) == documents(df) and flagged.first().pii_count == 2
    only = scan_ragged_documents(df, Policy(types=["PHONE"], min_chars=5))
    assert documents(only)[0]["text"] == f"{MAIL} [PHONE]"
    cut = scan_ragged_documents(df, Policy(max_chars=30, min_chars=3))
    assert documents(cut) == [{"text": "Please write to [EMAIL] today 555-123-4567", "short": "[EMAIL]"}]
    kept = df.withColumn("pii_flag", F.lit("old")).withColumn("more", F.lit(1))
    assert scan_ragged_documents(kept).columns == ["n", "document", "more", "pii_flag", "pii_count", "pii_types", "pii_scanned_at"]


def test_a_ragged_scan_is_a_projection(spark):
    plan = scan_ragged_documents(variants(spark, [{"a": MAIL}]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_metadata_inside_the_document(spark):
    values = [{"b": MAIL, "pii_flag": "old", "pii_count": [1]}, [1]]
    out = scan_ragged_documents(variants(spark, values), scanned_at=datetime.datetime(2025, 5, 15, 1, 30))
    got = [json.loads(r.j) for r in out.orderBy("n").select(with_metadata_inside(out).alias("j")).collect()]
    assert got[0].pop("pii_scanned_at").endswith("Z")
    assert got == [{"b": "Please write to [EMAIL] today", "pii_flag": True, "pii_count": 1, "pii_types": ["EMAIL"]}, [1]]


@pytest.fixture
def folder(tmp_path):
    files = {
        "list.json": json.dumps([{"a": MAIL}, 7, {"b": 1}, "x" * 30, None, [1]]),
        "one.json": f'\n {json.dumps({"c": MAIL})} ',
        "cut.json": json.dumps([{"a": MAIL}])[:-3],
        "two.json": '{"a": 1} {"a": 2}',
        "pair.json": '{"a": 1}, {"a": 2}',
        "twice.json": '{"a": 1, "a": 2}',
        "closed.json": '{"a": 1}} {',
        "list_and.json": '[{"a": 1}] x',
        "names.json": '{"a": 1}, "b": {"a": 2}',
        "empty.json": " \n",
        "none.json": "[]",
        "scalar.json": "12",
    }
    inside = tmp_path / "in"
    inside.mkdir()
    for name, text in files.items():
        (inside / name).write_text(text)
    (inside / "bytes.json").write_bytes(b'{"a": "\xff\xfe"}')
    (inside / "skipped.txt").write_text("no")
    return inside


def test_every_document_is_accepted_or_rejected_with_its_place(spark, folder):
    every = checked.check_json_documents(spark, str(folder), glob="*.json")
    counted, seen = checked.counting(every)
    rows = counted.collect()
    name = lambda r: r.source_key.rsplit("/", 1)[1].removesuffix(".json")
    assert sorted((name(r), r.position) for r in rows if r.reason is None) == [("list", 0), ("list", 2), ("one", 0)]
    assert sorted((name(r), r.position, r.reason) for r in rows if r.reason and r.position is not None) == [
        ("list", p, checked.NOT_AN_OBJECT) for p in (1, 3, 4, 5)
    ] + [("scalar", 0, checked.NOT_AN_OBJECT)]
    assert {name(r): r.reason for r in rows if r.reason and r.position is None} == {
        **dict.fromkeys(("cut", "two", "pair", "twice", "closed", "list_and", "names"), checked.NOT_JSON),
        "empty": checked.EMPTY,
        "bytes": checked.NOT_UTF8,
    }
    assert seen.get == {"read": 17, "accepted": 3, "rejected": 14}
    assert all((r.raw is None) == (r.reason is None) == (r.document is not None) for r in rows)


def test_process_ragged_files_stores_nothing_malformed(spark, folder, tmp_path):
    table, rejects = str(tmp_path / "table"), str(tmp_path / "rejects")
    for run in (1, 2):
        summary = process_ragged_files(spark, str(folder), table, rejects, glob="*.json", scanned_at=AT)
        assert tuple(summary.first()) == (17, 3, 2, 14)
        assert spark.read.parquet(table).count() == 3 * run and spark.read.parquet(rejects).count() == 14 * run
    stored = spark.read.parquet(table)
    assert stored.columns == ["source_key", "position", "document", "pii_flag", "pii_count", "pii_types", "pii_scanned_at"]
    texts = {r.d for r in stored.select(F.to_json("document").alias("d")).collect()}
    assert texts == {'{"a":"Please write to [EMAIL] today"}', '{"b":1}', '{"c":"Please write to [EMAIL] today"}'}


def entity(**more):
    return {"Type": "EMAIL", "Score": 0.9, "BeginOffset": 0, "EndOffset": 5, **more}


def answers():
    good = [json.dumps({"id": str(i), "Entities": [entity()] if i % 2 else []}) for i in range(40)]
    odd = {
        3: '{"id": "x", "Entities": [',
        7: json.dumps({"Entities": []}),
        11: json.dumps({"id": "11", "Entities": "none"}),
        15: json.dumps({"id": "15", "Entities": [entity(), {"Type": "EMAIL"}]}),
        19: json.dumps({"id": "19", "Entities": [entity(EndOffset=-1)]}),
        23: "[1, 2]",
        27: json.dumps({"id": "", "File": ".jsonl"}),
    }
    reasons = {3: "not JSON", 7: "no id", 15: checked.BAD_ENTITY, 19: checked.BAD_ENTITY, 27: "no id"}
    reasons |= {11: checked.NOT_AS_DECLARED, 23: checked.NOT_AS_DECLARED}
    lines = [odd.get(i, line) for i, line in enumerate(good)]
    lines[30:30] = ["", "  "]
    lines.append(json.dumps({"File": "40.jsonl"}))
    return lines, reasons


@pytest.mark.parametrize("split", ["64m", "200b"])
def test_every_line_is_accepted_or_rejected_with_its_number(spark, tmp_path, split):
    lines, reasons = answers()
    (tmp_path / "a.out").write_text("\n".join(lines))
    (tmp_path / "b.out").write_text("nothing\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        every = checked.check_detector_output(spark, str(tmp_path))
        assert sorted(int(r.id) for r in checked.accepted(every).collect()) == [i for i in range(41) if i not in reasons]
        rows = checked.line_numbers(spark, str(tmp_path), checked.rejected(every)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {r.position: r.reason for r in rows if r.source_key.endswith("a.out")} == reasons
    assert [(r.position, r.reason, r.raw) for r in rows if r.source_key.endswith("b.out")] == [(0, "not JSON", "nothing")]


def test_documents_of_rejected_answers_stay_unscanned(spark, tmp_path):
    lines, reasons = answers()
    (tmp_path / "a.out").write_text("\n".join(lines))
    target = with_metadata(spark.range(41).select(F.col("id").alias("doc_id"), F.lit(MAIL).alias("body")))
    output = checked.accepted(checked.check_detector_output(spark, str(tmp_path)))
    done = import_results(target, output.select("id", "entities"))
    assert {r.doc_id for r in done.where("pii_flag IS NULL").collect()} == set(reasons)
