"""File sources, streams and the batch hand-over."""

import json

import pytest
from pyspark.sql import functions as F

from catalogue import frames
from cloakwork.functions.text import clean_utf8
from cloakwork.plans.batch import documents_to_export, import_results, run_batch
from cloakwork.plans.scans import process_file, with_metadata
from cloakwork.policy import Policy
from cloakwork.sinks.store import DocumentStore
from cloakwork.sources.detector_output import read_detector_output
from cloakwork.sources.documents import (
    payload_documents,
    ragged_text_fields,
    read_json_documents,
    read_ragged_documents,
    read_raw_documents,
    scan_index,
)
from cloakwork.streaming import (
    stream_dual_write,
    stream_new_documents,
    stream_scan,
    stream_to_index,
    stream_to_routes,
)
from cloakwork.streaming.arrivals import stream_raw_documents
from cloakwork.streaming.index import write_batch

SCHEMA = "title string, body string"


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "one.json").write_text(json.dumps({"body": "Write to a@b.org, will you?", "title": "One"}, indent=2))
    (docs / "two.json").write_text(
        json.dumps([{"title": "Two", "body": "Call 206-555-0147, please."}, {"title": "Three", "body": "Nothing to see in here."}])
    )
    (docs / "note.txt").write_text("John Smith called.\nHis SSN is 123-45-6789.")
    (docs / "LOUD.JSON").write_text("not read as JSON, a@b.org")
    return docs


def test_objects_and_arrays_give_rows_in_declared_order(spark, folder):
    df = read_json_documents(spark, str(folder), SCHEMA, glob="*.json")
    assert df.columns == ["title", "body"]
    assert {r.title for r in df.collect()} == {"One", "Two", "Three"}


def test_other_files_become_documents(spark, folder):
    rows = read_raw_documents(spark, str(folder)).collect()
    bodies = {r.source_key.rsplit("/", 1)[1]: r.body for r in rows}
    assert bodies == {
        "note.txt": "John Smith called.\nHis SSN is 123-45-6789.",
        "LOUD.JSON": "not read as JSON, a@b.org",
    }


def test_ragged_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": "a" * 21, "n": 10**30}, {"x": 5, "y": "b" * 30, "z": {"deep": "c" * 30}}]))
    (tmp_path / "b.json").write_text(json.dumps({"only": "d" * 25, "flag": True, "none": None}))
    rows = ragged_text_fields(read_ragged_documents(spark, str(tmp_path))).collect()
    got = {(r.source_key[-6:], r.position, r.field, r.text) for r in rows}
    assert got == {
        ("a.json", 0, "x", "a" * 21),
        ("a.json", 1, "y", "b" * 30),
        ("b.json", 0, "only", "d" * 25),
    }


def test_payloads(spark):
    rows = [
        json.dumps({"document": {"title": "T", "body": "B"}, "index": False}),
        json.dumps({"title": "own", "body": "self"}),
        json.dumps({"document": {"title": "T2", "body": None}, "index": True}),
    ]
    raw = spark.createDataFrame([(r,) for r in rows], "v string")
    schema = "document struct<title:string,body:string>, index boolean, title string, body string"
    df = raw.select(F.from_json("v", schema).alias("p")).select("p.*")
    got = [tuple(r) for r in payload_documents(df).collect()]
    assert got == [("T", "B", False), ("own", "self", True), ("T2", None, True)]
    plain = raw.select(F.lit("x").alias("title"))
    assert payload_documents(plain).columns == ["title", "to_index"]


def test_scan_index_by_path_and_name(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert scan_index(spark, path).count() == 3
    spark.range(4).createOrReplaceTempView("four")
    assert scan_index(spark, "four").count() == 4


def test_clean_utf8(spark):
    cases = {
        b"plain": "plain",
        b"A\xffB": "AB",
        "é漢😀".encode(): "é漢😀",
        b"cut \xe6\xbc": "cut ",
        "kept � mark".encode(): "kept � mark",
        "kept � mark".encode() + b"\xff": "kept � mark",
        "esc ﷐1 ﷐0 �".encode() + b"\xc3(": "esc ﷐1 ﷐0 �(",
        b"": "",
    }
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "raw binary")
    assert [r[0] for r in df.select(clean_utf8(F.col("raw"))).collect()] == list(cases.values())


def test_process_file(spark, folder, tmp_path):
    table = str(tmp_path / "index")
    summary = process_file(spark, f"{folder}/*.json", SCHEMA, table)
    assert tuple(summary.first()) == (3, 2)
    rows = {r.title: r for r in spark.read.parquet(table).collect()}
    assert rows["One"].body == "Write to [EMAIL], will you?" and len(rows["One"].doc_id) == 36
    assert rows["Three"].pii_flag is False
    process_file(spark, f"{folder}/*.json", SCHEMA, table)
    assert spark.read.parquet(table).count() == 6


# -- streams ------------------------------------------------------------------


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


def test_stream_reads_new_files_once(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def arrive():
        stream = stream_new_documents(spark, str(folder), SCHEMA, files_per_batch=1, source_column="source_key")
        run(stream_to_index(stream_scan(stream, key="source_key"), out, checkpoint))
        return {r.title: r.body for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    assert arrive()[1] == 3
    (folder / "new.json").write_text(json.dumps({"title": "New", "body": "Mail c@d.org some day soon."}))
    bodies, count = arrive()
    assert count == 4 and bodies["New"] == "Mail [EMAIL] some day soon."
    assert arrive()[1] == 4


def test_stream_takes_names_by_prefix_and_suffix(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream = stream_new_documents(spark, str(folder), SCHEMA, prefix="tw")
    run(stream_to_index(stream_scan(stream), out, str(tmp_path / "cp")))
    assert {r.title for r in spark.read.parquet(out).collect()} == {"Two", "Three"}


def test_stream_of_raw_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream = stream_raw_documents(spark, str(folder))
    run(stream_to_index(stream_scan(stream, key="source_key"), out, str(tmp_path / "cp")))
    bodies = {r.source_key.rsplit("/", 1)[1]: r.body for r in spark.read.parquet(out).collect()}
    assert bodies["note.txt"] == "[NAME] called.\nHis SSN is [SSN]."
    assert "LOUD.JSON" in bodies and "one.json" not in bodies


def test_stream_to_routes(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream = stream_scan(stream_new_documents(spark, str(folder), SCHEMA))
    run(stream_to_routes(stream, out, str(tmp_path / "cp"), sensitive=["EMAIL"]))
    routes = {r.title: r.route for r in spark.read.parquet(out).collect()}
    assert routes == {"One": "restricted", "Two": "standard", "Three": "open"}


def test_stream_dual_write_with_summary(spark, folder, tmp_path):
    stream = stream_new_documents(spark, str(folder), SCHEMA, files_per_batch=1)
    paths = {n: str(tmp_path / n) for n in ("restricted", "shared", "cp", "summary")}
    run(
        stream_dual_write(
            stream, paths["restricted"], paths["shared"], paths["cp"], summary=paths["summary"]
        )
    )
    assert spark.read.parquet(paths["restricted"]).where("body like '%@%'").count() == 1
    assert spark.read.parquet(paths["shared"]).where("body like '%@%'").count() == 0
    totals = spark.read.parquet(paths["summary"]).agg(F.sum("scanned"), F.sum("flagged"), F.count("*")).first()
    assert tuple(totals) == (3, 2, 2)


def test_a_batch_written_twice_is_stored_once(spark, tmp_path):
    write = write_batch(str(tmp_path / "t"))
    for _ in range(2):
        write(spark.range(5), 0)
    write(spark.range(5), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


# -- batch --------------------------------------------------------------------


def test_detector_output_by_id_and_by_file(spark, tmp_path):
    lines = [
        {"File": "7.jsonl", "Entities": [{"Type": "NAME", "Score": 0.9, "BeginOffset": 0, "EndOffset": 4}]},
        {"id": "8", "File": "batch_0000.jsonl", "Entities": []},
        {"File": "9.jsonl"},
    ]
    (tmp_path / "x.out").write_text("\n".join(json.dumps(r) for r in lines))
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "y.out").write_text(json.dumps({"id": "10"}))
    (tmp_path / "ignored.json").write_text(json.dumps({"id": "11"}))
    rows = {r.id: [tuple(e) for e in r.entities] for r in read_detector_output(spark, str(tmp_path)).collect()}
    assert rows == {"7": [("NAME", 0.9, 0, 4)], "8": [], "9": [], "10": []}


def test_import_sets_metadata_and_leaves_text(spark):
    target = with_metadata(
        spark.createDataFrame([(1, "John Smith was here"), (2, "clean"), (3, "not sent")], "doc_id long, body string")
    )
    output = spark.createDataFrame(
        [
            ("1", [("NAME", 0.9, 0, 10), ("NAME", 0.3, 0, 1), ("IP_ADDRESS", 0.9, 0, 1)]),
            ("2", []),
            ("77", []),
            ("not a number", []),
        ],
        "id string, entities array<struct<type:string,score:double,begin:int,end:int>>",
    )
    out = {r.doc_id: r for r in import_results(target, output).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].body == "John Smith was here"
    assert (out[1].pii_flag, out[1].pii_count, out[1].pii_types, out[1].pii_scan_status) == (True, 1, ["NAME"], "complete")
    assert (out[2].pii_flag, out[2].pii_types, out[2].pii_scan_status) == (False, [], "complete")
    assert (out[3].pii_flag, out[3].pii_scan_status) == (None, None)


def test_import_uses_the_policy_threshold(spark):
    target = with_metadata(spark.createDataFrame([(1, "x")], "doc_id long, body string"))
    output = spark.createDataFrame(
        [("1", [("NAME", 0.8, 0, 10)])], "id string, entities array<struct<type:string,score:double,begin:int,end:int>>"
    )
    assert import_results(target, output, Policy(threshold=0.9)).first().pii_flag is False


def test_batch_run_takes_each_document_once(spark, tmp_path):
    docs = spark.range(30).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 == 0, F.lit("short")).otherwise(F.lit("Write to a@b.org about this")).alias("body"),
    )
    store = DocumentStore.create(spark, docs.schema, buckets=2)
    store.append(docs)
    first = run_batch(store, max_docs=20)
    assert first.where("pii_scan_status = 'complete'").count() == 20
    assert documents_to_export(store.read(), None).count() == 7
    run_batch(store)
    table = store.read()
    assert table.where("pii_flag").count() == 27
    assert table.where("pii_flag is null").count() == 3  # no text, never sent
    assert run_batch(store) is None
    assert table.where("body like '%[EMAIL]%'").count() == 0


@pytest.mark.parametrize("one_file", [False, True])
def test_a_table_is_streamed_from_a_folder_and_from_one_file(spark, tmp_path, one_file):
    rows = [(i, f"Write to user{i}@mail.org about it", "en", "web", 33) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = tmp_path / "documents.parquet"
    if one_file:
        table.coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("part-*")).rename(folder)
    else:
        table.repartition(3).write.parquet(str(folder))
    # Another table beside it is not read.
    spark.range(2).write.parquet(str(tmp_path / "labels.parquet"))
    got = frames.stream_scan_documents(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.pii_types, "@" in r.text) for r in got) == [(i, "EMAIL", False) for i in range(6)]


def test_files_of_documents_are_written_by_all_tasks_and_grow_slower_than_documents(spark, tmp_path):
    suppliers = spark.range(1, 201).withColumnRenamed("id", "s_suppkey").coalesce(1)
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    folder = str(tmp_path)

    def files(path):
        return [f.name for f in (tmp_path / path).iterdir() if f.name.startswith("part-")]

    raw = files(frames.write_small_files(spark, frames.supplier_documents(spark, folder).select("body"), f"{folder}/raw", 4))
    assert len(raw) == 200 and len({name.split("-")[1] for name in raw}) == 4
    pairs = files(frames.write_pair_files(spark, folder))
    assert len(pairs) == 200 and len({name.split("-")[1] for name in pairs}) == 4
    # Keys 1 to 200 lie in three ranges of a hundred.
    assert len(files(frames.write_json_files(spark, folder))) == 3
    rows = frames.read_json_documents(spark, folder).collect()
    expected = [*range(1, 201), *range(frames.SECOND_OFFSET + 1, frames.SECOND_OFFSET + 201)]
    assert sorted(r.doc_id for r in rows) == expected
