"""Scans of documents."""

import re

import pytest
from pyspark.sql import functions as F

from catalogue import frames
from cloakwork import PRESETS, Policy, Rule
from cloakwork.corpus import generate_corpus, rule_recall, sample_documents
from cloakwork.functions.text import combine_text, scanned_at_text, text_columns
from cloakwork.operators.scan import (
    contains_pii,
    detected_entities,
    explain_entities,
    policies_from,
    scan_by_policy,
    scan_documents,
    scan_multilingual,
    scan_with_entities,
)

ENTITIES = "array<struct<type:string,score:double,begin:int,end:int>>"
LABELS = "array<struct<name:string,score:double>>"


def one(spark, fields, **options):
    schema = ", ".join(f"{name} string" for name in fields)
    df = spark.createDataFrame([(1, *fields.values())], f"doc_id long, {schema}")
    return scan_documents(df, **options).first()


def test_clean_document(spark):
    row = one(spark, {"title": "Clean Memo", "body": "Q4 planning meeting moved to Thursday. No action items."})
    assert (row.pii_flag, row.pii_count, row.pii_types) == (False, 0, [])
    assert row.pii_scanned_at is not None


def test_outside_entities_redact(spark):
    body = "Contact is John Smith for details on the account."
    df = spark.createDataFrame(
        [(1, "Short title", body, [("NAME", 0.99, 12, 22)])], f"doc_id long, title string, body string, e {ENTITIES}"
    )
    row = scan_with_entities(df, {"body": "e"}).first()
    assert row.body == "Contact is J[NAME]for details on the account."
    assert (row.pii_flag, row.pii_count, row.pii_types) == (True, 1, ["NAME"])
    assert "e" not in row.asDict()


def test_outside_entities_flag(spark):
    body = "SSN 123-45-6789 is on file for this customer."
    df = spark.createDataFrame([(1, body, [("SSN", 0.99, 4, 15)])], f"doc_id long, body string, e {ENTITIES}")
    row = scan_with_entities(df, {"body": "e"}, Policy(mode="FLAG")).first()
    assert row.body == body and row.pii_types == ["SSN"]


def test_labels_decide_before_entities(spark):
    body = "Contact is John Smith for details on the account."
    rows = [
        (1, body, [("NAME", 0.99, 11, 21)], [("NAME", 0.95)]),
        (2, body, [("NAME", 0.99, 11, 21)], [("NAME", 0.3)]),
        (3, body, [], [("NAME", 0.95)]),
        (4, "John Smith", [("NAME", 0.99, 0, 10)], [("NAME", 0.95)]),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, body string, e {ENTITIES}, l {LABELS}")
    out = {r.doc_id: r for r in scan_with_entities(df, {"body": "e"}, labels="l").collect()}
    assert out[1].body == "Contact is [NAME] for details on the account."
    assert out[2].body == body and not out[2].pii_flag
    assert (out[3].pii_flag, out[3].pii_count, out[3].pii_types) == (False, 0, [])
    assert not out[4].pii_flag  # too short to be text


def test_only_strings_longer_than_the_minimum_are_text(spark):
    ssn = "123-45-6789"
    twenty, twenty_one = ssn.ljust(20, "."), ssn.ljust(21, ".")
    row = one(spark, {"a": twenty, "b": twenty_one, "c": "hi"})
    assert (row.a, row.b, row.c) == (twenty, "[SSN]" + "." * 10, "hi")
    row = one(spark, {"ssn": ssn}, policy=Policy(min_chars=0))
    assert row.ssn == "[SSN]"


def test_key_metadata_and_other_types_are_not_text(spark):
    df = spark.createDataFrame(
        [("an id that is longer than twenty 123-45-6789", 5, "2025-05-15T01:30:00Z")],
        "doc_id string, n int, pii_scanned_at string",
    )
    assert text_columns(df, "doc_id") == []
    row = scan_documents(df).first()
    assert row.doc_id.endswith("6789") and row.n == 5 and row.pii_flag is False


def test_combined_text_keeps_field_order(spark):
    df = spark.createDataFrame([("z" * 21, "short", None, "a" * 21)], "z string, s string, n string, a string")
    assert df.select(combine_text(df.columns)).first()[0] == "z" * 21 + " " + "a" * 21
    assert df.select(combine_text(["s", "n"])).first()[0] == ""


def test_other_modes_leave_text(spark):
    body = "SSN 123-45-6789 is on file for this customer."
    for mode in ("FLAG", "redact", ""):
        row = one(spark, {"body": body}, policy=Policy(mode=mode))
        assert row.body == body and row.pii_types == ["SSN"]


def test_counts_over_fields_with_repeats_and_sorted_types(spark):
    row = one(
        spark,
        {
            "title": "SSN 123-45-6789 and SSN 987-65-4321",
            "body": "Write to a@b.org, SSN 123-45-6789, or call 206-555-0147.",
        },
    )
    assert row.pii_count == 5 and row.pii_types == ["EMAIL", "PHONE", "SSN"]
    assert row.title == "SSN [SSN] and SSN [SSN]"


def test_whole_texts_are_scanned_unless_limited(spark):
    text = "x " * 50_000 + "SSN 123-45-6789"
    assert one(spark, {"body": text}).body == "x " * 50_000 + "SSN [SSN]"
    limited = one(spark, {"body": text}, policy=Policy(max_chars=99_000))
    assert limited.body == text and limited.pii_flag is False
    head = "SSN 123-45-6789 " + text
    kept = one(spark, {"body": head}, policy=Policy(max_chars=99_000))
    assert kept.body == "SSN [SSN] " + text and kept.pii_count == 1
    dropped = one(spark, {"body": head}, policy=Policy(max_chars=99_000, drop_tail=True))
    assert dropped.body == ("SSN [SSN] " + text)[: 99_000 - 6] and dropped.pii_count == 1


def test_scan_time_format(spark):
    df = spark.createDataFrame([(1, "Some text that is long enough to be checked.")], "doc_id long, body string")
    stamp = scan_documents(df).select(scanned_at_text(F.col("pii_scanned_at"))).first()[0]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", stamp) and len(stamp) == 20
    fixed = scan_documents(df, scanned_at="2025-05-15 01:30:00")
    assert fixed.select(scanned_at_text(F.col("pii_scanned_at"))).first()[0] == "2025-05-15T01:30:00Z"


def test_rescan_replaces_metadata(spark):
    df = spark.createDataFrame([(1, "Write to a@b.org, please, today.")], "doc_id long, body string")
    twice = scan_documents(scan_documents(df))
    assert twice.columns == ["doc_id", "body", "pii_flag", "pii_count", "pii_types", "pii_scanned_at"]
    assert twice.first().pii_flag is False


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "Write to a@b.org, please, today.")], "doc_id long, `a.b c` string")
    assert scan_documents(df).first()["a.b c"] == "Write to [EMAIL], please, today."
    assert detected_entities(df).first().field == "a.b c"


def test_sample_documents_hold_the_documented_types(spark):
    expected = {
        "Account Opening Request": {"SSN", "ADDRESS", "PHONE", "NAME", "EMAIL"},
        "Wire Transfer Memo": {"ADDRESS", "DATE_TIME", "NAME", "BANK_ACCOUNT_NUMBER"},
        "Clean Internal Memo": set(),
        "Customer Complaint": {"PHONE", "DATE_TIME", "CREDIT_DEBIT_NUMBER", "NAME"},
        "Compliance Report": set(),
    }
    got = {r.title: set(r.pii_types) for r in scan_documents(sample_documents(spark)).collect()}
    assert got == expected


@pytest.mark.parametrize(
    "fields, expected",
    [
        (
            {"applicant_name": "Sarah Johnson", "ssn": "987-65-4321", "phone": "(503) 555-0198", "employer": "Acme Corp",
             "address": "456 Oak Avenue, Portland OR 97201", "annual_income": "$125,000"},
            {"applicant_name": "[NAME]", "ssn": "[SSN]", "phone": "[PHONE]", "employer": "Acme Corp",
             "address": "[ADDRESS]", "annual_income": "$125,000"},
        ),
    ],
)
def test_loan_example_with_short_fields(spark, fields, expected):
    row = one(spark, fields, policy=PRESETS["loans"].with_options(min_chars=0)).asDict()
    assert {k: row[k] for k in expected} == expected
    assert row["pii_types"] == ["ADDRESS", "NAME", "PHONE", "SSN"] and row["pii_count"] == 4


def test_clinical_example_flags(spark):
    note = "Patient Robert Martinez (DOB 3/15/1958) presents with chest pain. Contact wife Maria at (206) 555-0134. Follow-up scheduled January 20, 2025."
    row = one(spark, {"note": note}, policy=PRESETS["clinical"])
    # A trained detector counts five: the rules do not take a given name alone for a name.
    assert row.note == note and row.pii_count == 4
    assert row.pii_types == ["DATE_TIME", "NAME", "PHONE"]


def test_resume_example(spark):
    text = "Jane Smith | jane.smith@email.com | (555) 123-4567\nEngineer, 2016\nAddress: 789 Pine St, San Francisco CA 94102"
    row = one(spark, {"text": text}, policy=PRESETS["resumes"])
    assert row.text == "[NAME] | [EMAIL] | [PHONE]\nEngineer, 2016\nAddress: [ADDRESS]"


def test_direct_payload_example(spark):
    row = one(spark, {"title": "Test", "body": "Contact John Smith at john@example.com, SSN 123-45-6789"})
    assert row.pii_count == 3 and set(row.pii_types) == {"NAME", "EMAIL", "SSN"}


def test_dates_can_be_left_out(spark):
    body = "Signed by Jane Doe on January 5, 2024, at home."
    row = one(spark, {"body": body}, policy=PRESETS["contracts"])
    assert row.body == "Signed by [NAME] on January 5, 2024, at home."


def test_first_tier_never_misses_what_the_second_finds(spark):
    made = generate_corpus(spark, 400, 300, seed=3)
    rows = scan_documents(made.drop("truth"), Policy(mode="FLAG")).select(
        contains_pii(combine_text(["title", "body"]), Policy()).alias("tier1"), "pii_flag"
    )
    assert rows.where("pii_flag and not tier1").count() == 0


def test_first_tier_hit_across_fields_is_clean(spark):
    df = spark.createDataFrame([(1, "the number to call is (206)", "555-0134 after nine o'clock")], "doc_id long, a string, b string")
    assert df.select(contains_pii(combine_text(["a", "b"]), Policy())).first()[0] is True
    row = scan_documents(df).first()
    assert (row.pii_flag, row.pii_count, row.pii_types) == (False, 0, [])


def test_recall_on_generated_documents(spark):
    rows = rule_recall(generate_corpus(spark, 1000, 700, seed=5)).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r.recall, r.precision) == (1.0, 1.0), r


def test_generated_corpus_is_seeded_and_split(spark):
    a, b = (generate_corpus(spark, 200, 140, seed=s) for s in (1, 2))
    assert a.where("size(truth) > 0").count() == 140
    assert a.where("size(truth) > 0 and doc_id >= 140").count() == 0
    first = [r.body for r in a.orderBy("doc_id").collect()]
    assert first == [r.body for r in generate_corpus(spark, 200, 140, seed=1).orderBy("doc_id").collect()]
    assert first != [r.body for r in b.orderBy("doc_id").collect()]
    assert len({x.split()[0] for x in first}) > 10


def test_explain_shows_low_scores_and_unasked_types(spark):
    df = spark.createDataFrame([(1, "number 12345678 at 10.0.0.1, card 4111111111111112")], "doc_id long, body string")
    rows = {(r.type, r.score, r.begin, r.end) for r in explain_entities(df).collect()}
    assert rows == {
        ("BANK_ACCOUNT_NUMBER", 0.4, 7, 15),
        ("IP_ADDRESS", 0.95, 19, 27),
        ("CREDIT_DEBIT_NUMBER", 0.75, 34, 50),
    }
    assert {r.type for r in detected_entities(df).collect()} == {"CREDIT_DEBIT_NUMBER"}


def test_custom_rules(spark):
    record = Rule("RECORD_NUMBER", "[0-9]{6}", 0.9, cue="MRN ", starts="M")
    row = one(spark, {"body": "Patient MRN 123456 was seen by the doctor."}, policy=Policy(custom_rules=[record]))
    assert row.body == "Patient MRN [RECORD_NUMBER] was seen by the doctor." and row.pii_types == ["RECORD_NUMBER"]


def test_policies_by_column(spark):
    text = "Write to a@b.org or call 206-555-0147 today."
    df = spark.createDataFrame([(1, "x", text), (2, "y", text), (3, None, text)], "doc_id long, desk string, body string")
    out = scan_by_policy(df, "desk", {"x": Policy(types=["EMAIL"]), "y": Policy(mode="FLAG")}, Policy(types=["PHONE"]))
    got = {r.doc_id: (r.body, r.pii_types) for r in out.collect()}
    assert got == {
        1: ("Write to [EMAIL] or call 206-555-0147 today.", ["EMAIL"]),
        2: (text, ["EMAIL", "PHONE"]),
        3: ("Write to a@b.org or call [PHONE] today.", ["PHONE"]),
    }


def test_policies_kept_as_a_table(spark):
    rows = spark.createDataFrame(
        [("x", ["EMAIL"], None), ("y", None, "FLAG")], "desk string, types array<string>, mode string"
    )
    assert policies_from(rows, "desk") == {"x": Policy(types=["EMAIL"]), "y": Policy(mode="FLAG")}
    with pytest.raises(ValueError, match="more than"):
        policies_from(spark.range(2000).selectExpr("id as desk"), "desk")


@pytest.mark.parametrize(
    "language, text, expected",
    [
        ("es", "El señor y la señora que viven en la casa nacieron el 5 de enero de 1980 y su cuenta 12345678 es de ellos.",
         "nacieron el [DATE_TIME] y su cuenta [BANK_ACCOUNT_NUMBER] es"),
        ("fr", "Les enfants et les parents sont dans la maison, née le 5 février 1980 avec le compte 12345678 pour une banque.",
         "née le [DATE_TIME] avec le compte [BANK_ACCOUNT_NUMBER] pour"),
        ("de", "Der Mann und die Frau sind nicht in dem Haus, geboren am 5. März 1980 mit dem Konto 12345678 bei der Bank.",
         "geboren am [DATE_TIME] mit dem Konto [BANK_ACCOUNT_NUMBER] bei"),
        ("en", "The man and the woman are not in the house, born on March 5, 1980 with the account 12345678 at the bank.",
         "born on [DATE_TIME] with the account [BANK_ACCOUNT_NUMBER] at"),
        ("it", "Il signore e la signora sono nella casa del nonno, nato il 5 marzo 1980 con il conto 12345678 di una banca.",
         "nato il [DATE_TIME] con il conto [BANK_ACCOUNT_NUMBER] di"),
        ("pt", "O homem e a mulher não estão na casa dos avós, nascido em 5 de março de 1980 com a conta 12345678 do banco.",
         "nascido em [DATE_TIME] com a conta [BANK_ACCOUNT_NUMBER] do"),
    ],
)
def test_language_chooses_the_rules(spark, language, text, expected):
    df = spark.createDataFrame([(1, text)], "doc_id long, body string")
    row = scan_multilingual(df).first()
    assert row.pii_language == language
    assert expected in row.body


def test_documents_without_text_are_english_and_clean(spark):
    df = spark.createDataFrame([(1, "kurz"), (2, None)], "doc_id long, body string")
    assert {(r.pii_language, r.pii_flag) for r in scan_multilingual(df).collect()} == {("en", False)}


def test_policy_checks_its_values():
    for wrong in ({"threshold": 2}, {"language": "xx"}, {"types": "SSN"}, {"max_chars": 0}, {"drop_tail": True}):
        with pytest.raises(ValueError):
            Policy(**wrong)


def test_threshold_and_types_choose_rules():
    assert {r.type for r in Policy(types=["SSN", "NAME"], threshold=0.92).rules()} == {"SSN"}
    assert len([r for r in Policy(threshold=0.4).rules() if r.type == "BANK_ACCOUNT_NUMBER"]) == 2


def test_score_equal_to_the_threshold_is_kept(spark):
    row = one(spark, {"body": "card number 4111111111111112 here"}, policy=Policy(threshold=0.75))
    assert row.pii_types == ["CREDIT_DEBIT_NUMBER"]


def test_tasks_that_make_documents_grow_in_number_with_the_orders(spark, tmp_path):
    orders = spark.range(200_001).withColumnRenamed("id", "o_orderkey").repartition(4)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert frames.generated(spark, str(tmp_path)).rdd.getNumPartitions() == 5
