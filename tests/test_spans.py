"""Detection and redaction of single texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.policy import Policy
from cloakwork.rules import FIRST_NAMES, MAX_NAMES_IN_PATTERN, Rule, builtin_rules, joined_pattern, name_rule

ENTITIES = "array<struct<type:string,score:double,begin:int,end:int>>"


def splice(text, entities):
    for kind, _, begin, end in sorted(entities, key=lambda e: e[2], reverse=True):
        text = text[:begin] + f"[{kind}]" + text[end:]
    return text


def redacted(spark, cases):
    df = spark.createDataFrame(cases, f"text string, entities {ENTITIES}")
    return [r[0] for r in df.select(spans.redact_spans(F.col("text"), F.col("entities"))).collect()]


@pytest.mark.parametrize(
    "text, entities, expected",
    [
        ("My name is John Smith and I live here.", [("NAME", 0.99, 11, 21)], "My name is [NAME] and I live here."),
        ("John Smith SSN 123-45-6789", [("NAME", 0.99, 0, 10), ("SSN", 0.99, 15, 26)], "[NAME] SSN [SSN]"),
        ("This is clean text.", [], "This is clean text."),
        ("JohnSmith", [("NAME", 0.99, 0, 4), ("NAME", 0.99, 4, 9)], "[NAME][NAME]"),
        ("Contact: john@example.com", [("EMAIL", 0.99, 9, 25)], "Contact: [EMAIL]"),
        ("abcdefghij", [("NAME", 0.9, 0, 6), ("SSN", 0.9, 4, 8)], "[NAME]SN]ij"),
        ("abcdefghij", [("NAME", 0.9, 8, 40)], "abcdefgh[NAME]"),
    ],
)
def test_redact_spans(spark, text, entities, expected):
    assert redacted(spark, [(text, entities)]) == [expected]


def test_redact_spans_equals_a_plain_splice_on_random_input(spark):
    rng = random.Random(7)
    alphabet = "ab é漢😀-9 "
    cases = []
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ents = []
        for _ in range(rng.randint(0, 6)):
            begin = rng.randint(0, 45)
            ents.append((rng.choice(["NAME", "SSN", "X"]), 0.9, begin, begin + rng.randint(0, 9)))
        cases.append((text, ents))
    assert redacted(spark, cases) == [splice(t, e) for t, e in cases]


def test_redact_spans_without_overlaps_over_many_blocks(spark):
    rng = random.Random(8)
    cases = []
    for size in (0, 1, 1023, 1024, 1025, 2048, 5000):
        text = "".join(rng.choice("ab é漢😀\n") for _ in range(size))
        cuts = sorted(rng.sample(range(size + 1), min(size + 1, 40) // 2 * 2))
        cases.append((text, [("NAME", 0.9, b, e) for b, e in zip(cuts[::2], cuts[1::2])]))
        cases.append((text, [("SSN", 0.9, size, size + 3)]))
        cases.append((text, [("SSN", 0.9, 0, size)]))
    assert redacted(spark, cases) == [splice(t, e) for t, e in cases]


def test_many_spans_in_one_text(spark):
    text, n = "a@b.co " * 20_000, 20_000
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select("t", spans.find_entities(F.col("t"), Policy().rules()).alias("e")).cache()
    last = found.select(F.size("e"), F.element_at("e", -1)["end"]).first()
    assert tuple(last) == (n, len(text) - 1)
    assert found.select(spans.redact_spans(F.col("t"), F.col("e"))).first()[0] == "[EMAIL] " * n


def test_filter_entities(spark):
    ents = [("NAME", 0.99, 0, 10), ("NAME", 0.3, 15, 20), ("IP_ADDRESS", 0.99, 25, 35), ("SSN", 0.7, 1, 2)]
    df = spark.createDataFrame([(ents,)], f"e {ENTITIES}")
    kept = df.select(spans.filter_entities(F.col("e"), ["NAME", "SSN"], 0.7)).first()[0]
    assert [tuple(e) for e in kept] == [ents[0], ents[3]]
    assert df.select(spans.filter_entities(F.col("e"), [], 0.0)).first()[0] == []


@pytest.mark.parametrize(
    "labels, expected",
    [
        ([("NAME", 0.95)], True),
        ([], False),
        (None, False),
        ([("NAME", 0.3)], False),
        ([("IP_ADDRESS", 0.99)], False),
    ],
)
def test_filter_labels(spark, labels, expected):
    df = spark.createDataFrame([(labels,)], "l array<struct<name:string,score:double>>")
    assert df.select(spans.filter_labels(F.col("l"), ["NAME", "SSN"], 0.7)).first()[0] is expected


# -- detector -----------------------------------------------------------------

# The rules again, with plain word edges, for Python's own engine in ASCII mode.
PLAIN = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CREDIT_DEBIT_NUMBER", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE", r"(?:\+1 )?(?:\([0-9]{3}\) |\b[0-9]{3}-)[0-9]{3}-[0-9]{4}\b"),
    (
        "ADDRESS",
        r"\b[0-9]{1,5}(?: [A-Z][a-z]+){1,3} (?:Street|St|Avenue|Ave|Dr|Rd|Ln|Blvd|Way|Ct|Place|Pl|Terrace|Ter)\b"
        r"(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)? [A-Z]{2} [0-9]{5})?",
    ),
    (
        "DATE_TIME",
        r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
        r" [0-9]{1,2}, [0-9]{4}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    ),
    ("BANK_ACCOUNT_NUMBER", r"\b[Aa]ccount (?P<span>[0-9]{8,17})\b"),
    ("NAME", rf"\b(?:{'|'.join(FIRST_NAMES)}) [A-Z][a-z]+\b"),
]


def expected_spans(text):
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PLAIN), re.ASCII)
    out = []
    for m in pattern.finditer(text):
        begin = m.start("span") if m.lastgroup == "BANK_ACCOUNT_NUMBER" or m.group("BANK_ACCOUNT_NUMBER") else m.start()
        kind = next(k for k, _ in PLAIN if m.group(k) is not None)
        out.append((kind, begin, m.end()))
    return out


def found_spans(spark, texts, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", spans.find_entities(F.col("t"), rules).alias("e")).orderBy("i").collect()
    return [[(e.type, e.begin, e.end) for e in r.e] for r in rows]


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = [
        "John Smith", "Mary", "Robert Johnson", "account 12345678", "Account 4111111111111111", "12345678",
        "4111-1111-1111-1111", "4111 1111 1111 1112", "123-45-6789", "206-555-0147", "(206) 555-0134",
        "+1 (206) 555-0134", "+1 206-555-0134", "a.b@c.de", "a@b.com.c@d.org", "x@y", "@", "742 Evergreen Terrace",
        "1600 Pennsylvania Ave, Washington DC 20500", "99 Bad Way", "January 15, 1985", "3/15/1958", "é", "漢", "😀",
        "_", "-", ".", "%", "word", "Thomas Thomas Thomas", "James", "0", "1234", "may 5, 2020", "May 5, 2020", "\n",
    ]
    return [
        "".join(rng.choice(bits) + rng.choice(["", " ", " ", ", ", "\n"]) for _ in range(rng.randint(0, 12)))
        for _ in range(n)
    ]


def test_detector_agrees_with_python_on_random_texts(spark):
    texts = random_texts(1500, 11)
    rules = Policy().rules()
    got = found_spans(spark, texts, rules)
    for text, spans_found in zip(texts, got):
        assert spans_found == expected_spans(text), text


def test_matches_redaction_and_offsets_agree(spark):
    """Redacting by pieces and splicing by offsets are two ways to one text."""
    texts = random_texts(600, 12)
    texts += [t + "\ufdd0 206-555-0147" for t in texts[:100]]
    rules = Policy().rules()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(
        "t",
        spans.redact_matches(t, spans.find_matches(t, rules), rules, 0.7).alias("by_pieces"),
        spans.redact_spans(t, spans.find_entities(t, rules)).alias("by_offsets"),
        spans.contains_match(t, rules).alias("hit"),
    ).collect()
    for r in rows:
        assert r.by_pieces == r.by_offsets, r.t
        assert r.hit == (r.by_pieces != r.t), r.t


def test_low_scoring_cards_stay_when_the_threshold_is_higher(spark):
    text = "good 4111-1111-1111-1111 and bad 4111-1111-1111-1112 cards"
    rules = Policy(threshold=0.8).rules()
    df = spark.createDataFrame([(text,)], "t string")
    found = spans.find_matches(F.col("t"), rules)
    row = df.select(
        spans.match_types(found, rules, 0.8), spans.redact_matches(F.col("t"), found, rules, 0.8)
    ).first()
    assert row[0] == ["CREDIT_DEBIT_NUMBER"]
    assert row[1] == "good [CREDIT_DEBIT_NUMBER] and bad 4111-1111-1111-1112 cards"


def test_edges_do_not_depend_on_unicode_letters(spark):
    texts = ["é123-45-6789é is a number", "漢206-555-0147", "_123-45-6789", "x123-45-6789"]
    got = found_spans(spark, texts, Policy().rules())
    assert [[k for k, _, _ in s] for s in got] == [["SSN"], ["PHONE"], [], []]


def test_long_runs_do_not_blow_up(spark):
    """A run of address characters is read once, not once per character."""
    texts = ["a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "@".join(["a"] * 50_000)]
    got = found_spans(spark, texts, Policy().rules())
    assert got == [[], [], [], []]


def test_null_and_empty_texts(spark):
    assert found_spans(spark, [None, ""], Policy().rules()) == [[], []]


@pytest.mark.parametrize("bad", [r"(?<=x)1", r"(?=x)1", r"(1)\1"])
def test_rules_reject_patterns_that_cannot_be_joined(bad):
    with pytest.raises(ValueError):
        Rule("X", bad, 0.9)


def test_rules_reject_bad_types_and_scores():
    with pytest.raises(ValueError):
        Rule("lower", "x", 0.9)
    with pytest.raises(ValueError):
        Rule("X", "x", 1.5)
    with pytest.raises(ValueError):
        Rule("X", "x", 0.5, check="crc")
    with pytest.raises(ValueError):
        builtin_rules("xx")


def test_name_lists_in_patterns_are_bounded():
    with pytest.raises(ValueError, match="join"):
        name_rule(f"N{i}" for i in range(MAX_NAMES_IN_PATTERN + 1))


def test_joined_pattern_looks_at_the_first_character_when_it_can():
    rules = [Rule("A", "1+", 0.9, starts="1"), Rule("B", "b", 0.9, starts="b")]
    assert joined_pattern(rules).startswith("(?=[1b])")
    assert not joined_pattern([*rules, Rule("C", "c", 0.9)]).startswith("(?=[1b])(")
