"""Documents with known personal data, to test rules and measure recall."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.functions.text import hold, quoted
from cloakwork.operators.scan import detect_pii
from cloakwork.policy import Policy
from cloakwork.rules import FIRST_NAMES, MONTHS

# Five documents, the first, second and fourth with personal data.
SAMPLE_DOCUMENTS = (
    (
        "Account Opening Request",
        "Please open an account for John Smith. SSN is 123-45-6789. "
        "Contact at john.smith@example.com or (555) 867-5309. "
        "Mailing address: 742 Evergreen Terrace, Springfield IL 62704.",
    ),
    (
        "Wire Transfer Memo",
        "Transfer $50,000 from account 9876543210 to Maria Garcia at "
        "1600 Pennsylvania Ave, Washington DC 20500. Authorized by James Wilson on January 15, 1985.",
    ),
    (
        "Clean Internal Memo",
        "Q4 planning meeting moved to Thursday. Please update your calendars. "
        "No action items from last week's sync.",
    ),
    (
        "Customer Complaint",
        "Robert Johnson called regarding unauthorized charges on card 4111-1111-1111-1111. "
        "Customer DOB March 12, 1982. Callback number 206-555-0147.",
    ),
    (
        "Compliance Report",
        "Quarterly AML review complete. No suspicious activity detected across "
        "monitored accounts. Next review scheduled for Q2.",
    ),
)

# What generated documents are filled with.
LAST_NAMES = tuple(
    """
    Abbott Baker Barnes Becker Carter Castillo Chapman Cole Dawson Delgado Ellis Fischer Foster Grant Hale Hayes
    Ibarra Jensen Keller Lambert Lindgren Marsh Mendez Norton Osborne Palmer Pereira Quinn Ramsey Schmidt Sutton
    Turner Underwood Vargas Weber Whitfield Yates Zimmerman
    """.split()
)
STREETS = (
    "Harbor St", "Juniper Ave", "Quarry Dr", "Orchard Rd", "Heron Ln", "Granite Blvd", "Meadow Way",
    "Foundry Ct", "Lantern Pl", "Summit Ter", "Willow Creek Avenue",
)
CITIES = (
    "Portland OR 97209", "Boise ID 83702", "Santa Fe NM 87501", "Omaha NE 68102", "Tulsa OK 74103",
    "Raleigh NC 27601", "Albany NY 12207", "Des Moines IA 50309", "Reno NV 89501",
)
DOMAINS = ("mail.example.org", "post.example.net", "example.com", "office-mail.example")

# Title and body of generated documents, as many with personal data as without.
PII_TEMPLATES = (
    ("Lease Signing", "The lease was signed on {date} by {name}, who moves to {addr} and can be called at {phone}."),
    ("Travel Booking", "Seat held for {name}; pay with card {cc}. Itinerary goes to {email}, questions to {phone}."),
    ("Payroll Note", "Please add {name} to payroll: SSN {ssn}, wages to account {acct}, bank code {routing}."),
    ("Clinic Intake", "{name}, born {dob}, was seen today. Plan number {pol}. Reach the patient at {phone}."),
    ("Parcel Inquiry", "A parcel for {name} never came to {addr}. Write back to {email}."),
    ("Refund Request", "We owe {name} ${amt}; the card was {cc}, closed on {date}, so use account {acct} instead."),
    ("Border Form", "Form for {name}: passport {passport}, born {dob}, staying at {addr}."),
    ("School Record", "Guardian {name} (SSN {ssn}) asked for mail at {email} from {date} on."),
    ("Estate File", "Heirs of {name} close account {acct} holding ${amt}. Counsel answers at {phone} and {email}."),
)
CLEAN_TEMPLATES = (
    ("Garden Notes", "The tomatoes did well in the raised beds this year; next year {q} more rows of beans are planned."),
    ("Release Notes", "Release {ver} brings faster start-up, fewer warnings and a new page of settings."),
    ("Reading Group", "We finished the novel and liked the second half better than the first, bar one chapter."),
    ("Kitchen Rota", "Whoever cooks does not wash up. The rota for the week hangs next to the fridge."),
    ("Trail Report", "The upper trail is open again after the storm, but the bridge by the mill stays closed."),
    ("Choir Practice", "Practice starts half an hour later on Wednesday because the hall is being painted."),
    ("Library Hours", "Opening hours change in spring; the reading room stays open for {q} hours longer."),
    ("Bird Count", "Counted {q} herons and a pair of grebes at the pond; the feeders need cleaning before winter."),
    ("Tool Library", "The drill is back and the ladder is out until the end of the month."),
)
SLOT_TYPES = {
    "name": "NAME",
    "ssn": "SSN",
    "email": "EMAIL",
    "phone": "PHONE",
    "addr": "ADDRESS",
    "acct": "BANK_ACCOUNT_NUMBER",
    "cc": "CREDIT_DEBIT_NUMBER",
    "date": "DATE_TIME",
    "dob": "DATE_TIME",
}

PRIME = 2_147_483_647
# Slots that one step of making documents fills.
SLOTS_PER_STEP = 3


def sample_documents(spark: SparkSession) -> DataFrame:
    """The five sample documents, numbered from 1."""
    rows = [(i, title, body) for i, (title, body) in enumerate(SAMPLE_DOCUMENTS, 1)]
    return spark.createDataFrame(rows, "doc_id long, title string, body string")


def draw(key: str, stream: int, n: int, seed: int = 0) -> str:
    """SQL for a number in [0, n) that depends on key, stream and seed only.

    Multiplications and a square modulo a prime, in plain integer arithmetic, so
    any engine can draw the same numbers.
    """
    x = f"((pmod(cast({key} as bigint), {PRIME}) * 48271 + {stream * 7919 + seed * 104729 + 1}) % {PRIME})"
    x = f"(({x} * {x} + 12345) % {PRIME})"
    x = f"(({x} * 69621 + {stream * 16807}) % {PRIME})"
    return f"(shiftright({x}, 3) % {n})"


def _pick(key: str, stream: int, values: Sequence[str], seed: int) -> Column:
    listed = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"element_at(array({listed}), cast({draw(key, stream, len(values), seed)} + 1 as int))")


def _digits(key: str, stream: int, width: int, seed: int) -> Column:
    """`width` random digits, leading zeros included."""
    parts, left = [], width
    while left:
        w = min(5, left)
        parts.append(f"lpad(cast({draw(key, stream + len(parts), 10**w, seed)} as string), {w}, '0')")
        left -= w
    return F.expr(f"concat({', '.join(parts)})")


def _between(key: str, stream: int, low: int, high: int, seed: int) -> Column:
    return F.expr(f"cast({draw(key, stream, high - low + 1, seed)} + {low} as string)")


def _slots(key: str, seed: int) -> dict[str, Column]:
    """A random value for every slot of the templates."""

    def number(stream, low, high):
        return _between(key, stream, low, high, seed)

    def date(stream):
        month = _pick(key, stream, MONTHS["en"].split(), seed)
        return F.concat(month, F.lit(" "), number(stream + 1, 1, 30), F.lit(", "), number(stream + 2, 1931, 2024))

    name = F.concat(_pick(key, 1, FIRST_NAMES, seed), F.lit(" "), _pick(key, 2, LAST_NAMES, seed))
    mail_user = F.replace(F.lower(name), F.lit(" "), F.lit("."))
    dash = F.lit("-")
    return {
        "name": name,
        "ssn": F.concat(_digits(key, 3, 3, seed), dash, _digits(key, 4, 2, seed), dash, _digits(key, 5, 4, seed)),
        "email": F.concat(mail_user, number(6, 0, 999), F.lit("@"), _pick(key, 7, DOMAINS, seed)),
        "phone": F.concat(F.lit("("), number(8, 201, 989), F.lit(") "), number(9, 210, 999), dash, _digits(key, 10, 4, seed)),
        "addr": F.concat(number(11, 1, 25000), F.lit(" "), _pick(key, 12, STREETS, seed), F.lit(", "), _pick(key, 13, CITIES, seed)),
        "amt": F.concat(number(14, 2, 97), F.lit(",500")),
        "acct": _digits(key, 15, 12, seed),
        "cc": F.concat_ws(" ", *(_digits(key, stream, 4, seed) for stream in (40, 18, 19, 20))),
        "date": date(21),
        "dob": date(24),
        "pol": _digits(key, 27, 7, seed),
        "routing": _digits(key, 29, 6, seed),
        "passport": F.concat(F.lit("KT"), _digits(key, 31, 6, seed)),
        "q": number(33, 2, 9),
        "ver": F.concat(number(34, 0, 12), F.lit("."), number(35, 0, 30)),
    }


def template_parts(template: str) -> list[tuple[str, str]]:
    """A template as ``("text", ...)`` and ``("slot", ...)`` parts."""
    parts = re.split(r"\{(\w+)\}", template)
    return [("slot" if i % 2 else "text", part) for i, part in enumerate(parts) if part]


def generate_documents(
    keys: DataFrame, key: str = "doc_id", *, pii: Column | None = None, seed: int = 0
) -> DataFrame:
    """One document per key: ``key, title, body, truth``.

    ``truth`` lists the personal data written into the body, as entities with
    score 1.  Where `pii` is true (by default for seven in ten) the document has
    some.  A projection over the keys, so any number is made in parallel.
    """
    k, name = quoted(key), f"`{key}`"
    has_pii = F.expr(f"{draw(name, 36, 10, seed)} < 7") if pii is None else pii
    # Held: a filter on a document must not bring its whole making along.
    base = hold(
        keys.select(k),
        {
            "__pii": has_pii,
            "__template": F.expr(draw(name, 37, len(PII_TEMPLATES), seed)).cast("int"),
            "__number": _digits(name, 38, 5, seed),
        },
    )

    def needed(slot: str) -> Column:
        """Whether the document's template has the slot."""
        test = F.lit(False)
        for flag, templates in ((True, PII_TEMPLATES), (False, CLEAN_TEMPLATES)):
            used = [i for i, t in enumerate(templates) if ("slot", slot) in template_parts(t[1])]
            if used:
                test = test | ((F.col("__pii") == F.lit(flag)) & F.col("__template").isin(*used))
        return test

    # A few slots at a time: Java interprets a method of more than 8,000 bytes of code
    # and never compiles it, and each of these steps becomes a method.
    slots = list(_slots(name, seed).items())
    for first in range(0, len(slots), SLOTS_PER_STEP):
        some = slots[first : first + SLOTS_PER_STEP]
        base = hold(base, {f"__{slot}": F.when(needed(slot), value) for slot, value in some})

    def column(kind: str, part: str) -> Column:
        return F.lit(part) if kind == "text" else F.col(f"__{part}")

    def body(template: str) -> Column:
        return F.concat(*(column(*p) for p in template_parts(template)))

    def truth(template: str) -> Column:
        entities, before = [], F.lit(0)
        for kind, part in template_parts(template):
            end = before + F.length(column(kind, part))
            if kind == "slot" and part in SLOT_TYPES:
                entities.append(
                    F.struct(
                        F.lit(SLOT_TYPES[part]).alias("type"),
                        F.lit(1.0).alias("score"),
                        before.alias("begin"),
                        end.alias("end"),
                    )
                )
            before = end
        return F.array(*entities).cast(f"array<{spans.ENTITY_TYPE}>")

    def choose(pii_value, clean_value) -> Column:
        out = None
        for flag, templates, make in ((True, PII_TEMPLATES, pii_value), (False, CLEAN_TEMPLATES, clean_value)):
            for i, template in enumerate(templates):
                test = (F.col("__pii") == F.lit(flag)) & (F.col("__template") == i)
                out = F.when(test, make(template)) if out is None else out.when(test, make(template))
        return out

    documents = hold(
        base,
        {
            "title": choose(lambda t: F.concat(F.lit(f"{t[0]} #"), F.col("__number")), lambda t: F.lit(t[0])),
            "body": choose(lambda t: body(t[1]), lambda t: body(t[1])),
        },
    )
    documents = hold(documents, {"truth": choose(lambda t: truth(t[1]), lambda t: spans.no_entities())})
    return documents.select(k, "title", "body", "truth")


def generate_corpus(spark: SparkSession, n: int = 1000, pii: int = 700, seed: int = 0) -> DataFrame:
    """`n` documents numbered from 0, the first `pii` with personal data."""
    return generate_documents(spark.range(n).toDF("doc_id"), pii=F.col("doc_id") < pii, seed=seed)


def rule_recall(documents: DataFrame, policy: Policy | None = None, field: str = "body") -> DataFrame:
    """Recall and precision per type, against the ``truth`` of generated documents.

    An entity counts as found when type, begin and end all agree.
    """
    bare = "array<struct<type:string,begin:int,end:int>>"

    def without_score(entities: Column) -> Column:
        return F.transform(
            entities, lambda e: F.struct(e["type"].alias("type"), e["begin"].alias("begin"), e["end"].alias("end"))
        ).cast(bare)

    both = documents.select(
        without_score(F.col("truth")).alias("truth"),
        without_score(detect_pii(quoted(field), policy or Policy())).alias("found"),
    )

    def tagged(entities: str, others: str, expected: bool) -> Column:
        return F.transform(
            F.col(entities),
            lambda e: F.struct(
                e["type"].alias("type"),
                F.lit(expected).alias("expected"),
                F.array_contains(F.col(others), e).alias("agrees"),
            ),
        )

    rows = both.select(
        F.explode_outer(F.concat(tagged("truth", "found", True), tagged("found", "truth", False))).alias("e")
    ).where(F.col("e").isNotNull())
    counts = rows.groupBy(F.col("e.type").alias("type")).agg(
        F.count_if(F.col("e.expected")).alias("expected"),
        F.count_if(~F.col("e.expected")).alias("found"),
        F.count_if(F.col("e.expected") & F.col("e.agrees")).alias("matched"),
    )
    return counts.select(
        "*",
        F.round(F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")), 6).alias("recall"),
        F.round(F.when(F.col("found") > 0, F.col("matched") / F.col("found")), 6).alias("precision"),
    )
