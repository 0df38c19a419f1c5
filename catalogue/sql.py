"""What each registered query must return, as SQL for another engine.

Written from the rules' definitions with plain ``\\b`` word edges and one pattern
per type, not from the package's pattern builder: agreement of the two is the
check.  Generated documents are built again here from the same word lists.
"""

from __future__ import annotations

from cloakwork.corpus import (
    CITIES,
    CLEAN_TEMPLATES,
    DOMAINS,
    LAST_NAMES,
    PII_TEMPLATES,
    PRIME,
    SLOT_TYPES,
    STREETS,
    template_parts,
)
from cloakwork.functions.language import STOP_WORDS
from cloakwork.rules import FIRST_NAMES, MONTHS

SECOND_OFFSET = 10_000_000

MONTH = "(?:" + "|".join(MONTHS["en"].split()) + ")"
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_DEBIT_NUMBER": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "PHONE": r"(?:\+1 )?(?:\([0-9]{3}\) |\b[0-9]{3}-)[0-9]{3}-[0-9]{4}\b",
    "ADDRESS": (
        r"\b[0-9]{1,5}(?: [A-Z][a-z]+){1,3} (?:St|Ave|Dr|Rd|Ln|Blvd|Way|Ct|Pl|Ter|Avenue|Street|Terrace|Place)\b"
        r"(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)? [A-Z]{2} [0-9]{5})?"
    ),
    "DATE_TIME": rf"\b{MONTH} [0-9]{{1,2}}, [0-9]{{4}}\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}\b",
    "BANK_ACCOUNT_NUMBER": r"\b[Aa]ccount [0-9]{8,17}\b",
    "NAME": rf"\b(?:{'|'.join(FIRST_NAMES)}) [A-Z][a-z]+\b",
}
DEFAULT = tuple(PATTERNS)
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
BARE = r"\b[0-9]{8,17}\b"
TOKEN = 'token = "[0-9a-f]{40}'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def is_long(column: str, than: int = 20) -> str:
    return f"coalesce(length({column}) > {than}, false)"


def count_of(column: str, kind: str) -> str:
    """Number of matches of one type in a text column."""
    return f"(CASE WHEN {is_long(column)} THEN len(regexp_extract_all({column}, {lit(PATTERNS[kind])})) ELSE 0 END)"


def replaced(column: str, kinds: tuple[str, ...] = DEFAULT) -> str:
    out = column
    for kind in kinds:
        if kind == "BANK_ACCOUNT_NUMBER":
            out = f"regexp_replace({out}, {lit(r'\b([Aa]ccount) [0-9]{8,17}\b')}, '\\1 [{kind}]', 'g')"
        else:
            out = f"regexp_replace({out}, {lit(PATTERNS[kind])}, '[{kind}]', 'g')"
    return f"CASE WHEN {is_long(column)} THEN {out} ELSE {column} END"


def counts(columns: tuple[str, ...], kinds: tuple[str, ...] = DEFAULT) -> dict[str, str]:
    return {k: " + ".join(count_of(c, k) for c in columns) for k in kinds}


def flags(per_kind: dict[str, str]) -> str:
    """The metadata columns from one count per type."""
    listed = ", ".join(f"CASE WHEN {n} > 0 THEN {lit(k)} END" for k, n in sorted(per_kind.items()))
    total = " + ".join(f"({n})" for n in per_kind.values())
    return (
        f"({total}) > 0 AS pii_flag, CAST({total} AS INTEGER) AS pii_count, "
        f"concat_ws(',', {listed}) AS pii_types"
    )


def scanned(
    table: str,
    columns: tuple[str, ...] = ("text",),
    keep: str = "*",
    kinds: tuple[str, ...] = DEFAULT,
) -> str:
    """A scanned table: `keep` plus metadata; counts are computed once per row."""
    per_kind = counts(columns, kinds)
    named = ", ".join(f"{n} AS n_{k}" for k, n in per_kind.items())
    return (
        f"(SELECT * EXCLUDE ({', '.join('n_' + k for k in per_kind)}), "
        f"{flags({k: 'n_' + k for k in per_kind})} "
        f"FROM (SELECT {keep}, {named} FROM {table}))"
    )


# -- generated documents ------------------------------------------------------


def draw(key: str, stream: int, n: int, seed: int = 0) -> str:
    x1 = f"(((({key}) % {PRIME}) * 48271 + {stream * 7919 + seed * 104729 + 1}) % {PRIME})"
    x2 = f"(({x1} * {x1} + 12345) % {PRIME})"
    x3 = f"(({x2} * 69621 + {stream * 16807}) % {PRIME})"
    return f"(({x3} >> 3) % {n})"


def made(keys: str, seed: int = 0) -> str:
    """Generated documents for ``SELECT ... AS doc_id``, with their slots."""
    key = "CAST(doc_id AS BIGINT)"

    def pick(stream: int, values) -> str:
        return f"list_extract([{', '.join(lit(v) for v in values)}], {draw(key, stream, len(values), seed)} + 1)"

    def number(stream: int, low: int, high: int) -> str:
        return f"CAST({draw(key, stream, high - low + 1, seed)} + {low} AS VARCHAR)"

    def digits(stream: int, width: int) -> str:
        parts, left = [], width
        while left:
            w = min(5, left)
            parts.append(f"lpad(CAST({draw(key, stream + len(parts), 10**w, seed)} AS VARCHAR), {w}, '0')")
            left -= w
        return " || ".join(parts)

    def date(stream: int) -> str:
        return f"{pick(stream, MONTHS['en'].split())} || ' ' || {number(stream + 1, 1, 30)} || ', ' || {number(stream + 2, 1931, 2024)}"

    slots = {
        "ssn": f"{digits(3, 3)} || '-' || {digits(4, 2)} || '-' || {digits(5, 4)}",
        "mail_tail": f"{number(6, 0, 999)} || '@' || {pick(7, DOMAINS)}",
        "phone": f"'(' || {number(8, 201, 989)} || ') ' || {number(9, 210, 999)} || '-' || {digits(10, 4)}",
        "addr": f"{number(11, 1, 25000)} || ' ' || {pick(12, STREETS)} || ', ' || {pick(13, CITIES)}",
        "amt": f"{number(14, 2, 97)} || ',500'",
        "acct": digits(15, 12),
        "cc": " || ' ' || ".join(digits(s, 4) for s in (40, 18, 19, 20)),
        "date": date(21),
        "dob": date(24),
        "pol": digits(27, 7),
        "routing": digits(29, 6),
        "passport": "'KT' || " + digits(31, 6),
        "q": number(33, 2, 9),
        "ver": f"{number(34, 0, 12)} || '.' || {number(35, 0, 30)}",
        "name": f"{pick(1, FIRST_NAMES)} || ' ' || {pick(2, LAST_NAMES)}",
    }
    filled = ", ".join(f'{value} AS "s_{slot}"' for slot, value in slots.items())
    base = (
        f"SELECT doc_id, {draw(key, 36, 10, seed)} < 7 AS has_pii, {draw(key, 37, len(PII_TEMPLATES), seed)} AS template, "
        f"{digits(38, 5)} AS number, {filled} FROM ({keys})"
    )

    def body(template: str) -> str:
        return " || ".join(lit(p) if kind == "text" else f'"s_{p}"' for kind, p in template_parts(template))

    def case(make_pii, make_clean) -> str:
        arms = [f"WHEN has_pii AND template = {i} THEN {make_pii(t)}" for i, t in enumerate(PII_TEMPLATES)]
        arms += [f"WHEN NOT has_pii AND template = {i} THEN {make_clean(t)}" for i, t in enumerate(CLEAN_TEMPLATES)]
        return f"CASE {' '.join(arms)} END"

    title = case(lambda t: f"{lit(t[0])} || ' #' || number", lambda t: lit(t[0]))
    text = case(lambda t: body(t[1]), lambda t: body(t[1]))
    return (
        f"(SELECT *, {title} AS title, {text} AS body FROM ("
        f"""SELECT *, replace(lower("s_name"), ' ', '.') || "s_mail_tail" AS "s_email" FROM ({base})))"""
    )


ORDERS = made("SELECT o_orderkey AS doc_id FROM orders")
SUPPLIERS = made("SELECT s_suppkey AS doc_id FROM supplier")
FILES = (
    f"(SELECT doc_id, title, body FROM {SUPPLIERS} UNION ALL "
    f"SELECT doc_id + {SECOND_OFFSET}, title, body FROM {made('SELECT s_suppkey AS doc_id FROM supplier', 1)})"
)


def truth_lists() -> str:
    """Per generated document, the expected values of every type."""
    cases = []
    for kind in DEFAULT:
        arms = []
        for i, (_, template) in enumerate(PII_TEMPLATES):
            held = [p for k, p in template_parts(template) if k == "slot" and SLOT_TYPES.get(p) == kind]
            if held:
                arms.append(f"WHEN has_pii AND template = {i} THEN [{', '.join(f'CAST(\"s_{p}\" AS VARCHAR)' for p in held)}]")
        cases.append(f"CASE {' '.join(arms)} ELSE [] END AS t_{kind}")
    return ", ".join(cases)


# -- spans --------------------------------------------------------------------


def located(table: str, key: str, column: str, pattern: str, condition: str = "true") -> str:
    """Matches with offsets: ``key, m, b, e``, code points, end-exclusive."""
    return (
        f"(SELECT {key}, s.m AS m, s.b AS b, s.b + length(s.m) AS e FROM ("
        f"SELECT {key}, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
        "{'m': ms[i], 'b': CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER)})) AS s FROM ("
        f"SELECT {key}, string_split_regex({column}, {lit(pattern)}) AS ps, "
        f"regexp_extract_all({column}, {lit(pattern)}) AS ms FROM {table} "
        f"WHERE {is_long(column)} AND {condition} AND regexp_matches({column}, {lit(pattern)}))))"
    )


def luhn(digits: str) -> str:
    d = f"CAST(substr({digits}, CAST(i AS BIGINT), 1) AS INTEGER)"
    return (
        f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN {d} "
        f"WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END)) % 10 = 0"
    )


def card_score(match: str) -> str:
    only = f"regexp_replace({match}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {luhn(only)} THEN 0.99 ELSE 0.75 END"


SCORES = {
    "EMAIL": "0.99",
    "CREDIT_DEBIT_NUMBER": card_score("m"),
    "SSN": "0.95",
    "PHONE": "0.95",
    "ADDRESS": "0.85",
    "DATE_TIME": "CASE WHEN contains(m, '/') THEN 0.9 ELSE 0.95 END",
    "BANK_ACCOUNT_NUMBER": "0.85",
    "NAME": "0.9",
}


def entity_rows(table: str, column: str, kind: str) -> str:
    start = "b + 8" if kind == "BANK_ACCOUNT_NUMBER" else "b"
    return (
        f"SELECT doc_id, {lit(kind)} AS type, CAST({SCORES[kind]} AS DOUBLE) AS score, "
        f'CAST({start} AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end" '
        f"FROM {located(table, 'doc_id', column, PATTERNS[kind])}"
    )


def all_rules_rows(table: str, column: str) -> str:
    """Joint detection with every rule, low scores included."""
    order = [*((k, PATTERNS[k]) for k in DEFAULT), ("IP_ADDRESS", IP), ("BARE", BARE)]
    pattern = "|".join(f"(?:{p})" for _, p in order)
    kind = "CASE " + " ".join(f"WHEN regexp_full_match(m, {lit(p)}) THEN {lit(k)}" for k, p in order) + " END"
    score = (
        "CASE k " + " ".join(f"WHEN {lit(k)} THEN {s}" for k, s in SCORES.items())
        + " WHEN 'IP_ADDRESS' THEN 0.95 ELSE 0.4 END"
    )
    return (
        "SELECT doc_id, CASE k WHEN 'BARE' THEN 'BANK_ACCOUNT_NUMBER' ELSE k END AS type, "
        f"CAST({score} AS DOUBLE) AS score, "
        "CAST(CASE k WHEN 'BANK_ACCOUNT_NUMBER' THEN b + 8 ELSE b END AS INTEGER) AS \"begin\", "
        f'CAST(e AS INTEGER) AS "end" FROM (SELECT *, {kind} AS k FROM {located(table, "doc_id", column, pattern)})'
    )


def as_lines(rows: str) -> str:
    return (
        "SELECT doc_id, string_agg(type || ':' || \"begin\" || ':' || \"end\", ',' ORDER BY \"begin\") AS entities "
        f"FROM ({rows}) GROUP BY doc_id"
    )


# -- statements ---------------------------------------------------------------

STAMP = "strftime(make_timestamp((1747272600 + n_chars) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
SCANNED = scanned("documents")
PARTLY = (
    "(SELECT * REPLACE (CASE WHEN lang <> 'en' THEN pii_flag END AS pii_flag, "
    f"CASE WHEN lang <> 'en' THEN pii_count END AS pii_count) FROM {SCANNED})"
)
LABEL_ENTITIES = (
    "(SELECT doc_id, 'NAME' AS type, 0.5 + 0.4 * quality AS score, 0 AS \"begin\", 10 AS \"end\" FROM labels "
    "UNION ALL SELECT doc_id, 'SSN', 0.4 + 0.5 * toxic, 20, 25 FROM labels)"
)
META = "doc_id, {extra}pii_flag, pii_count, pii_types"


def meta(*extra: str) -> str:
    return META.format(extra="".join(f"{e}, " for e in extra))


def state(is_scanned: str) -> str:
    """Metadata where documents may be unscanned, without nulls."""
    return (
        f"CASE WHEN {is_scanned} THEN CAST(pii_flag AS VARCHAR) ELSE 'unscanned' END AS pii_flag, "
        f"CASE WHEN {is_scanned} THEN pii_count ELSE -1 END AS pii_count, "
        f"CASE WHEN {is_scanned} THEN pii_types ELSE '' END AS pii_types"
    )


def words(column: str) -> str:
    return f"regexp_split_to_array(lower({column}), '[^\\p{{L}}]+')"


def language(column: str) -> str:
    """The stop-word vote, with the first listed language ahead among equals."""

    def votes(name: str) -> str:
        own = ", ".join(lit(w) for w in STOP_WORDS[name].split())
        return f"len(list_filter(w, lambda x: x IN ({own})))"

    named = ", ".join(f"{votes(name)} AS v_{name}" for name in STOP_WORDS)
    top = f"greatest({', '.join('v_' + name for name in STOP_WORDS)})"
    arms = " ".join(f"WHEN v_{name} = {top} THEN {lit(name)}" for name in STOP_WORDS)
    return (
        f"(SELECT *, CASE WHEN {top} = 0 THEN 'en' {arms} END AS language FROM ("
        f"SELECT *, {named} FROM (SELECT *, {words(column)} AS w FROM documents)))"
    )


def audited(texts: str) -> str:
    """Audit rows of the scanned `texts`, each with the length of what was not scanned."""
    return (
        "SELECT doc_id, pii_flag, pii_count, pii_types, "
        f"{STAMP} AS pii_scanned_at, CAST(tail AS BIGINT) AS tail_chars, "
        "strftime(make_timestamp((1747272600 + n_chars) * 1000000), '%Y-%m-%d') AS scan_date FROM "
        + scanned(texts)
    )


def by_policy() -> str:
    """One policy per language, checked language by language."""
    strict_card = (
        f"len(list_filter(regexp_extract_all(text, {lit(PATTERNS['CREDIT_DEBIT_NUMBER'])}), lambda m: "
        f"{card_score('m')} >= 0.8))"
    )
    parts = string_parts(PATTERNS["CREDIT_DEBIT_NUMBER"])
    strict_text = (
        f"array_to_string(list_transform(range(1, len({parts[0]}) + 1), lambda j: "
        f"{parts[0]}[j] || coalesce(CASE WHEN j > len({parts[1]}) THEN '' WHEN "
        f"{card_score(parts[1] + '[j]')} >= 0.8 THEN '[CREDIT_DEBIT_NUMBER]' ELSE {parts[1]}[j] END, '')), '')"
    )
    pick = meta("lang", "text")
    arms = []
    for lang, kinds, mode in (
        ("en", ("EMAIL", "PHONE"), "REDACT"),
        ("de", ("SSN", "CREDIT_DEBIT_NUMBER", "BANK_ACCOUNT_NUMBER"), "FLAG"),
        ("es", ("EMAIL",), "REDACT"),
    ):
        shown = replaced("text", kinds) if mode == "REDACT" else "text"
        arms.append(
            f"SELECT {pick} FROM (SELECT * REPLACE ({shown} AS text) FROM {scanned('documents', kinds=kinds)}) WHERE lang = '{lang}'"
        )
    n = f"(CASE WHEN {is_long('text')} THEN {strict_card} ELSE 0 END)"
    arms.append(
        f"SELECT doc_id, lang, CASE WHEN {is_long('text')} THEN {strict_text} ELSE text END AS text, "
        f"{n} > 0 AS pii_flag, CAST({n} AS INTEGER) AS pii_count, "
        f"CASE WHEN {n} > 0 THEN 'CREDIT_DEBIT_NUMBER' ELSE '' END AS pii_types FROM documents WHERE lang = 'fr'"
    )
    return " UNION ALL ".join(arms)


def string_parts(pattern: str) -> tuple[str, str]:
    return f"string_split_regex(text, {lit(pattern)})", f"regexp_extract_all(text, {lit(pattern)})"


def presets() -> str:
    desk = "split_part(title, ' ', 1)"
    kinds = {
        "Loan": DEFAULT,
        "Insurance": DEFAULT,
        "Lost": ("NAME", "ADDRESS", "PHONE", "EMAIL", "DATE_TIME", "SSN", "BANK_ACCOUNT_NUMBER"),
        "other": ("NAME", "ADDRESS", "PHONE", "EMAIL", "SSN"),
    }
    arms = []
    for name, types in kinds.items():
        where = f"{desk} = '{name}'" if name != "other" else f"{desk} NOT IN ('Loan', 'Insurance', 'Lost')"
        shown = "body" if name in ("Insurance", "Lost") else replaced("body", types)
        arms.append(
            f"SELECT {meta('body')} FROM (SELECT * REPLACE ({shown} AS body) FROM "
            f"{scanned(ORDERS, ('body',), 'doc_id, title, body', types)}) WHERE {where}"
        )
    # Loans accept cards from 0.8 on; their templates hold no card.
    return " UNION ALL ".join(arms)


def label_text() -> str:
    """A document's text with the two outside entities its label accepts replaced."""
    toxic = "CASE WHEN coalesce(l.toxic, 0) = 1 THEN substr(text, 1, 20) || '[SSN]' || substr(text, 26) ELSE text END"
    return f"CASE WHEN coalesce(l.quality, 0) = 1 THEN '[NAME]' || substr({toxic}, 11) ELSE {toxic} END"


def redacted_labels() -> str:
    name = label_text()
    n = "(coalesce(l.quality, 0) + coalesce(l.toxic, 0))"
    return (
        f"SELECT d.doc_id, CASE WHEN length(text) > 20 THEN {name} ELSE text END AS text, "
        f"length(text) > 20 AND {n} > 0 AS pii_flag, "
        f"CAST(CASE WHEN length(text) > 20 THEN {n} ELSE 0 END AS INTEGER) AS pii_count, "
        "CASE WHEN length(text) > 20 THEN concat_ws(',', CASE WHEN l.quality = 1 THEN 'NAME' END, "
        "CASE WHEN l.toxic = 1 THEN 'SSN' END) ELSE '' END AS pii_types "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    )


def statements() -> dict[str, str]:
    found = {
        kind: entity_rows("documents", "text", kind) for kind in ("EMAIL", "PHONE", "CREDIT_DEBIT_NUMBER")
    }
    found |= {
        kind: entity_rows(ORDERS, "body", kind)
        for kind in ("NAME", "SSN", "ADDRESS", "DATE_TIME", "BANK_ACCOUNT_NUMBER")
    }
    red = replaced("text")
    out = {f"entities_{kind.lower()}": sql for kind, sql in found.items()}
    label_meta = (
        "quality + toxic > 0 AS pii_flag, CAST(quality + toxic AS INTEGER) AS pii_count, "
        "concat_ws(',', CASE WHEN quality = 1 THEN 'NAME' END, CASE WHEN toxic = 1 THEN 'SSN' END) AS pii_types"
    )
    made_fields = ("title", "body")
    made_scan = scanned(ORDERS, made_fields, "doc_id, title, body")
    file_scan = scanned(FILES, made_fields)
    redacted_pair = f"{replaced('title')} AS title, {replaced('body')} AS body"
    long_url = f"{is_long('url')}"
    ragged_rows = (
        "(SELECT *, id // 100 AS file, row_number() OVER (PARTITION BY id // 100 ORDER BY kind, id, turn) - 1 AS position FROM ("
        "SELECT 0 AS kind, doc_id AS id, -1 AS turn, text, n_chars, md5(text) AS nested FROM documents UNION ALL "
        "SELECT 1, conv_id, turn, text, -1, '' FROM conversations))"
    )
    ragged_scan = (
        f"SELECT id, turn, {red} AS text, n_chars, nested, CAST(position AS INTEGER) AS position, pii_flag, pii_count, pii_types "
        f"FROM {scanned(ragged_rows, ('text',))}"
    )
    answer_faults = (
        "CASE WHEN doc_id % 11 = 5 THEN 'not JSON' WHEN doc_id % 13 = 6 THEN 'no id' "
        "WHEN doc_id % 17 = 3 THEN 'not of the declared shape' ELSE 'accepted' END"
    )
    out |= {
        # sources
        "scan_ragged_documents": ragged_scan,
        "process_ragged_files": f"{ragged_scan} WHERE file % 3 <> 1 AND id % 7 <> 3",
        "read_malformed_documents": (
            "SELECT CASE WHEN id % 7 = 3 THEN 'not an object' ELSE 'accepted' END AS reason, "
            f"CAST(position AS INTEGER) AS position, id FROM {ragged_rows} WHERE file % 3 <> 1 "
            f"UNION ALL SELECT 'not JSON', -1, arg_min(id, position) FROM {ragged_rows} WHERE file % 3 = 1 GROUP BY file"
        ),
        "read_malformed_answers": (
            "SELECT reason, CASE WHEN reason = 'accepted' THEN doc_id ELSE position END AS place, "
            "CAST(CASE WHEN reason = 'accepted' THEN coalesce(n, 0) ELSE -1 END AS INTEGER) AS entities FROM ("
            f"SELECT doc_id, {answer_faults} AS reason, "
            "row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS position FROM documents) d LEFT JOIN "
            f"(SELECT doc_id AS found_id, count(*) AS n FROM ({all_rules_rows('documents', 'text')}) GROUP BY doc_id) ON found_id = doc_id"
        ),
        "scan_index": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "read_json_documents": f"SELECT doc_id, title, body FROM {FILES}",
        "read_raw_documents": f"SELECT body || chr(10) AS body FROM {SUPPLIERS}",
        "read_ragged_documents": (
            f"SELECT CAST(CASE WHEN doc_id >= {SECOND_OFFSET} THEN 1 ELSE 0 END AS INTEGER) AS position, f AS field, t AS text FROM ("
            f"SELECT doc_id, 'title' AS f, title AS t FROM {FILES} UNION ALL SELECT doc_id, 'body', body FROM {FILES}) "
            "WHERE length(t) > 20"
        ),
        "read_detector_output": (
            "SELECT d.doc_id, coalesce(entities, '') AS entities FROM documents d LEFT JOIN "
            f"({as_lines(all_rules_rows('documents', 'text'))}) x ON d.doc_id = x.doc_id"
        ),
        "payload_documents": (
            "SELECT page_id, url, pii_flag, pii_count, pii_types FROM "
            f"{scanned('pages', ('url', 'html'))} WHERE NOT starts_with(url, 'https')"
        ),
        "stream_arrivals": f"SELECT doc_id, {redacted_pair}, pii_flag, pii_count, pii_types FROM {file_scan}",
        "stream_scan_documents": f"SELECT {meta(red + ' AS text')} FROM {SCANNED}",
        # sinks and keyed changes
        "append_documents": (
            "SELECT md5(text) AS text_md5, false AS new_id FROM documents "
            "UNION ALL SELECT md5(text), true FROM benchmark"
        ),
        "replace_by_id": (
            "SELECT d.doc_id, text, lang, CASE WHEN l.quality = 1 THEN 'updated' ELSE source END AS source, n_chars "
            "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
            f"UNION ALL SELECT item_id + {SECOND_OFFSET}, text, 'en', 'benchmark', length(text) FROM benchmark"
        ),
        "update_by_id": (
            "SELECT d.doc_id, text, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE source END AS source, "
            "coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
        ),
        "latest_by_id": (
            "SELECT conv_id, turn, role, text FROM conversations "
            "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
        ),
        "mark_in_progress": (
            "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'in_progress' ELSE 'none' END AS pii_scan_status "
            "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
        ),
        "mark_complete": (
            "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'complete' WHEN l.doc_id IS NOT NULL THEN 'in_progress' ELSE 'none' END "
            "AS pii_scan_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
        ),
        "export_lines": (
            "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE length(text) > 20"
        ),
        "export_lines_limited": (
            "SELECT CAST(page_id AS VARCHAR) AS id, substr(t, 1, 4900) AS text FROM (SELECT page_id, "
            f"concat_ws(' ', CASE WHEN {long_url} THEN url END, CASE WHEN {is_long('html')} THEN html END) AS t FROM pages) "
            "WHERE t <> ''"
        ),
        "dual_write": f"SELECT doc_id, text AS original, {red} AS redacted FROM documents",
        "audit_rows": audited(
            "(SELECT doc_id, n_chars, greatest(length(text) - 4900, 0) AS tail, substr(text, 1, 4900) AS text FROM documents)"
        ),
        "audit_whole_texts": audited("(SELECT doc_id, n_chars, 0 AS tail, text FROM documents)"),
        "write_routes": f"SELECT doc_id, {route()} AS route FROM {SCANNED}",
        # text and filters
        "text_fields": (
            f"SELECT page_id, concat_ws(',', CASE WHEN {long_url} THEN 'url' END, "
            f"CASE WHEN {is_long('html')} THEN 'html' END) AS fields FROM pages"
        ),
        "combine_text_pages": (
            f"SELECT page_id, concat_ws(' ', CASE WHEN {long_url} THEN url END, "
            f"CASE WHEN {is_long('html')} THEN html END) AS combined FROM pages"
        ),
        "combine_text_documents": (
            "SELECT doc_id, concat_ws(' ', "
            + ", ".join(f"CASE WHEN {is_long(c)} THEN {c} END" for c in ("text", "lang", "source"))
            + ") AS combined FROM documents"
        ),
        "no_text_fields": (
            "SELECT p_partkey, p_name, false AS pii_flag, CAST(0 AS INTEGER) AS pii_count, '' AS pii_types FROM part"
        ),
        "truncate_text_limits": (
            "SELECT doc_id, length(substr(text, 1, 4900)) AS export_chars, greatest(length(text) - 4900, 0) AS export_tail, "
            "greatest(length(text) - 99000, 0) AS scan_tail, md5(substr(text, 1, 300)) AS head_md5 FROM documents"
        ),
        "clean_utf8_documents": "SELECT doc_id, text FROM documents",
        "unscanned": f"SELECT doc_id FROM {PARTLY} WHERE pii_flag IS NULL",
        "scanned": f"SELECT doc_id, pii_flag FROM {PARTLY} WHERE pii_flag IS NOT NULL",
        "flagged": f"SELECT doc_id FROM {PARTLY} WHERE pii_flag",
        "with_any_type": (
            f"SELECT doc_id, pii_types FROM {SCANNED} "
            "WHERE list_has_any(string_split(pii_types, ','), ['EMAIL', 'PHONE'])"
        ),
        "shared_types": (
            "SELECT doc_id, array_to_string(list_filter(string_split(pii_types, ','), "
            f"lambda x: x IN ('CREDIT_DEBIT_NUMBER', 'EMAIL', 'SSN')), ',') AS shared FROM {SCANNED}"
        ),
        "high_risk": f"SELECT doc_id, pii_count FROM {made_scan} WHERE pii_count >= 4",
        "high_risk_types": f"SELECT doc_id, pii_types FROM {SCANNED} WHERE contains(pii_types, ',')",
        "route_by_sensitivity": f"SELECT doc_id, {route()} AS route FROM {SCANNED}",
        "preview": (
            f"SELECT page_id, concat_ws('|', CASE WHEN {long_url} THEN 'url: ' || substr(url, 1, 120) || '...' END, "
            f"CASE WHEN {is_long('html')} THEN 'html: ' || substr(html, 1, 120) || '...' END) AS preview FROM pages"
        ),
        "cap_documents_ties": (
            "SELECT l_quantity, count(*) AS lines FROM (SELECT CASE WHEN l_quantity > 1 THEN l_quantity END AS l_quantity "
            "FROM lineitem ORDER BY 1 NULLS FIRST LIMIT 5000) GROUP BY 1"
        ),
        "cap_documents": "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100",
        # detection and redaction
        "contains_pii": f"SELECT doc_id, {any_match('text')} AS has_pii FROM documents",
        "contains_pii_conversations": f"SELECT conv_id, turn, {any_match('text')} AS has_pii FROM conversations",
        "detected_entities": " UNION ALL ".join(
            f"SELECT doc_id, '{field}' AS field, type, score, \"begin\", \"end\" FROM ({entity_rows(ORDERS, field, kind)})"
            for field in made_fields
            for kind in DEFAULT
        ),
        "explain_entities": (
            "SELECT doc_id, 'text' AS field, type, score, \"begin\", \"end\" FROM "
            f"({all_rules_rows('documents', 'text')})"
        ),
        "name_entities": entity_rows(ORDERS, "body", "NAME"),
        "filter_entities": (
            "SELECT doc_id, CASE WHEN toxic = 1 THEN 'SSN:20:25' ELSE '' END AS kept, "
            "quality = 1 OR toxic = 1 AS qualifies FROM labels"
        ),
        "redact_email": (
            f"SELECT {meta(replaced('text', ('EMAIL',)) + ' AS text')} FROM {scanned('documents', kinds=('EMAIL',))}"
        ),
        "flag_email": f"SELECT {meta('text')} FROM {scanned('documents', kinds=('EMAIL',))}",
        "scan_documents": (
            f"SELECT {meta(red + ' AS text', 'lang')}, '2025-05-15T01:30:00Z' AS pii_scanned_at FROM {SCANNED}"
        ),
        "scan_generated": f"SELECT doc_id, {redacted_pair}, pii_flag, pii_count, pii_types FROM {made_scan}",
        "scan_pages": (
            f"SELECT page_id, {replaced('url')} AS url, {replaced('html')} AS html, pii_flag, pii_count, pii_types "
            f"FROM {scanned('pages', ('url', 'html'))}"
        ),
        "scan_conversations": (
            f"SELECT conv_id, turn, role, {red} AS text, pii_flag, pii_count, pii_types FROM {scanned('conversations')}"
        ),
        "scan_limited": (
            f"SELECT {meta(red + ' AS text')} FROM "
            + scanned("(SELECT doc_id, substr(text, 1, 4900) AS text FROM documents)")
        ),
        "custom_rule_token": custom_token(),
        "custom_rule_ip": (
            f"SELECT doc_id, CASE WHEN {is_long('text')} THEN regexp_replace(text, {lit(IP)}, '[IP_ADDRESS]', 'g') ELSE text END AS text, "
            "n > 0 AS pii_flag, CAST(n AS INTEGER) AS pii_count, CASE WHEN n > 0 THEN 'IP_ADDRESS' ELSE '' END AS pii_types FROM ("
            f"SELECT *, CASE WHEN {is_long('text')} THEN len(regexp_extract_all(text, {lit(IP)})) ELSE 0 END AS n FROM documents)"
        ),
        "scan_by_policy": by_policy(),
        "preset_policies": presets(),
        "entities_from": redacted_labels(),
        "metadata_from_entities": f"SELECT doc_id, {label_meta} FROM labels",
        "detect_language_documents": f"SELECT doc_id, language FROM {language('text')}",
        "language_accuracy": (
            f"SELECT lang, language, count(*) AS docs FROM {language('text')} GROUP BY lang, language"
        ),
        "multilingual_scan": (
            f"SELECT s.doc_id, CASE WHEN {is_long('s.text')} THEN l.language ELSE 'en' END AS pii_language, "
            f"{replaced('s.text')} AS text, pii_flag, pii_count, pii_types "
            f"FROM {SCANNED} s JOIN (SELECT doc_id, language FROM {language('text')}) l ON s.doc_id = l.doc_id"
        ),
        # reports
        "count_all": "SELECT count(*) AS total FROM documents",
        "coverage": (
            "SELECT count(*) AS total, count(pii_flag) AS scanned, count(*) FILTER (WHERE pii_flag) AS flagged "
            f"FROM {PARTLY}"
        ),
        "type_breakdown": breakdown(SCANNED),
        "type_breakdown_generated": breakdown(made_scan),
        "status_breakdown": (
            f"SELECT pii_flag, count(*) AS docs FROM {PARTLY} WHERE pii_flag IS NOT NULL GROUP BY pii_flag"
        ),
        "run_summary": (
            f"SELECT count(*) AS scanned, count(*) FILTER (WHERE pii_flag) AS flagged FROM {SCANNED}"
        ),
        "scanned_per_day": (
            "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS docs FROM events GROUP BY 1"
        ),
        "scanned_per_day_filled": (
            "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) "
            "SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS docs FROM "
            "(SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day) g "
            "LEFT JOIN d ON g.day = d.day"
        ),
        "scan_rate": (
            "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS docs, "
            "round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS flagged_share FROM events GROUP BY 1"
        ),
        "scan_units": (
            "SELECT tier1_units, tier2_units, tier2_if_all_units, "
            "round(tier1_units * CAST(0.000025 AS DOUBLE) + tier2_units * CAST(0.0001 AS DOUBLE), 6) AS cost, "
            "round(tier2_if_all_units * CAST(0.0001 AS DOUBLE), 6) AS cost_without_tier1, "
            "round(1 - (tier1_units * CAST(0.000025 AS DOUBLE) + tier2_units * CAST(0.0001 AS DOUBLE)) / (tier2_if_all_units * CAST(0.0001 AS DOUBLE)), 6) AS saved_share FROM ("
            "SELECT CAST(sum(u) AS BIGINT) AS tier1_units, CAST(sum(CASE WHEN hit THEN u ELSE 0 END) AS BIGINT) AS tier2_units, "
            "CAST(sum(u) AS BIGINT) AS tier2_if_all_units FROM (SELECT CAST(ceil(length(text) / 100.0) AS BIGINT) AS u, "
            f"{any_match('text')} AS hit FROM documents WHERE length(text) > 20))"
        ),
        "view_flagged": (
            f"SELECT doc_id, pii_types, pii_count, {STAMP} AS pii_scanned_at, "
            f"'text: ' || substr(text, 1, 120) || '...' AS preview FROM {SCANNED} WHERE pii_flag "
            "ORDER BY n_chars DESC, doc_id LIMIT 10"
        ),
        "top_risk": (
            f"SELECT doc_id, pii_count, pii_types FROM {made_scan} WHERE pii_count >= 3 "
            "ORDER BY pii_count DESC, doc_id LIMIT 20"
        ),
        # whole jobs: English documents come redacted, the others were only flagged
        "scan_unscanned": (
            f"SELECT {meta('CASE WHEN lang = ' + lit('en') + ' THEN ' + red + ' ELSE text END AS text')} FROM {SCANNED}"
        ),
        "scan_unscanned_summary": (
            f"SELECT count(*) AS scanned, count(*) FILTER (WHERE pii_flag) AS flagged FROM {SCANNED} WHERE lang = 'en'"
        ),
        "scheduled_scan": (
            f"SELECT doc_id, CASE WHEN due THEN {red} ELSE text END AS text, "
            f"{state("lang <> 'en' OR due")} FROM ("
            "SELECT *, lang = 'en' AND row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 250 AS due "
            f"FROM {SCANNED})"
        ),
        "scan_unscanned_partitions": (
            f"SELECT {meta('lang', 'CASE WHEN lang = ' + lit('en') + ' THEN ' + red + ' ELSE text END AS text')} FROM {SCANNED}"
        ),
        "process_file": f"SELECT doc_id, {redacted_pair}, pii_flag, pii_count, pii_types FROM {file_scan}",
        "run_batch": (
            f"SELECT doc_id, text, {state(is_long('text'))}, "
            f"CASE WHEN {is_long('text')} THEN 'complete' ELSE 'none' END AS pii_scan_status FROM {SCANNED}"
        ),
        "import_results": (
            f"SELECT d.doc_id, {state('l.doc_id IS NOT NULL')}, "
            "CASE WHEN l.doc_id IS NOT NULL THEN 'complete' ELSE 'none' END AS pii_scan_status "
            f"FROM documents d LEFT JOIN (SELECT doc_id, {label_meta} FROM labels) l ON d.doc_id = l.doc_id"
        ),
        "import_results_many_lines": (
            f"SELECT d.doc_id, {state('l.doc_id IS NOT NULL')}, "
            "CASE WHEN l.doc_id IS NOT NULL THEN 'complete' ELSE 'none' END AS pii_scan_status "
            f"FROM documents d LEFT JOIN (SELECT doc_id, {label_meta} FROM labels) l ON d.doc_id = l.doc_id"
        ),
        "import_results_redacted": (
            f"SELECT d.doc_id, {label_text()} AS text, {state('l.doc_id IS NOT NULL')}, "
            "CASE WHEN l.doc_id IS NOT NULL THEN 'complete' ELSE 'none' END AS pii_scan_status "
            f"FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic, {label_meta} FROM labels) l ON d.doc_id = l.doc_id"
        ),
        "coverage_report": (
            "SELECT count(*) AS total, count(pii_flag) AS scanned, count(*) FILTER (WHERE pii_flag) AS flagged, "
            f"'before' AS stage FROM {PARTLY} UNION ALL "
            "SELECT count(*), count(pii_flag), count(*) FILTER (WHERE pii_flag), "
            f"'after' FROM {SCANNED}"
        ),
        # generated documents
        "generate_documents": (
            f"SELECT g.doc_id, title, body, coalesce(entities, '') AS truth FROM {ORDERS} g LEFT JOIN ("
            + as_lines(" UNION ALL ".join(f"({entity_rows(ORDERS, 'body', kind)})" for kind in DEFAULT))
            + ") x ON g.doc_id = x.doc_id"
        ),
        "rule_recall": recall(),
    }
    return out


def any_match(column: str) -> str:
    return f"regexp_matches({column}, {lit('|'.join(f'(?:{p})' for p in PATTERNS.values()))})"


def route() -> str:
    sensitive = "['SSN', 'CREDIT_DEBIT_NUMBER', 'BANK_ACCOUNT_NUMBER']"
    return (
        f"CASE WHEN list_has_any(string_split(pii_types, ','), {sensitive}) THEN 'restricted' "
        "WHEN pii_flag THEN 'standard' ELSE 'open' END"
    )


def breakdown(rows: str) -> str:
    return (
        f"SELECT type, count(*) AS docs FROM (SELECT unnest(string_split(pii_types, ',')) AS type FROM {rows}) "
        "WHERE type <> '' GROUP BY type ORDER BY docs DESC, type LIMIT 20"
    )


def custom_token() -> str:
    emails = lit(PATTERNS["EMAIL"])
    n = {
        "ACCESS_TOKEN": f"(CASE WHEN {is_long('text')} THEN len(regexp_extract_all(text, {lit(TOKEN)})) ELSE 0 END)",
        "EMAIL": f"(CASE WHEN {is_long('text')} THEN len(regexp_extract_all(text, {emails})) ELSE 0 END)",
    }
    shown = f"regexp_replace(regexp_replace(text, {emails}, '[EMAIL]', 'g'), {lit(TOKEN)}, 'token = \"[ACCESS_TOKEN]', 'g')"
    return (
        f"SELECT doc_id, CASE WHEN {is_long('text')} THEN {shown} ELSE text END AS text, {flags(n)} FROM documents"
    )


def recall() -> str:
    arms = []
    for kind in DEFAULT:
        matches = f"regexp_extract_all(body, {lit(PATTERNS[kind])})"
        if kind == "BANK_ACCOUNT_NUMBER":
            matches = f"list_transform({matches}, lambda x: substr(x, 9))"
        arms.append(
            f"SELECT {lit(kind)} AS type, CAST(sum(len(t_{kind})) AS BIGINT) AS expected, "
            f"CAST(sum(len({matches})) AS BIGINT) AS found, "
            f"CAST(sum(len(list_filter(t_{kind}, lambda x: list_contains({matches}, x)))) AS BIGINT) AS matched FROM g"
        )
    return (
        f"WITH g AS (SELECT *, {truth_lists()} FROM {ORDERS}) "
        "SELECT *, round(matched / expected, 6) AS recall, round(matched / found, 6) AS precision FROM ("
        + " UNION ALL ".join(arms)
        + ")"
    )
