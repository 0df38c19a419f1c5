"""Secrets in whole texts: known forms, and runs of characters that look random.

Known forms: `assign` (a keyword, a sign, a value of 12 characters or more), `access`
(a key id of 18 or more) and `hex` (16 or more), each leftmost and without overlap.

Random runs: candidates are the maximal runs of one character class.  A window of
`window` characters slides over a candidate; its Shannon entropy is kept by
counts, one character in and one out at a step.  Windows over the class's threshold
that touch or overlap make one span.  A candidate that the allow-list knows (words
and identifiers, numbers and dates, UUIDs, host names and paths) is left alone; the
list does not concern the known forms.

Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans, every row is looked at by itself
so that repeated rows and ids give repeated results, an empty table gives no rows,
other columns are kept and a column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known forms and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "random_hex", "random_token")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one class, and the entropy in bits per character that a window must reach."""

    kind: str
    characters: str
    window: int
    threshold: float


CLASSES = (
    CharacterClass("random_hex", "0-9A-Fa-f", 16, 3.0),
    CharacterClass("random_token", "A-Za-z0-9+/_=-", 20, 3.9),
)

ALLOWED = (
    r"[A-Za-z]?[a-z]+|[A-Z]+",  # a word
    r"(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:[-_/+=]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[-_/+=]*",  # words and small numbers joined
    r"[0-9]+(?:[-_/+=]+[0-9]+)*",  # numbers, dates, telephone numbers
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # a UUID
)


#: Letters that stand for an ASCII one where case is ignored, beyond what lower() makes of them.
FOLDED = "ſıİ"


@dataclass(frozen=True)
class Scanner:
    classes: tuple[CharacterClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    _compiled: dict = field(default_factory=dict, compare=False, hash=False, repr=False)

    def _patterns(self) -> dict:
        if not self._compiled:
            self._compiled["assign"] = re.compile(ASSIGN)
            self._compiled["access"] = re.compile(ACCESS)
            self._compiled["hex"] = re.compile(HEX)
            self._compiled["allowed"] = [re.compile(p) for p in self.allowed]
            for c in self.classes:
                self._compiled[c.kind] = re.compile(rf"(?<![{c.characters}])[{c.characters}]{{{c.window},}}")
            self._compiled["least"] = min([LEAST["hex"], LEAST["access"], *(c.window for c in self.classes)])
        return self._compiled

    def _long_tokens(self, text: str, least: int) -> Iterator[tuple[int, str]]:
        """Runs without white space of at least `least` characters; all but `assign` lie in one."""
        at = 0
        for token in [t for t in text.split() if len(t) >= least]:
            at = text.index(token, at)
            yield at, token
            at += len(token)

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), sorted."""
        found, patterns = [], self._patterns()
        lower = text.lower()
        if any(word in lower for word in KEYWORDS) or any(letter in text for letter in FOLDED):
            for m in patterns["assign"].finditer(text):
                if len(m[2]) >= LEAST["assign"]:
                    found.append((m.start(), 0, m.end()))
        for at, token in self._long_tokens(text, patterns["least"]):
            for k, kind in enumerate(("access", "hex"), 1):
                for m in patterns[kind].finditer(token):
                    if m.end() - m.start() >= LEAST[kind]:
                        found.append((at + m.start(), k, at + m.end()))
            for k, c in enumerate(self.classes, 3):
                for m in patterns[c.kind].finditer(token):
                    if not self.is_allowed(m[0]):
                        found += [
                            (at + m.start() + start, k, at + m.start() + end)
                            for start, end in random_spans(m[0], c.window, c.threshold)
                        ]
        return sorted(found)

    def is_allowed(self, candidate: str) -> bool:
        return any(p.fullmatch(candidate) for p in self._patterns()["allowed"])


def random_spans(candidate: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined windows whose entropy is at least `threshold`.

    For a window of w characters the entropy is log2(w) - sum(c * log2(c)) / w over its
    counts c; a step changes two of them.
    """
    if len(candidate) < window:
        return []
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    most = (math.log2(window) - threshold) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, into in enumerate(candidate):
        c = counts.get(into, 0)
        total += term[c + 1] - term[c]
        counts[into] = c + 1
        if i >= window:
            out = candidate[i - window]
            c = counts[out]
            total += term[c - 1] - term[c]
            counts[out] = c - 1
        start = i + 1 - window
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [tuple(s) for s in spans]


def scan(df: DataFrame, text: str = "text", out: str = "secrets", scanner: Scanner = Scanner()) -> DataFrame:  # noqa: B008
    """The frame with an array of (kind, start, end) by start, then kind as in `KINDS`."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    own = Scanner(scanner.classes, scanner.allowed)
    kinds = ("assign", "access", "hex", *(c.kind for c in scanner.classes))

    def found(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                [{"kind": kinds[k], "start": s, "end": e} for s, k, e in own.scan(t)] if t else []
                for t in texts.to_pylist()
            ],
            kind,
        )

    return df.withColumn(out, F.arrow_udf(found, "array<struct<kind:string,start:int,end:int>>")(F.col(text)))


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """The frame with every stretch of overlapping or touching spans in `text` replaced by `mask`."""

    def redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for value, found in zip(texts.to_pylist(), spans.to_pylist()):
            if value is None or not found:
                rows.append(value)
                continue
            parts, at, upto = [], 0, -1
            for span in found:
                if span["start"] > upto:
                    parts += [value[at : span["start"]], mask]
                upto = max(upto, span["end"])
                at = upto
            rows.append("".join([*parts, value[at:]]))
        return pa.array(rows, pa.string())

    return df.withColumn(text, F.arrow_udf(redacted, "string")(F.col(text), F.col(secrets)))


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
