"""The rule table behind the detector.

A rule is data: a type, a Java regular expression for the span, a score, and
optionally a *cue* (text that has to stand right before the span and is kept
when the span is replaced) and a *check* on the matched text.

All rules a policy has switched on are joined into one alternation, so a text is
walked once however many rules there are.  The match that starts first wins;
among rules that match at the same place the one listed first wins, which is
why the table lists longer forms first (an e-mail address before the digits it
may begin with, a card before a bare digit run).

Word edges are written as look-arounds over ASCII word characters and not as
``\\b``: the meaning of ``\\b`` next to accented letters changed between Java
releases, and executors should agree whatever release they run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# Given names the NAME rule knows.
FIRST_NAMES = tuple(
    """
    Adam Alan Alice Anna Arthur Beatrice Benjamin Carmen Catherine Claire Daniel David Diana Edward Elena Emily
    Emma Eric Eva Francis Frank Grace Hannah Harold Helen Henry Irene Isabel Jack James Jane John Jose Julia Karen
    Laura Lucy Luis Margaret Maria Mark Martha Mary Michael Olivia Oscar Paul Peter Rachel Robert Rosa Ruth Samuel
    Sarah Simon Sophia Teresa Thomas Victor Walter William
    """.split()
)

# Month names by language, January first.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
}

# The word that announces an account number, by language.
ACCOUNT_CUES = {
    "en": "[Aa]ccount",
    "es": "[Cc]uenta",
    "fr": "[Cc]ompte",
    "de": "Konto",
    "it": "[Cc]onto",
    "pt": "[Cc]onta",
}

LANGUAGES = tuple(MONTHS)

EDGE_BEFORE = "(?<![0-9A-Za-z_])"
EDGE_AFTER = "(?![0-9A-Za-z_])"

# A name list longer than this goes through `operators.entities.name_entities`,
# a join, because every executor compiles the alternation it would become.
MAX_NAMES_IN_PATTERN = 20_000


@dataclass(frozen=True)
class Rule:
    """One way of recognising one entity type.

    ``score`` is given to spans that pass ``check``; ``fail_score`` to those that
    do not.  The only check is ``"luhn"``.  ``starts`` is the inside of a character
    class every match begins with, and ``needs`` a literal every match contains;
    both only save work.
    """

    type: str
    pattern: str
    score: float
    cue: str = ""
    check: str | None = None
    fail_score: float = 0.0
    starts: str = ""
    needs: str = ""

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", self.type):
            raise ValueError(f"entity type must be upper case: {self.type!r}")
        if not 0.0 <= self.score <= 1.0 or not 0.0 <= self.fail_score <= self.score:
            raise ValueError(f"scores of {self.type} must satisfy 0 <= fail_score <= score <= 1")
        if self.check not in (None, "luhn"):
            raise ValueError(f"unknown check {self.check!r}")
        # A match is classified on its own text, so a rule may not lean on the
        # text around it other than through `cue`, nor count groups.
        if re.search(r"\(\?<?=|\\[1-9]", self.pattern + self.cue):
            raise ValueError("use `cue` in place of positive look-around; back-references are not possible")

    @property
    def expression(self) -> str:
        first = f"(?=[{self.starts}])" if self.starts else ""
        return f"{first}{self.cue}(?:{self.pattern})"

    @property
    def min_score(self) -> float:
        return self.fail_score if self.check else self.score


def word(pattern: str) -> str:
    """`pattern` with a word edge on both sides."""
    return f"{EDGE_BEFORE}(?:{pattern}){EDGE_AFTER}"


def alternation(words: Iterable[str]) -> str:
    """A pattern for any of `words`, sharing first letters.

    Grouping by first letter keeps the number of branches tried at a position
    near the number of words that begin with the letter standing there.
    """
    groups: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (w[0], -len(w), w)):
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items())


def first_letters(words: Iterable[str]) -> str:
    return "".join(re.escape(c) for c in sorted({w[0] for w in words}))


def name_rule(names: Iterable[str] = FIRST_NAMES) -> Rule:
    """A known given name followed by one capitalised word."""
    names = [n for n in names if n]
    if not names:
        raise ValueError("no names given")
    if len(names) > MAX_NAMES_IN_PATTERN:
        raise ValueError(f"{len(names)} names are too many for a pattern; join them with name_entities()")
    return Rule("NAME", word(f"(?:{alternation(names)}) [A-Z][a-z]+"), 0.9, starts=first_letters(names))


def date_rules(language: str = "en") -> tuple[Rule, ...]:
    months = MONTHS[language].split()
    if language == "en":
        written, starts = f"(?:{alternation(months)}) [0-9]{{1,2}}, [0-9]{{4}}", first_letters(months)
    elif language in ("es", "pt"):
        written, starts = f"[0-9]{{1,2}} de (?:{alternation(months)}) de [0-9]{{4}}", "0-9"
    elif language == "de":
        written, starts = f"[0-9]{{1,2}}\\. (?:{alternation(months)}) [0-9]{{4}}", "0-9"
    else:
        written, starts = f"[0-9]{{1,2}} (?:{alternation(months)}) [0-9]{{4}}", "0-9"
    return (
        Rule("DATE_TIME", word(written), 0.95, starts=starts),
        Rule("DATE_TIME", word("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), 0.9, starts="0-9"),
    )


def account_rules(language: str = "en") -> tuple[Rule, ...]:
    cue, digits = ACCOUNT_CUES[language], "[0-9]{8,17}" + EDGE_AFTER
    return (
        Rule("BANK_ACCOUNT_NUMBER", digits, 0.85, cue=f"{EDGE_BEFORE}{cue} ", starts=cue[1:3] if cue[0] == "[" else cue[0]),
        Rule("BANK_ACCOUNT_NUMBER", EDGE_BEFORE + digits, 0.4, starts="0-9"),
    )


# The local part may begin only where no address character stands before it (or
# where the last match ended).  Starting later in the same run cannot succeed
# when starting at its head failed, so no match is lost and a long run without
# an @ is read once instead of once per character.
EMAIL = Rule(
    "EMAIL",
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    0.99,
    needs="@",
)
CARD = Rule(
    "CREDIT_DEBIT_NUMBER",
    word("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    0.99,
    check="luhn",
    fail_score=0.75,
    starts="0-9",
)
SSN = Rule("SSN", word("[0-9]{3}-[0-9]{2}-[0-9]{4}"), 0.95, starts="0-9")
PHONE = Rule(
    "PHONE",
    rf"(?:\+1 )?(?:\([0-9]{{3}}\) |{EDGE_BEFORE}[0-9]{{3}}-)[0-9]{{3}}-[0-9]{{4}}{EDGE_AFTER}",
    0.95,
    starts="0-9(+",
)
ADDRESS = Rule(
    "ADDRESS",
    word("[0-9]{1,5}(?: [A-Z][a-z]+){1,3} (?:Street|St|Avenue|Ave|Dr|Rd|Ln|Blvd|Way|Ct|Place|Pl|Terrace|Ter)")
    + "(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)? [A-Z]{2} [0-9]{5})?",
    0.85,
    starts="0-9",
)
# Off unless a policy asks for the type.
IP_ADDRESS = Rule("IP_ADDRESS", word(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0.95, starts="0-9")


def builtin_rules(language: str = "en", names: Iterable[str] = FIRST_NAMES) -> tuple[Rule, ...]:
    """The rule table for one language, in order of precedence."""
    if language not in MONTHS:
        raise ValueError(f"no rules for language {language!r}; known: {', '.join(LANGUAGES)}")
    cued, bare = account_rules(language)
    return (EMAIL, CARD, SSN, PHONE, ADDRESS, *date_rules(language), cued, name_rule(names), IP_ADDRESS, bare)


def joined_pattern(rules: Iterable[Rule]) -> str:
    """One alternation over `rules`; the first rule has precedence.

    When every rule says what its matches start with, one look at the next
    character turns most positions of a text away before any rule is tried.
    """
    rules = tuple(rules)
    either = "|".join(rule.expression for rule in rules)
    if rules and all(rule.starts for rule in rules):
        return f"(?=[{''.join(dict.fromkeys(rule.starts for rule in rules))}])(?:{either})"
    return either
