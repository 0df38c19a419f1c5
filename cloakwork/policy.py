"""What to look for and what to do about it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from cloakwork.rules import FIRST_NAMES, LANGUAGES, Rule, builtin_rules

# The entity types looked for by default.
DEFAULT_TYPES = (
    "NAME", "SSN", "CREDIT_DEBIT_NUMBER", "EMAIL",
    "PHONE", "ADDRESS", "DATE_TIME", "BANK_ACCOUNT_NUMBER",
)

# Types whose documents belong in restricted storage.
SENSITIVE_TYPES = ("SSN", "CREDIT_DEBIT_NUMBER", "BANK_ACCOUNT_NUMBER")

# A string is text when it is longer than this.
DEFAULT_MIN_CHARS = 20

# Input limits of a remote detector, for jobs that have to agree
# with results made under them.  Nothing here is limited unless a policy says so.
REMOTE_SCAN_CHARS = 99_000
REMOTE_EXPORT_CHARS = 4_900
REMOTE_LANGUAGE_CHARS = 300

REDACT = "REDACT"
FLAG = "FLAG"


@dataclass(frozen=True)
class Policy:
    """Types, confidence threshold and mode of one scan.

    ``mode`` other than ``"REDACT"`` leaves text as it is.  Whole texts are
    scanned; with ``max_chars`` only that many leading characters are, and what
    follows stays unredacted unless ``drop_tail`` removes it.  ``custom_rules``
    add patterns, after the built-in ones; their types count as asked for.
    """

    types: tuple[str, ...] = DEFAULT_TYPES
    threshold: float = 0.7
    mode: str = REDACT
    min_chars: int = DEFAULT_MIN_CHARS
    language: str = "en"
    max_chars: int | None = None
    drop_tail: bool = False
    custom_rules: tuple[Rule, ...] = ()
    names: tuple[str, ...] = FIRST_NAMES

    def __post_init__(self) -> None:
        # A string is a sequence too: types="SSN" would ask for S, S and N.
        for field in ("types", "custom_rules", "names"):
            value = getattr(self, field)
            if isinstance(value, str):
                raise ValueError(f"{field} must be a list, not one string")
            object.__setattr__(self, field, tuple(value))
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError(f"threshold must lie in [0, 1], got {self.threshold}")
        if self.language not in LANGUAGES:
            raise ValueError(f"unknown language {self.language!r}; known: {', '.join(LANGUAGES)}")
        if self.min_chars < 0 or (self.max_chars is not None and self.max_chars < 1):
            raise ValueError("min_chars must not be negative, max_chars must be positive")
        if self.drop_tail and self.max_chars is None:
            raise ValueError("drop_tail needs max_chars")

    @property
    def redacts(self) -> bool:
        return self.mode == REDACT

    def with_options(self, **changes) -> Policy:
        return replace(self, **changes)

    def all_rules(self) -> tuple[Rule, ...]:
        """Every rule known under this policy, whatever its type and score."""
        return builtin_rules(self.language, self.names) + self.custom_rules

    def rules(self) -> tuple[Rule, ...]:
        """The rules that can give an entity this policy accepts.

        Choosing them here rather than filtering entities afterwards keeps the
        patterns nobody asked for out of the plan.
        """
        built_in = [r for r in builtin_rules(self.language, self.names) if r.type in self.types]
        return tuple(r for r in (*built_in, *self.custom_rules) if r.score >= self.threshold)

    def accepted_types(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.types, *(r.type for r in self.custom_rules))))


# Ready-made policies by line of business.
PRESETS = {
    "default": Policy(),
    "loans": Policy(threshold=0.8),
    "clinical": Policy(
        types=("NAME", "ADDRESS", "PHONE", "EMAIL", "DATE_TIME", "SSN", "BANK_ACCOUNT_NUMBER"),
        threshold=0.7,
        mode=FLAG,
    ),
    "contracts": Policy(types=("NAME", "ADDRESS", "PHONE", "EMAIL", "SSN"), threshold=0.85),
    "claims": Policy(mode=FLAG),
    "resumes": Policy(types=("NAME", "EMAIL", "PHONE", "ADDRESS"), threshold=0.75),
    "financial_only": Policy(types=("SSN", "CREDIT_DEBIT_NUMBER", "BANK_ACCOUNT_NUMBER")),
}
