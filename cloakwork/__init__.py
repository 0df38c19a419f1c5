"""Find, redact and report personal data in document collections, on Spark."""

from cloakwork.policy import DEFAULT_TYPES, FLAG, PRESETS, REDACT, SENSITIVE_TYPES, Policy
from cloakwork.rules import Rule

__all__ = ["DEFAULT_TYPES", "FLAG", "PRESETS", "REDACT", "SENSITIVE_TYPES", "Policy", "Rule"]
