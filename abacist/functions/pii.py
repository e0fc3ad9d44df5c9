"""Personal-data patterns, redaction and anonymisation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern per personal-data type, in the order they are tried.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "address": r"\b\d+\s+[A-Za-z0-9\s,.-]+\b",
    "name": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}
# The stricter gate, case-sensitive.
GATE_PATTERNS = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{16}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{10}\b",
)

# Unicode classes and word boundaries, and "." stopping only at "\n", as the patterns assume.
UNICODE = "(?Ud)"
NEVER = "(?!)"
# The letters outside ASCII that equal an ASCII letter when case is ignored.
FOLDED = "\u0130\u0131\u017f\u212a"


def ignore_case(pattern: str) -> str:
    """The pattern with its letter ranges widened to both cases, which is exact where a case flag is not."""
    return UNICODE + re.sub(r"A-Z(\|?)a-z|A-Z|a-z", lambda m: "A-Za-z" + FOLDED + (m.group(1) or ""), pattern)


def found(text: Column, kind: str) -> Column:
    hit = text.rlike(ignore_case(PATTERNS[kind]))
    # Most texts hold no "@", and looking for one is far cheaper than trying the pattern at every word.
    return F.contains(text, F.lit("@")) & hit if kind == "email" else hit


def detected(text: Column) -> Column:
    """Types found in the original text, in pattern order; empty for null or empty text."""
    flags = [F.when(found(text, kind), F.lit(kind)) for kind in PATTERNS]
    return F.filter(F.array(*flags), lambda kind: kind.isNotNull())


def redacted(text: Column, types: Column) -> Column:
    """Every match replaced by its placeholder, each pattern working on what the one before left.

    ``types`` is the column ``detected`` made: a pattern only runs where the original text holds it.
    Null becomes "".
    """
    out = F.coalesce(text, F.lit(""))
    for kind, pattern in PATTERNS.items():
        # "out" is named once per step: naming it in both branches of a condition would double the tree each time.
        active = F.when(F.array_contains(types, kind), F.lit(ignore_case(pattern))).otherwise(F.lit(NEVER))
        out = F.regexp_replace(out, active, F.lit(f"[REDACTED_{kind.upper()}]"))
    return out


def passes_gate(text: Column) -> Column:
    """True when none of the strict patterns occurs."""
    hit = F.lit(False)
    for pattern in GATE_PATTERNS:
        hit = hit | text.rlike(UNICODE + pattern)
    return ~hit


def user_hash(user_id: Column) -> Column:
    return F.substring(F.sha2(user_id, 256), 1, 16)


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.element_at(F.split(email, "@"), -1)).when(
        email.isNotNull(), F.lit("unknown"))


def ip_region(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit("."), parts[1], F.lit(".x.x")))
