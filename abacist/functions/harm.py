"""Harmful-content rules and keyword tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns per category, in the order they are tried.
PATTERNS = {
    "violence": (
        r"\b(kill|murder|attack|harm|hurt)\b.*\b(person|people|someone|anyone)\b",
        r"\b(weapon|gun|knife|bomb)\b.*\b(use|make|build)\b",
        r"\b(self-harm|suicide)\b",
    ),
    "hate_speech": (
        r"\b(hate|racist|sexist|homophobic|transphobic)\b",
        r"\b(nazi|supremacist|terrorist)\b",
        r"\b(slur|offensive|derogatory)\b.*\b(word|term|language)\b",
    ),
    "illegal_activities": (
        r"\b(drug|illegal|crime|fraud|scam)\b.*\b(make|sell|buy|trade)\b",
        r"\b(hack|exploit|breach|phishing)\b.*\b(system|account|password)\b",
        r"\b(forge|fake|falsify)\b.*\b(document|id|identity)\b",
    ),
    "explicit_content": (
        r"\b(porn|sex|naked|nude|erotic)\b",
        r"\b(explicit|graphic|disturbing)\b.*\b(content|material)\b",
    ),
}
# Severity per category.
SEVERITY = {"violence": 0.9, "hate_speech": 0.8, "illegal_activities": 0.7, "explicit_content": 0.5}
# Advice per category, given in this order.
ADVICE = {
    "violence": ("Block content and alert moderators", "Consider temporary user suspension",
                 "Review user interaction history"),
    "hate_speech": ("Implement content filtering", "Flag user for review", "Log incident for pattern analysis"),
    "illegal_activities": ("Block content immediately", "Report to appropriate authorities if necessary",
                           "Permanent user ban consideration"),
    "explicit_content": ("Age-appropriate content filtering", "Content warnings for sensitive topics"),
}
UNSAFE_FROM = 0.7
MINOR_SURCHARGE = 0.5
# Words that block a chat message, wherever they occur.
BLOCKED_WORDS = ("spam", "abuse", "hate", "violence")
# Tag and the substrings that set it.
INTENTS = {
    "math": ("equation", "formula", "math", "calculate"),
    "flow": ("explain", "how", "process", "flow"),
    "data": ("data", "statistics", "chart", "graph"),
}


def violations(text: Column) -> Column:
    """Array of (category, pattern, severity), one per matching pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.rlike("(?iuUd)" + pattern),
                   F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"),
                            F.lit(SEVERITY[category]).alias("severity")))
            for category, patterns in PATTERNS.items() for pattern in patterns]
    return F.filter(F.array(*hits), lambda hit: hit.isNotNull())


def score(found: Column, age: Column | None = None) -> Column:
    """Highest severity, plus a surcharge for explicit content shown to a minor."""
    base = F.coalesce(F.array_max(found.getField("severity")), F.lit(0.0))
    if age is None:
        return base
    explicit = F.array_contains(found.getField("category"), "explicit_content")
    return base + F.when((F.coalesce(age, F.lit(18)) < 18) & explicit, F.lit(MINOR_SURCHARGE)).otherwise(F.lit(0.0))


def advice(found: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains(found.getField("category"), c), F.array(*(F.lit(a) for a in lines))).otherwise(none)
             for c, lines in ADVICE.items()]
    return F.concat(*parts)


def has_blocked_word(text: Column) -> Column:
    return _contains_any(F.lower(F.coalesce(text, F.lit(""))), BLOCKED_WORDS)


def intents(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = [F.when(_contains_any(low, words), F.lit(tag)) for tag, words in INTENTS.items()]
    return F.filter(F.array(*tags), lambda tag: tag.isNotNull())


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit
