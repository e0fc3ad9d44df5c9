"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

The base kinds (email, ip, card, phone) are found as their patterns say, leftmost and without overlap within a kind; a proposal
that fails its check (parts of an address, Luhn, number of digits) is dropped. They stay whatever their score is. Further kinds are
proposed by patterns of their own and stay from a score of KEEP on: an IBAN is confirmed by its country's length and mod 97, a
card written otherwise (other separators, or digits beside it) by Luhn and its issuer's digits, a social security number by its
parts, a national phone number by its digits, a secret by how mixed its characters are. Each kind begins with a score; a word
of its CONTEXT nearby raises it, one of DOUBT lowers it. A further span that overlaps one found before it is dropped.

Every scan is linear in the text: runs are looked at once, from their beginnings, with possessive repetition.

Defined results: a null or empty text has no spans. Repeated rows and null ids are judged alike; an empty table gives no rows;
other columns, whatever their names, play no part. Positions are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.arrow import slices

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "card_other", "ssn", "phone_national", "secret")
KINDS = BASE + FURTHER
#: Further spans stay from this score on.
KEEP = 0.5
#: What a word nearby adds, or takes away.
NEARBY = 0.3
#: Code points looked at before and after a span.
BEFORE, AFTER = 48, 24

#: Scores without any context; a checksum that one in 97 or one in ten numbers passes weighs more than a shape.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "card_other": 0.4, "ssn": 0.4, "phone_national": 0.3, "secret": 0.3}
_CARD_WORDS = {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"}
_PHONE_WORDS = {"tel", "telephone", "phone", "mobile", "call", "fax", "telefon", "fon", "handy", "mobil", "appel", "portable", "movil", "telefono"}
CONTEXT = {
    "email": {"mail", "email", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "address", "server", "login"},
    "card": _CARD_WORDS, "card_other": _CARD_WORDS, "phone": _PHONE_WORDS, "phone_national": _PHONE_WORDS,
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "secret": {"token", "secret", "password", "passwd", "apikey", "key", "credential", "passwort", "contraseña"},
}
DOUBT = {
    "email": set(), "ip": {"version", "release", "section"}, "card": {"order", "invoice", "tracking"},
    "card_other": {"order", "invoice", "tracking", "isbn"}, "phone": set(), "phone_national": {"order", "invoice", "isbn", "page"},
    "iban": set(), "ssn": {"part", "model", "serial"}, "secret": {"sha", "commit", "checksum", "digest", "md5"},
}

#: Characters of an IBAN by country.
IBAN_LENGTH = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
               "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
               "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
               "TR": 26}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20-]?[A-Z0-9])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]++(?:[\x20./-][0-9]++)*+")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(r"(?<![\w+(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20/.-])[0-9]{2,5}(?:[\x20/.-]?[0-9]{2,5}){0,3}(?![\w(])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the sum over the digits, every second one from the right doubled, ends in 0."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each @ the local part is what reaches it without a break, back to the last match at most.
    start, at = 0, text.find("@")
    while at >= 0:
        local = text[start:at]
        begin = start + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        start = found.end() if found else at + 1
        at = text.find("@", start)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) < 4 and int(p) < 256 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        length, at, found = IBAN_LENGTH.get(m.group()[:2], 0), m.start(), []
        while at < len(text) and len(found) < length:
            if text[at] in " -" and found and text[at - 1] not in " -":
                at += 1
                continue
            if not ("0" <= text[at] <= "9" or "A" <= text[at] <= "Z"):
                break
            found.append(text[at])
            at += 1
        if length and len(found) == length and not text[at:at + 1].isalnum() and mod97("".join(found)):
            yield m.start(), at


def _issuer(digits: str) -> bool:
    """Whether a card's first digits and length are those of a known scheme."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (digits[0] == "4" and n in (13, 16, 19) or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two == 65 or four == 6011)
            or n == 15 and two in (34, 37) or n == 14 and two in (36, 38))


def _other_cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _GROUPS.finditer(text):
        groups = [(g.start() + m.start(), g.group()) for g in re.finditer(r"[0-9]+", m.group())]
        i = 0
        while i < len(groups):
            held, j = "", i
            while j < len(groups) and len(held) + len(groups[j][1]) <= 19:
                held += groups[j][1]
                j += 1
                if len(held) >= 13 and _issuer(held) and luhn(held):
                    yield groups[i][0], groups[j - 1][0] + len(groups[j - 1][1])
                    i = j - 1
                    break
            i += 1


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _national(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        if 7 <= len(_digits(m.group())) <= 12:
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        run = m.group()
        if _DIGIT.search(run) and re.search("[A-Za-z]", run):
            n = len(run)
            if -sum(k / n * math.log2(k / n) for k in Counter(run).values()) >= 3:
                yield m.span()


#: Proposals that passed their checks, by kind.
FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "card_other": _other_cards, "ssn": _ssns,
           "phone_national": _national, "secret": _secrets}


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's score and what the words before and after the span say."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE):start])} | {w.lower() for w in _WORD.findall(text[end:end + AFTER])}
    value = SCORE[kind] + NEARBY * (bool(near & CONTEXT[kind]) - bool(near & DOUBT[kind]))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end, score of every span, by kind as listed in KINDS, then by start."""
    digits = bool(_DIGIT.search(text))
    found = []
    for kind in BASE:
        if kind == "email" or digits:
            found += [(kind, a, b, score(kind, text, a, b)) for a, b in FINDERS[kind](text)]
    if digits:
        # Taken spans by start; spans of different base kinds may overlap, so ends are looked at too.
        taken = [(a, b) for _, a, b, _ in found]
        for kind in FURTHER:
            fresh = [(a, b) for a, b in FINDERS[kind](text)]
            free = _apart(fresh, taken)
            kept = [(kind, a, b, s) for a, b in free if (s := score(kind, text, a, b)) >= KEEP]
            taken += [(a, b) for _, a, b, _ in kept]
            found += kept
    return found


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that overlap none of the taken ones. Both are walked once, in order of start."""
    taken, out, k, reach = sorted(taken), [], 0, 0
    for a, b in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


SPANS = "array<struct<kind string, start long, end long, score double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and found (an array of kind, start, end, score) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, f"doc_id long, found {SPANS}")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping ones become one, named by the first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLES: dict[str, str] = {}
