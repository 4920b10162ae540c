"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Each kind has a pattern, a check of what it proposes and a score to begin with.
A checksum that holds (Luhn for card numbers, mod 97 for bank accounts) is worth
a high score; kinds without one need a word beside them that says what the
number is ("tel", "ssn"), and words that say something else ("version", "order")
lower a score. Words count within ``NEAR`` characters on either side.

Base kinds (e-mail, IP address, card, phone with a +) are always spans, whatever
their scores: leftmost, not overlapping within a kind, and a match that fails its
check is dropped and not tried again from inside. Added kinds (IBAN, shorter card
numbers, social security numbers, phone numbers without a +) are spans where
their score is at least ``THRESHOLD``, they overlap no base span and no added
span with a higher score (of equals the earlier one, then the longer one).

Every pattern is read in time linear in the text. Places are code points, ends
exclusive. ``spans`` is a function of a text column, ``redacted`` puts the kinds
in the spans' places.

Defined cases: a null text is the empty text, which has no spans; very long texts
are read whole; repeated rows get the same spans each; ids are not looked at; an
empty table gives an empty result; other columns are ignored (``spans``) or kept
(``redacted``). Spans are in the order of kinds and then of places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import table

THRESHOLD, NEAR = 0.5, 40
#: Kinds in the order of results; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "ssn", "local_phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double,confirmed:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("confirmed", pa.bool_())]))

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ -]?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9])")
#: Lengths of bank account numbers by country (ISO 13616). Fixed values.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> bool:
    """Whether the last digit of a number is Luhn's check digit."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether a bank account number (no spaces, upper case) leaves 1 by mod 97 with its first four characters last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides; an address begins after the one before."""
    stop = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < stop:
            continue
        begin = at
        while begin > stop and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            stop = domain.end()
            yield begin, stop
        else:
            stop = max(stop, at)  # no address reaches over this @


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each run of numbers and dots, if none is over 255."""
    for m in _DOTTED.finditer(text):
        if text.find(".", m.start(), m.end()) < 0:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _numbers(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < least:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if least <= len(digits) <= most and luhn(digits):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of 16 to 19 digits that pass Luhn's check."""
    return _numbers(text, 16, 19)


def short_cards(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of 13 to 15 digits that pass Luhn's check."""
    return _numbers(text, 13, 15)


def phones(text: str) -> Iterator[tuple[int, int]]:
    """A +, and 8 to 15 digits."""
    for m in _PLUS.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many characters as the country has, blanks and hyphens between them or not, that pass mod 97."""
    for m in _IBAN.finditer(text):
        left, at = _IBAN_LENGTHS.get(m[0][:2], 0) - 4, m.end()
        account = m[0]
        while left > 0 and at < len(text):
            step = 1 if text[at] in " -" and at + 1 < len(text) else 0
            c = text[at + step]
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            account, at, left = account + c, at + step + 1, left - 1
        if left == 0 and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(account):
            yield m.start(), at


def security_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Three, two and four digits; no part is all zeros, and some areas were never given out."""
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    """Area code and number, 7 to 13 digits."""
    for m in _NATIONAL.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 13:
            yield m.span()


def _words(names: str) -> re.Pattern:
    return re.compile(r"(?<![a-z])(?:" + "|".join(names.split()) + r")(?![a-z])")


@dataclass(frozen=True)
class Detector:
    """``propose`` gives spans that hold by themselves; ``score`` is theirs without words nearby."""

    propose: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    confirmed: bool  # by a checksum
    speaks_for: re.Pattern
    speaks_against: re.Pattern


_PHONE = _words("tel telefon telefono phone mobile mobil call cell fax appel rufnummer handy")
_CARD = _words("card visa mastercard amex credit debit karte kreditkarte carte tarjeta cvv cvc")
_NUMBER = _words("version order invoice isbn id serial build release bestellung facture pedido")
DETECTORS = {
    "email": Detector(emails, 0.9, False, _words("mail email contact write schreib contacto kontakt"), _words("git ssh scp")),
    "ip": Detector(addresses, 0.6, False, _words("ip host server address adresse login"), _words("version release chapter section kapitel build")),
    "card": Detector(cards, 0.8, True, _CARD, _NUMBER),
    "phone": Detector(phones, 0.7, False, _PHONE, _NUMBER),
    "iban": Detector(ibans, 0.9, True, _words("iban bank konto account compte cuenta bic"), _NUMBER),
    "short_card": Detector(short_cards, 0.35, True, _CARD, _NUMBER),
    "ssn": Detector(security_numbers, 0.3, False, _words("ssn social security tax"), _NUMBER),
    "local_phone": Detector(local_phones, 0.3, False, _PHONE, _NUMBER),
}
_FOR, _AGAINST = 0.3, 0.4


def scored(detector: Detector, text: str, start: int, end: int) -> float:
    """The score of a span with the words around it."""
    around = (text[max(0, start - NEAR) : start] + " | " + text[end : end + NEAR]).lower()
    score = detector.score + _FOR * bool(detector.speaks_for.search(around)) - _AGAINST * bool(detector.speaks_against.search(around))
    return round(min(max(score, 0.0), 1.0), 2)


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text."""
    found: dict[str, list[dict]] = {}
    for kind, d in DETECTORS.items() if text else ():
        rows = [dict(kind=kind, start=a, end=b, score=scored(d, text, a, b), confirmed=d.confirmed) for a, b in d.propose(text)]
        if rows:
            found[kind] = rows
    base = [s for kind in BASE for s in found.get(kind, [])]
    more = [s for kind in KINDS[len(BASE) :] for s in found.get(kind, []) if s["score"] >= THRESHOLD]
    if not more:
        return base
    # By score: whoever comes first keeps the characters. Spans of one kind don't overlap, so few meet any one.
    taken = bytearray(len(text))
    for s in base:
        taken[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
    kept = []
    for s in sorted(more, key=lambda s: (-s["score"], s["start"], -s["end"])):
        if not any(taken[s["start"] : s["end"]]):
            taken[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
            kept.append(s)
    return base + sorted(kept, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def redact(text: str | None) -> str | None:
    """The text with [KIND] in the place of each span; of spans that overlap, what they cover together."""
    out, upto = [], 0
    for s in sorted(spans_of(text), key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= upto:
            continue
        if s["start"] >= upto:
            out += [text[upto : s["start"]], f"[{s['kind'].upper()}]"]
        upto = s["end"]
    return text if not out else "".join(out) + text[upto:]


def spans(text: str | Column) -> Column:
    """The spans of a text column: kind, start, end, score and whether a checksum confirms them."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t.as_py()) for t in texts], _SPANS)

    return found(F.col(text) if isinstance(text, str) else text)


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with kinds in the place of personal data."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py()) for t in texts], pa.string())

    return docs.select(*[cleaned(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _of(found: str, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def _named(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", spans("text").alias("found"))
    counts = [F.size(_of("found", kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(_named(_of("found", *BASE)), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"))
