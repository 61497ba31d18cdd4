"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Kinds in order: ``email``, ``ip``, ``card``, ``phone`` (the base kinds), ``iban``, ``ssn``.
A span of a base kind stands on its pattern and validator (parts of an address at most 255,
Luhn for cards, numbers of digits); a failing match is dropped and not retried.  ``iban`` is
confirmed by the remainder 97 of its rearranged digits; its end is where the country's length
ends, or else the last end of a word that is confirmed.  ``ssn`` has no checksum and is kept
only if a word nearby speaks for it.  Every span has a score: the kind's own, more for a
context word within ``NEAR`` code points, at most 1.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.  Equal rows
have equal spans.  Whole texts are searched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

NEAR = 40
THRESHOLD = 0.5
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
# fixed values: patterns of the base kinds
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, tried only from the first digit of a run and without giving digits back.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# kinds of this method
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of a code by country.
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Spans = Iterator[tuple[int, int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Country and check digits moved to the end, letters as 10 to 35: remainder 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        value = int(c, 36)
        rest = (rest * (10 if value < 10 else 100) + value) % 97
    return rest == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Spans:
    """Found from the at sign: the run of local characters before it begins the match."""
    behind, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in LOCAL_PART:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            behind = found.end()
            yield start, behind
        at = text.find("@", max(at + 1, behind))


def ips(text: str) -> Spans:
    for m in IP_RUNS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Spans:
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Spans:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield m.span()


def iban_end(run: str) -> int | None:
    """Where the code at the beginning of a match ends."""
    ends = [i for i, c in enumerate(run) if c == " "] + [len(run)]
    codes = {end: run[:end].replace(" ", "") for end in reversed(ends)}
    known = IBAN_LENGTH.get(run[:2])
    # of a known country its own length, and only then the whole match
    tried = (codes if known is None else
             [*(end for end, code in codes.items() if len(code) == known), len(run)])
    return next((end for end in tried
                 if 15 <= len(codes[end]) <= 34 and mod97(codes[end])), None)


def ibans(text: str) -> Spans:
    m = IBAN.search(text)
    while m:
        end = iban_end(m[0])
        if end is not None:
            yield m.start(), m.start() + end
        # what a match took in besides the code can begin another one
        m = IBAN.search(text, m.start() + (end or 1))


def ssns(text: str) -> Spans:
    for m in SSN.finditer(text):
        yield m.span()


#: kind: finder, own score, context words.  The first four are the base kinds.
KINDS: dict[str, tuple[Callable[[str], Spans], float, tuple[str, ...]]] = {
    "email": (emails, 0.9, ("mail", "contact", "write", "correo", "courriel")),
    "ip": (ips, 0.6, ("ip", "server", "host", "address", "adresse")),
    "card": (cards, 0.8, ("card", "credit", "visa", "karte", "tarjeta", "carte")),
    "phone": (phones, 0.7, ("phone", "call", "tel", "fax", "mobile")),
    "iban": (ibans, 0.9, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    "ssn": (ssns, 0.3, ("ssn", "social", "security")),
}
BASE = tuple(KINDS)[:4]
ORDER = {kind: i for i, kind in enumerate(KINDS)}
CONTEXT = {kind: re.compile(r"\b(?:" + "|".join(words) + r")", re.IGNORECASE)
           for kind, (_, _, words) in KINDS.items()}


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Kind, start, end and score of every span, by start, then kind."""
    found = []
    for kind, (finder, own, _) in KINDS.items():
        for start, end in finder(text):
            near = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
            score = min(1.0, own + 0.3 * bool(CONTEXT[kind].search(near)))
            if kind in BASE or score >= threshold:
                found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def find(text: Column, threshold: float = THRESHOLD) -> Column:
    """The spans of each text."""
    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                          ("score", pa.float64())])
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s))
                          for s in spans_of(t or "", threshold)] for t in texts.to_pylist()],
                        pa.list_(kind))

    return spans(text)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_text(text: str, threshold: float = THRESHOLD) -> str:
    """Spans replaced by their kind in brackets; spans that overlap are replaced as one."""
    out, behind = [], 0
    for kind, start, end, _ in spans_of(text, threshold):
        if start >= behind:
            out += [text[behind:start], f"[{kind.upper()}]"]
        behind = max(behind, end)
    return "".join([*out, text[behind:]])


def mask(text: Column, threshold: float = THRESHOLD) -> Column:
    """Texts without their personal data; null stays null."""
    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked_text(t, threshold)
                         for t in texts.to_pylist()], pa.string())

    return masked(text)
