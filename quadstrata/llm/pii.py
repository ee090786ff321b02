"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Base kinds (email, ip, card, phone) are proposed left to right without overlaps per
kind, then checked (address parts at most 255, Luhn, digit counts).  Further kinds:
iban (mod-97), card_loose (13 digits passing Luhn) and us_ssn (valid ranges);
these become spans only if their score reaches ``threshold``.  A span's score is what
its kind and checksum give, plus a bonus for context words within ``window`` characters
on either side, less one if a word there says that it's something else.

One pass over the texts, nothing is shuffled.  All patterns are linear in the text, which
is scanned whole whatever its length.  Null texts are empty texts; null ids are kept, repeated
rows have a row each, an empty table gives no row.  Only the id and the text column are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import Span, joined, sha256

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card_loose", "us_ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Only at the start of a run of digits: a match that fails there fails further in too, and a match ends where its run ends.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
#: May take in words after the number; more_spans tries each end at a word's end.
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card_loose": 0.4, "us_ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "@"), "ip": ("ip", "server", "host", "address"), "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"), "card_loose": ("card", "visa", "credit", "payment"), "us_ssn": ("ssn", "social security"),
}
AGAINST = {"ip": ("version", "release"), "card": ("isbn", "order no", "serial"), "card_loose": ("isbn", "ean", "serial"), "phone": ("serial",)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


#: A letter counts as its place in the alphabet plus 9.
LETTERS = {ord("A") + k: str(10 + k) for k in range(26)}


def mod97(iban: str) -> bool:
    return int((iban[4:] + iban[:4]).translate(LETTERS)) % 97 == 1


def only_digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@ and a dotted domain, leftmost; from each @ outwards, so in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return out


def more_spans(text: str) -> list[Span]:
    """Proposals of the further kinds that pass their validators."""
    out: list[Span] = []
    end = 0
    for m in IBAN.finditer(text):
        rest = IBAN_REST.match(text, m.end()) if m.start() >= end else None
        stop = rest.end() if rest else -1
        while stop > m.end():  # the longest that passes
            v, after = text[m.start() : stop].replace(" ", ""), text[stop : stop + 1]
            if 15 <= len(v) <= 34 and not (after.isascii() and after.isalnum()) and mod97(v):
                out.append((m.start(), stop, "iban"))
                end = stop
                break
            stop = text.rfind(" ", m.end(), stop)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and len(d := only_digits(m[0])) == 13 and luhn(d):
            out.append((m.start(), m.end(), "card_loose"))
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append((m.start(), m.end(), "us_ssn"))
    return out


def score(text: str, span: Span, window: int = 48) -> float:
    a, b, kind = span
    near = (text[max(0, a - window) : a] + " " + text[b : b + window]).lower()
    s = PRIOR[kind] + 0.3 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in near for w in AGAINST.get(kind, ()))
    return min(1.0, max(0.0, round(s, 6)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, window: int = 48) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (as spans), max_score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {k: [] for k in BASE}
            sha, spans, scores, top = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for k in BASE:
                    n[k].append(sum(s[2] == k for s in base))
                sha.append(sha256(joined(base, ORDER)))
                scored = {s: score(text, s, window) for s in base}
                scored |= {s: v for s in more_spans(text) if (v := score(text, s, window)) >= threshold}
                ordered = sorted(scored, key=lambda s: (s[0], ORDER[s[2]], s[1]))
                spans.append(joined(ordered, ORDER))
                scores.append([scored[s] for s in ordered])
                top.append(max(scored.values(), default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(n[k], pa.int64()) for k in BASE], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64())), pa.array(top, pa.float64())], names=[id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores", "max_score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>, max_score double")
