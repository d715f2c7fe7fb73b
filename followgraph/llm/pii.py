"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from followgraph.llm.worker import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does; possessive, so it takes linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

# Score of a span before its surroundings count, and what a nearby word adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "account": 0.3}
NEAR_CHARS = 48
CONTEXT = {
    "email": (0.1, ("mail", "e-mail", "contact", "correo", "courriel")),
    "ip": (0.2, ("ip", "address", "host", "server", "adresse")),
    "card": (0.2, ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta")),
    "phone": (0.2, ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")),
    "iban": (0.1, ("iban", "bank", "account", "konto", "compte", "cuenta")),
    "account": (0.4, ("account", "konto", "compte", "cuenta", "iban", "bank", "card", "karte", "carte", "tarjeta")),
}
THRESHOLD = 0.6
WORDS = {kind: re.compile(r"\b(?:%s)" % "|".join(map(re.escape, words)), re.I) for kind, (_, words) in CONTEXT.items()}


@dataclass(frozen=True)
class Span:
    """A piece of a text, in code points, end exclusive."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether an account number without spaces passes the mod-97 check."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, @ and the domain, found from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = max(done, text.rfind("@", done, at) + 1)
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """Whether digits are a number of at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their checks, kind by kind."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() < 10:
            continue
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
        elif 10 <= len(digits) <= 13 and luhn(digits):
            yield "account", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        # The longest valid number: what follows it may look like more of it.
        words = m.group().split(" ")
        for n in range(len(words), 0, -1):
            number = "".join(words[:n])
            if 15 <= len(number) <= 34 and mod_97(number):
                yield "iban", m.start(), m.start() + len(" ".join(words[:n]))
                break


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of personal data in a text, by start, then kind as in KINDS.

    Base kinds stay whatever their score; the other kinds, a bank account
    number confirmed by mod-97 and a shorter number confirmed by Luhn, need
    ``threshold``. Other kinds never overlap a base span.
    """
    spans = []
    for kind, start, end in _proposed(text):
        add, _ = CONTEXT[kind]
        near = WORDS[kind].search(text, max(0, start - NEAR_CHARS), start) or WORDS[kind].search(
            text, end, end + NEAR_CHARS
        )
        score = min(1.0, PRIOR[kind] + (add if near else 0.0))
        spans.append(Span(kind, start, end, round(score, 3)))
    taken = [s for s in spans if s.kind in BASE]
    free = [
        s
        for s in spans
        if s.kind not in BASE
        and s.score >= threshold
        and not any(s.start < t.end and t.start < s.end for t in taken)
    ]
    return sorted(taken + free, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts of base kinds, base_sha256, spans, scores) per row of ``documents``.

    ``spans`` lists all spans as ``joined`` does, ``scores`` theirs in order;
    ``base_sha256`` is the hash of the base spans alone. A null or empty text
    has none. Repeated rows and rows without a doc_id are scanned like any
    other; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [find(text or "", threshold) for text in part.column(1).to_pylist()]
            base = [[s for s in spans if s.kind in BASE] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *counts,
                    pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]),
                    pa.array([joined(s) for s in found]),
                    pa.array([[s.score for s in spans] for spans in found], pa.list_(pa.float64())),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"],
            )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>"
    return documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, schema)
