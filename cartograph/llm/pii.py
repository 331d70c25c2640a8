"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds: email, ip, card (Luhn), phone, and iban (mod-97), which the method adds. Every
confirmed span is reported; its score starts at the kind's base and moves with context words
within ``CONTEXT`` code points on either side, so that a caller can redact above a score.
Offsets are code points, end exclusive.

The patterns are run from anchors (an at sign, a plus sign, the start of a run of digits), so
each text is read in time linear in its length, and matches of a kind stay leftmost and
non-overlapping.

Defined results: a null text counts as empty and has no spans. Repeated rows are scored each on its own;
an empty table gives an empty result; texts of any length are read whole; extra columns are not read by
``find_pii`` and pass through ``redact``. Spans of two kinds may overlap, both are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
CONTEXT = 40
#: Spans that score less are left in a text that is redacted: an address whose neighbours say that it is a version or section.
MIN_SCORE = 0.3

# Patterns of the base kinds, read with their left bound made explicit.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")

# Base score of a kind, and words that raise or lower it.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.9}
RAISE = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
LOWER = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section"),
    "card": ("order", "serial", "tracking", "invoice"),
    "phone": ("order", "serial", "isbn"),
    "iban": ("serial", "sample"),
}
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    rest = 0
    for c in turned:
        rest = (rest * 10 + int(c) if c.isdigit() else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in (q[-4:] if not q[:-4].strip("0") else "999" for q in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of groups that passes; a word after the number may look like a group."""
    at = 0
    while m := IBAN.search(text, at):
        end = m.end()
        while end > m.start():
            code = text[m.start() : end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
        at = max(end, m.start() + 4) if end > m.start() else m.end()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All confirmed spans of a text as (kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    kinds = [k for k, has in (("email", "@" in text), ("phone", "+" in text)) if has]
    if DIGIT.search(text):
        kinds += ["ip", "card", "iban"]
    return [(k, s, e) for k in KINDS if k in kinds for s, e in FINDERS[k](text)]


def score(text: str, kind: str, start: int, end: int) -> float:
    """Base score of the kind, moved by context words near the span, within 0..1."""
    near = set(WORD.findall(f"{text[max(0, start - CONTEXT):start]} {text[end:end + CONTEXT]}".lower()))
    move = 0.15 * bool(near.intersection(RAISE[kind])) - 0.3 * bool(near.intersection(LOWER[kind]))
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + move)), 2)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by [KIND]; of overlapping ones the earlier and longer one names the place."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and spans (array of kind, start, end, score) per row of ``docs``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i in range(part.num_rows):
                    t = part.column(1)[i].as_py()
                    rows.append([{"kind": k, "start": s, "end": e, "score": score(t, k, s, e)} for k, s, e in find(t)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPAN_TYPE)], ["id", "spans"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with spans scored at least ``min_score`` replaced in ``text``; null stays null."""
    names = docs.columns
    k = names.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                new = []
                for i in range(part.num_rows):
                    t = part.column(k)[i].as_py()
                    new.append(t and redact_text(t, [x for x in find(t) if min_score <= 0 or score(t, *x) >= min_score]))
                cols = list(part.columns)
                cols[k] = pa.array(new, pa.string()).cast(part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, sha256 of the base spans, all spans as text, their scores in the same order, and how many score ``MIN_SCORE`` or more."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *[of(k) for k in BASE_KINDS], of("iban"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"), F.size(F.filter("spans", lambda x: x["score"] >= MIN_SCORE)).cast("long").alias("n_sure"))


def sha_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS).encode()).hexdigest()
