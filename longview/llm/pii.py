"""Personal data by regular expressions, checksum validators and nearby context words.

A pattern proposes spans, a validator confirms or drops each (number range, Luhn, digit count, mod 97), and words
within CONTEXT code points on either side raise or lower its score. The four base kinds always stay once
validated; the added kinds stay at a score of KEEP or more: iban, ssn, key (access keys and tokens by their
prefixes, private-key headers) and secret (the value that follows a word for a password or token and = or :).

Each pattern is read so that the time follows the text's length: a number is entered at its first digit only,
and an address from its at sign. That gives the leftmost non-overlapping matches all the same.

Defined results: a null text is an empty one and gives zero counts; repeated rows and null ids are answered row by
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import read, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key", "secret")
CONTEXT = 40
KEEP = 0.7

# fixed values: words that speak for a kind, and words that speak against personal data
FOR = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "server", "host", "client", "address", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "debit"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "konto", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "key": {"key", "token", "secret", "access", "credentials"},
    "secret": {"login", "user", "username", "credentials"},
}
# fixed values: lengths of account numbers by country
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
AGAINST = {"example", "sample", "test", "version", "isbn", "order", "invoice"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
# fixed values: prefixes of access keys and tokens, and words before a secret
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,100}|xox[abprs]-[A-Za-z0-9-]{10,80}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]{1,12}\x20){0,2}PRIVATE KEY-----")
_SECRET = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?([^\s\"'<>,;]{8,200})")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    left = 0
    for c in turned:
        left = int(f"{left}{int(c, 36)}") % 97
    return left == 1


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
        pos = m.end() if m else at + 1


def _iban_end(text: str, start: int) -> int:
    """Where the account number that begins at start ends, or 0: as many letters and digits as its country has, single
    spaces between them, and no letter or digit after them."""
    size, at, found = IBAN.get(text[start : start + 2], 0), start, []
    while len(found) < size and at < len(text):
        if text[at] == " " and found and text[at - 1] != " ":
            at += 1
            continue
        if not (text[at].isascii() and (text[at].isdigit() or "A" <= text[at] <= "Z")):
            return 0
        found.append(text[at])
        at += 1
    after = text[at : at + 1]
    return at if size and len(found) == size and not (after.isascii() and after.isalnum()) and mod97("".join(found)) else 0


def _propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Validated spans by kind."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _KEY.finditer(text):
        yield "key", *m.span()
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            yield "secret", *m.span(1)
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        end = _iban_end(text, m.start())
        if end:
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()


# a valid span's score before its context: what the pattern and the checksum alone are worth
_ALONE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "key": 0.9, "secret": 0.8}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start]) + _WORD.findall(text[end : end + CONTEXT])}
    return round(min(1.0, max(0.0, _ALONE[kind] + 0.3 * bool(near & FOR[kind]) - 0.2 * bool(near & AGAINST))), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then by kind as listed; code points, end exclusive."""
    text = text or ""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in _propose(text)]
    return sorted((x for x in found if x[0] in BASE or x[3] >= KEEP), key=lambda x: (x[1], KINDS.index(x[0])))


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.string()), ("n_spans", pa.int64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in batch.column("text"):
            found = find(value.as_py())
            base = [x for x in found if x[0] in BASE]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest()
            out.append((*(sum(x[0] == k for x in base) for k in BASE), digest, ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found), ",".join(f"{x[3]:.2f}" for x in found), len(found)))
        columns = list(zip(*out, strict=True)) or [()] * (len(_FOUND) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_FOUND)[1:], strict=True))], schema=_FOUND)


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the counts of base kinds, their digest, all spans, scores and their number."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_spans), from_arrow_schema(_FOUND))


def masked(text: str | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans, the first's."""
    if text is None:
        return None
    parts, at = [], 0
    for kind, s, e, _ in find(text):
        if s >= at:
            parts += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with text masked; all columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"))
