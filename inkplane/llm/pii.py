"""PII by anchor expansion.

An Aho-Corasick automaton finds at-signs, scheme marks, plus signs, digits and identifier cues in one walk of
the text; deterministic local parsers expand each anchor to its span and validate it. Every parser is linear
in the run it stands in. Documents without an anchor cost the walk alone.

Base kinds, leftmost and non-overlapping within their kind: email, ip (parts at most 255), card (16 to 19
digits passing Luhn), phone (8 to 15 digits); a match that fails is dropped, its text not tried again.
Added kinds: url, iban (mod 97), secret (a value assigned to a password, token, secret or key), ssn.

Edge cases: null and empty texts have no spans; offsets are code points, ends exclusive; numbers may have any
number of digits, and leading zeros do not count; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_TAIL = re.compile(r"://[^\s\"'<>]+")
_IBAN = re.compile(r"[\s:=\"']{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})")
_SSN = re.compile(r"[^0-9\n]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_CUES = {"iban": ("iban",), "secret": ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey"), "ssn": ("ssn", "social security")}


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        a.add_word(mark, ("digit" if mark in _DIGITS else mark, len(mark)))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, a: int, b: int) -> int:
    """End of the longest valid number from a to at most b that ends with a word, 0 if there is none: words may follow a number."""
    ends = [b] if not text[b : b + 1].isalnum() else []
    ends += [e for e in range(b - 1, a, -1) if text[e] == " "]
    return next((e for e in ends if _iban_ok(text[a:e])), 0)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the order of KINDS, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    past = dict.fromkeys(("email", "ip", "card", "url", "iban", "secret", "ssn", "run"), 0)

    def put(kind: str, a: int, b: int) -> None:
        found.setdefault(kind, []).append((a, b))

    for end, (what, n) in automaton().iter(text):
        at = end - n + 1
        if what == "digit":
            if at >= past["card"] and (m := _CARD.match(text, at)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    put("card", at, m.end())
            if at >= past["ip"] and (at == 0 or text[at - 1] not in _DIGITS or at == past["ip"]) and (m := _IP.match(text, at)):
                past["ip"] = m.end()
                parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    put("ip", at, m.end())
        elif what == "@":
            a = at
            while a > past["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at)):
                past["email"] = m.end()
                put("email", a, m.end())
        elif what == "+":
            if m := _PHONE.match(text, at):
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    put("phone", at, m.end())
        elif what == "://":
            a = at
            while a > past["url"] and text[a - 1] in _SCHEME:
                a -= 1
            if a < at and at >= past["url"] and (m := _URL_TAIL.match(text, at)):
                past["url"] = m.end()
                put("url", a, m.end())
        else:
            m = {"iban": _IBAN, "secret": _SECRET, "ssn": _SSN}[what].match(text, end + 1)
            if m and m.start(1) >= past[what] and (b := _iban_end(text, *m.span(1)) if what == "iban" else m.end(1)):
                past[what] = b
                put(what, m.start(1), b)
    return [(kind, a, b) for kind in KINDS for a, b in found.get(kind, ())]


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    if not found:
        return text
    out, past = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a >= past:
            out += [text[past:a], f"[{kind.upper()}]"]
        past = max(past, b)
    return "".join(out) + text[past:]


_SPANS = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches):
    for b in common.slices(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            every = spans(text)
            base = [x for x in every if x[0] in BASE_KINDS]
            rows.append((doc_id, *[sum(x[0] == k for x in base) for k in BASE_KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SPANS, strict=True)], schema=_SPANS)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of each document."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span masked, in the same columns; n_chars follows the text."""
    columns = docs.columns

    def mask(batches):
        for batch in batches:
            for b in common.slices(iter([batch])):
                texts = b.column("text").to_pylist()
                new = [masked(t, spans(t)) for t in texts]
                arrays = [pa.array(new, b.schema.field("text").type) if c == "text" else pa.array([None if t is None else len(t) for t in new], b.schema.field(c).type) if c == "n_chars" else b.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(mask, docs.schema)


def op8_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"))
