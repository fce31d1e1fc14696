"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each whole text and stops at anchors only:
at-signs, plus signs, digits, schemes and the cue words of identifiers. From an
anchor a local parser reads to both sides and validates what it found. The parsers
are deterministic: none goes back more than over the run it has just read, so the
time is linear in the text.

Kinds, in this order: ``email``, ``ip``, ``card`` and ``phone`` (the base kinds: leftmost
matches that do not overlap within a kind; a match that fails its check is dropped), then
``login`` (user and password in a URL), ``account`` (a number after a cue such as
"account" or "IBAN") and ``secret`` (a value after "token", "password" and the like).

Definitions. A null text is empty and holds nothing. Positions are code points, the end
is exclusive. Rows are treated one by one, so repeated rows repeat their result and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "secret")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "member id")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]++@(?=[A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no\b\.?|number\b|nr\b\.?|is\b|#|:|=)){0,4}[ \t]*[\"']?([A-Za-z]{0,4}[0-9][A-Za-z0-9]*+(?:[ -](?:[0-9][A-Za-z0-9]*+|(?-i:[A-Z]{4})(?=[ -][0-9])))*+)", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*(?:\"([^\"\s]++)\"|'([^'\s]++)'|([^\s\"']++))")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Places of each kind in a text, by start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= free["card"]:
                if match := _CARD.match(text, at):
                    free["card"] = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(match.span())
            if at >= free["ip"]:
                if match := _IP.match(text, at):
                    free["ip"] = match.end()
                    if all(map(_small, match.groups())):
                        found["ip"].append(match.span())
                else:  # a later start in the same run of digits fails as well
                    free["ip"] = _DIGITS.match(text, at).end()
        elif kind == "@":
            begin = at
            while begin > free["email"] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (match := _HOST.match(text, at + 1)):
                free["email"] = match.end()
                found["email"].append((begin, match.end()))
        elif kind == "+":
            if at >= free["phone"] and (match := _PHONE.match(text, at)):
                free["phone"] = match.end()
                if 8 <= sum(map(str.isdigit, match[0])) <= 15:
                    found["phone"].append(match.span())
        elif kind == "scheme":
            if match := _LOGIN.match(text, last + 1):
                found["login"].append((match.start(), match.end() - 1))
        elif at >= free[kind] and not (at and text[at - 1].isalnum()):
            if kind == "account":
                match = _ACCOUNT.match(text, last + 1)
                if match and sum(map(str.isdigit, match[1])) >= 5:
                    free[kind] = match.end(1)
                    found[kind].append(match.span(1))
            elif match := _SECRET.match(text, last + 1):
                place = match.span(match.lastindex)
                if place[1] - place[0] >= 8:
                    free[kind] = place[1]
                    found[kind].append(place)
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind in kinds for begin, end in found[kind])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(x) if x else dict.fromkeys(KINDS, ()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([len(x[kind]) for x in found], pa.int64()) for kind in KINDS),
                pa.array([hashlib.sha256(_joined(x, BASE).encode()).hexdigest() for x in found], pa.string()),
                pa.array([_joined(x, KINDS) for x in found], pa.string()),
            ],
            ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
        )


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and places of personal data, a row for each row of ``docs``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_spans, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with each place replaced by its kind in brackets; places that overlap are one."""
    if not text:
        return text
    found = sorted((begin, end, kind) for kind, places in spans(text).items() for begin, end in places)
    out, done = [], 0
    for begin, end, kind in found:
        if begin >= done:
            out += [text[done:begin], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` masked."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array([masked(x) for x in batch.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(mask, docs.schema)
