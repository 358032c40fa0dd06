"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, ``://`` and identifier cues) in one pass over
the whole text; deterministic local parsers expand each anchor to its boundaries and validate it. Positions are code
points, ends are exclusive.

Base kinds are email, ip, card and phone, leftmost and non-overlapping within a kind. The method adds ``url``
(addresses that carry a user name and password) and ``account`` (an identifier after a cue such as ``IBAN``).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, pieces, table

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s\"'<>]+")
_CUES = ("IBAN", "iban", "SSN", "ssn", "passport", "Passport", "account", "Account", "acct")
_ACCOUNT = re.compile(r"(?:\x20(?:no|number|nr)\.?)?\x20?[:#=]?\x20?([A-Z]{0,3}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "u"), *((d, "d") for d in "0123456789"), *((c, "c") for c in _CUES)]:
        found.add_word(word, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid_iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in a whole text, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = run_end = 0
    for at, kind in _anchors().iter(text):
        if kind == "d":
            if at < run_end:
                continue
            # the first digit of a run: only here can an address or a number begin
            run_end = at + 1
            while run_end < len(text) and text[run_end] in _DIGITS:
                run_end += 1
            if at >= ip_end and text[run_end : run_end + 1] == "." and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out["ip"].append(m.span())
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                if m.end() - at >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                email_end = m.end()
        elif kind == "+":
            if (m := _PHONE.match(text, at)) and 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out["phone"].append(m.span())
        elif kind == "u":
            start = at - 2
            if m := _LOGIN.match(text, start):
                while start > 0 and text[start - 1] in _SCHEME:
                    start -= 1
                out["url"].append((start, m.end()))
        elif m := _ACCOUNT.match(text, at + 1):
            code = re.sub("[ -]", "", m[1])
            if sum(c in _DIGITS for c in code) >= 6 and (not code[:2].isalpha() or not 15 <= len(code) <= 34 or _valid_iban(code)):
                out["account"].append(m.span(1))
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for a, b, kind in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, -b)
    return "".join([*out, text[end:]])


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, a count per base kind, base_sha256, spans, redacted (the text without the data).

    Null and empty texts have no spans and an empty redacted text; ids may be null or repeat. Other columns are ignored.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                cols: dict[str, list] = {k: [] for k in ("email", "ip", "card", "phone", "sha", "spans", "redacted")}
                for text in part.column("text").to_pylist():
                    spans = find(text or "")
                    for k in BASE:
                        cols[k].append(len(spans[k]))
                    cols["sha"].append(hashlib.sha256(listed(spans, BASE).encode()).hexdigest())
                    cols["spans"].append(listed(spans, KINDS))
                    cols["redacted"].append(redacted(text or "", spans))
                longs = [pa.array(cols[k], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *longs, *(pa.array(cols[k], pa.string()) for k in ("sha", "spans", "redacted"))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def without_private_data(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with its columns; every span found in a text is replaced. A null text stays null.

    ``length_col`` names a long column that has the code points of the text, which are counted anew where it is not null.
    """
    names = docs.columns

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, text_col):
                texts = [t if t is None else redacted(t, find(t)) for t in part.column(text_col).to_pylist()]
                part = part.set_column(names.index(text_col), text_col, pa.array(texts, pa.string()))
                if length_col is not None:
                    sizes = [n if n is None or t is None else len(t) for n, t in zip(part.column(length_col).to_pylist(), texts)]
                    part = part.set_column(names.index(length_col), length_col, pa.array(sizes, pa.int64()))
                yield part

        return step

    return mapped(docs, make, docs.schema)


def op6_private_data(spark, sf_dir: str) -> DataFrame:
    return private_data(table(spark, sf_dir, "documents")).drop("redacted")
