"""Secret scan: sliding-window Shannon entropy over candidate strings, with an allow-list.

Base kinds are patterns: assign (the whole assignment to a telling name), access (AKIA keys) and hex runs.
The method adds ``entropy``: every candidate string (a run of ``LEAST`` or more token characters) is put into a character
class, a window of ``WINDOW`` characters (of all, if it has fewer) slides over it, and the entropy of the window is kept up
to date from the counts of the character that enters and the one that leaves. A candidate whose best window reaches the
threshold of its class is reported unless the allow-list knows it; for shorter windows the threshold falls with the
logarithm of their width. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, pieces, table

KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]
WINDOW, LEAST = 20, 16
#: Bits a character that the best window of a candidate must reach, by its class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+\Z")), ("alnum", re.compile(r"[A-Za-z0-9]+\Z")))
#: Strings that look random but are not secrets.
_ALLOWED = re.compile(
    r"""[0-9]+(?:[-_/][0-9]+)*\Z                                # numbers and dates
      | [0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z  # UUIDs
      | .*(?:example|placeholder|changeme|xxxxx|redacted)       # placeholders
      | (.)\1+\Z                                                # one repeated character
      | (?:sha(?:1|256|384|512)-)                               # integrity hashes
    """,
    re.VERBOSE | re.IGNORECASE | re.ASCII,
)
_LETTERS = re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def allowed(s: str) -> bool:
    """Whether the allow-list knows a candidate: one of its patterns, or letters only in parts (``oneWord``, ``ONE_WORD``) of
    three and more on average, as words have."""
    return bool(_ALLOWED.match(s)) or bool(_LETTERS.match(s)) and 3 * len(_PARTS.findall(s)) <= len(s)


_C_LOG_C = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def best_entropy(s: str, width: int = WINDOW) -> float:
    """The largest Shannon entropy of a window of ``width`` characters (of the whole, if shorter), in bits a character."""
    width = min(width, len(s))
    if not width:
        return 0.0
    term = _C_LOG_C if width <= WINDOW else [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for c in s[:width]:
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
    least = total
    for out, c in zip(s, s[width:]):
        if out != c:
            n = counts[out]
            counts[out] = n - 1
            total += term[n - 1] - term[n]
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += term[n + 1] - term[n]
            least = min(least, total)
    return math.log2(width) - least / width


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then by kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is found whole, as a run is maximal to both sides
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if allowed(s):
            continue
        kind = next((k for k, p in _CLASSES if p.match(s)), "base64")
        if best_entropy(s) >= THRESHOLDS[kind] * math.log2(min(len(s), WINDOW)) / math.log2(WINDOW):
            out.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def listed(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, a count per base kind, base_sha256, spans, n_entropy.

    Null and empty texts have no spans; ids may be null or repeat. Other columns are ignored.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                found = [find(t or "") for t in part.column("text").to_pylist()]
                counts = {k: pa.array([sum(s[2] == k for s in x) for x in found], pa.int64()) for k in KINDS}
                sha = pa.array([hashlib.sha256(listed(x, BASE).encode()).hexdigest() for x in found], pa.string())
                spans = pa.array([listed(x, KINDS) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(counts[k] for k in BASE), sha, spans, counts["entropy"]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
