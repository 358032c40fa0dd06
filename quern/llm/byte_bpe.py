"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one connection per partition.

Encoding: the pattern splits a text into pieces, and every distinct piece of the partition becomes token-position rows
``(word, position, previous, next, token, next token)``. Each round of the recursive query joins the rows with the merge
table, contracts the leftmost pair of minimum rank of every word, and goes on until no word has a pair to merge.
Only the last state of a row is kept (``USING KEY``), so memory follows the rows, not the rounds.

Long pieces are cut into chunks, which are contracted side by side and then joined two by two: a sequence of tokens is an
encoding if and only if every two neighbours are the encoding of their own bytes, so only the tokens around a seam are
contracted again, more and more of them until they fit on both sides. There every round contracts all pairs of the least
rank, from the left; that is the same, since no pair that a contraction makes has a lower rank. Both hold where every
token is made of its own bytes by contractions of rising rank (``ordered``, which is checked); with another vocabulary
long pieces are contracted like short ones.

Decoding: the token rows of a text join the vocabulary, and an ordered aggregate puts their bytes together.

Pieces are shared by the texts of a partition, so a word is contracted once, not at every place where it occurs. The
vocabulary and the merge table have a fixed size; they are read on each executor from ``vocabulary`` (a path or a file
name of the installed tokenizer files).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, pieces, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces, and bytes of them, that one recursive query contracts.
ROUND, ROUND_BYTES = 50_000, 500_000
#: Bytes that the pieces take which a Python worker remembers from task to task, about; what an entry takes beside its
#: contents; and the longest such piece.
REMEMBERED, ENTRY, LONGEST = 144 << 20, 160, 64
#: Bytes of a piece that is cut, and of its chunks.
LONG, CHUNK = 512, 64
#: ``\s`` of the tokenizer's pattern engine (Unicode White_Space); Python's own differs at U+001C to U+001F.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"

_CONTRACT = """
WITH RECURSIVE step(w, p, b, n, t, nt) USING KEY (w, p) AS (
  SELECT w, p, lag(p) OVER (PARTITION BY w ORDER BY p), lead(p) OVER (PARTITION BY w ORDER BY p), t, lead(t) OVER (PARTITION BY w ORDER BY p)
  FROM rows_in
  UNION ALL (
    WITH best AS (
      -- the pair of minimum rank, then of the leftmost position, as one number
      SELECT s.w, min(g.m::BIGINT << 32 | s.p) AS k FROM step s JOIN merges g ON g.l = s.t AND g.r = s.nt GROUP BY s.w
    ), gone AS (
      -- the right half of that pair: its token becomes -1, and its neighbours close the gap
      SELECT s.w, (k >> 32)::INT AS m, (k & 4294967295)::INT AS hp, s.p AS rp, s.n AS rn, s.nt AS rnt
      FROM step s JOIN best ON best.w = s.w WHERE s.b = (k & 4294967295)::INT AND s.t >= 0
    )
    SELECT s.w, s.p, CASE WHEN s.b = rp THEN hp ELSE s.b END, CASE WHEN s.p = hp THEN rn ELSE s.n END,
      CASE WHEN s.p = rp THEN -1 WHEN s.p = hp THEN m ELSE s.t END, CASE WHEN s.p = hp THEN rnt WHEN s.n = hp THEN m ELSE s.nt END
    FROM step s JOIN gone g ON g.w = s.w WHERE s.t >= 0
  )
)
SELECT w, p, t FROM step WHERE t >= 0 ORDER BY w, p
"""
#: The same with all pairs of the minimum rank in one round; of pairs that overlap in a run every second one.
_CONTRACT_ALL = """
WITH RECURSIVE step(w, p, n, t, nt) USING KEY (w, p) AS (
  SELECT w, p, lead(p) OVER (PARTITION BY w ORDER BY p), t, lead(t) OVER (PARTITION BY w ORDER BY p) FROM rows_in
  UNION ALL (
    WITH pair AS (
      SELECT s.w, s.p, s.n, g.m FROM step s JOIN merges g ON g.l = s.t AND g.r = s.nt
    ), least AS (
      SELECT w, min(m) AS m FROM pair GROUP BY w
    ), hit AS (
      SELECT w, p, n, m, row_number() OVER (PARTITION BY w ORDER BY p) AS k, lag(n) OVER (PARTITION BY w ORDER BY p) IS DISTINCT FROM p AS opens
      FROM pair JOIN least USING (w, m)
    ), run AS (
      SELECT *, max(CASE WHEN opens THEN k END) OVER (PARTITION BY w ORDER BY p) AS first FROM hit
    ), taken AS (
      SELECT w, p, n, m FROM run WHERE (k - first) % 2 = 0
    ), live AS (
      SELECT s.w, s.p, coalesce(h.m, s.t) AS t
      FROM step s JOIN least l ON l.w = s.w LEFT JOIN taken h ON h.w = s.w AND h.p = s.p LEFT JOIN taken r ON r.w = s.w AND r.n = s.p
      WHERE s.t >= 0 AND r.w IS NULL
    )
    SELECT w, p, lead(p) OVER (PARTITION BY w ORDER BY p), t, lead(t) OVER (PARTITION BY w ORDER BY p) FROM live
    UNION ALL
    SELECT w, n, NULL, -1, NULL FROM taken
  )
)
SELECT w, p, t FROM step WHERE t >= 0 ORDER BY w, p
"""
_DECODE = "SELECT d, string_agg(v.s, '' ORDER BY p) AS s FROM rows_in JOIN vocab v ON v.t = rows_in.t GROUP BY d"


@lru_cache(maxsize=2)
def _tables(vocabulary: str) -> tuple[dict[bytes, int], pa.Table, pa.Table, np.ndarray]:
    """(ranks, merge table, vocabulary with bytes as code points below 256, the token of every byte)."""
    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    merges = pa.table(dict(zip("lrm", (pa.array(x, pa.int32()) for x in zip(*pairs)))))
    vocab = pa.table({"t": pa.array(ranks.values(), pa.int32()), "s": pa.array([k.decode("latin-1") for k in ranks], pa.string())})
    return ranks, merges, vocab, np.array([ranks[bytes([i])] for i in range(256)], np.int32)


@lru_cache(maxsize=2)
def ordered(vocabulary: str) -> bool:
    """Whether every token is made of its own bytes by contractions of rising rank."""
    ranks = _tables(vocabulary)[0]
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, at = min(((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 62 or rank < last:
                return False
            last = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Codec:
    """Encoder and decoder of one partition."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.ranks, merges, vocab, self.of_byte = _tables(vocabulary)
        self.vocabulary = vocabulary
        self.bytes_of = {r: token for token, r in self.ranks.items()}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", "[^" + _WHITE).replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
        self._split = regex.compile(pattern).findall
        # the same pattern for texts in ASCII, where Python's own engine is faster
        self._split_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+")).findall
        self.known: dict[str, str] = {}
        self.held = 0

    def _query(self, sql: str, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray] | list[tuple]:
        self.db.register("rows_in", pa.table({k: pa.array(v, pa.int32()) for k, v in rows.items()}))
        try:
            return self.db.execute(sql).fetchnumpy()
        finally:
            self.db.unregister("rows_in")

    def split(self, text: str) -> list[str]:
        return (self._split_ascii if text.isascii() else self._split)(text)

    def _contracted(self, words: list[bytes], sql: str = _CONTRACT) -> list[list[int]]:
        """The tokens of each word."""
        out: list[list[int]] = []
        while len(out) < len(words):
            start = end = len(out)
            size = 0
            while end < len(words) and end - start < ROUND and (size + len(words[end]) <= ROUND_BYTES or end == start):
                size += len(words[end])
                end += 1
            n = np.array([len(w) for w in words[start:end]])
            first = np.cumsum(n) - n
            got = self._query(sql, {"w": np.repeat(np.arange(len(n)), n), "p": np.arange(n.sum()) - np.repeat(first, n), "t": self.of_byte[np.frombuffer(b"".join(words[start:end]), np.uint8)]})
            tokens = got["t"].tolist()
            cuts = np.searchsorted(got["w"], np.arange(len(n) + 1)).tolist()
            out += [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _fit(self, seams: list[tuple[int | None, int | None]]) -> list[bool]:
        """Whether each two tokens (None: no token) are the encoding of their bytes."""
        real = sorted({s for s in seams if None not in s})
        found = self._contracted([self.bytes_of[a] + self.bytes_of[b] for a, b in real], _CONTRACT_ALL)
        fits = {s: tuple(x) == s for s, x in zip(real, found)}
        return [fits.get(s, True) for s in seams]

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of long pieces, all of them side by side."""
        cut = [[w[i : i + CHUNK] for i in range(0, len(w), CHUNK)] for w in words]
        chunks = iter(self._contracted([c for own in cut for c in own], _CONTRACT_ALL))
        parts = [list(islice(chunks, len(own))) for own in cut]
        while any(len(own) > 1 for own in parts):
            pairs = [(own[i], own[i + 1]) for own in parts for i in range(0, len(own) - 1, 2)]
            joined: list[list[int]] = [a + b for a, b in pairs]
            open_ = [i for i, yes in enumerate(self._fit([(a[-1], b[0]) for a, b in pairs])) if not yes]
            reach = 4
            while open_:
                ends = [(pairs[i][0][-reach:], pairs[i][1][:reach]) for i in open_]
                middle = self._contracted([b"".join(map(self.bytes_of.__getitem__, a + b)) for a, b in ends], _CONTRACT_ALL)
                seams = []
                for i, m in zip(open_, middle):
                    a, b = pairs[i]
                    joined[i] = a[:-reach] + m + b[reach:]
                    seams += [(a[-reach - 1] if len(a) > reach else None, m[0]), (m[-1], b[reach] if len(b) > reach else None)]
                fits = self._fit(seams)
                open_ = [i for i, left, right in zip(open_, fits[::2], fits[1::2]) if not (left and right)]
                reach *= 4
            left = iter(joined)
            parts = [[*islice(left, len(own) // 2), *own[len(own) & ~1 :]] for own in parts]
        return [own[0] for own in parts]

    def _learn(self, words: list[str]) -> None:
        """Contract the pieces that are not known yet."""
        rest, long = [], []
        for word in words:
            if (rank := self.ranks.get(data := word.encode())) is not None:
                self.known[word] = str(rank)
            elif len(data) >= LONG and ordered(self.vocabulary):
                long.append((word, data))
            else:
                rest.append((word, data))
        for (word, _), tokens in zip(rest, self._contracted([data for _, data in rest])):
            self.known[word] = ",".join(map(str, tokens))
        if long:
            for (word, _), tokens in zip(long, self._long([data for _, data in long])):
                self.known[word] = ",".join(map(str, tokens))

    def encode(self, texts: list[str]) -> list[str]:
        """For each text its ids as decimals joined by commas."""
        parts = [self.split(t) for t in texts]
        new = {w for w in set().union(*parts) if w not in self.known}
        before = len(self.known)
        self._learn(list(new))
        out = [",".join(map(self.known.__getitem__, p)) for p in parts]
        for word in [w for w in new if len(w) > LONGEST]:
            del self.known[word]
        # from the end on: a dict keeps the order of insertion
        self.held += sum(len(w) + len(ids) + ENTRY for w, ids in islice(reversed(self.known.items()), len(self.known) - before))
        if self.held > REMEMBERED:  # pieces that came first are the frequent ones: the last half goes, which leaves room for others
            while self.held > REMEMBERED // 2:
                w, ids = self.known.popitem()
                self.held -= len(w) + len(ids) + ENTRY
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        n = np.array([len(x) for x in ids], np.int64)
        out = [b""] * len(ids)
        if n.sum():
            first = np.cumsum(n) - n
            got = self._query(_DECODE, {"d": np.repeat(np.arange(len(ids)), n), "p": np.arange(n.sum()) - np.repeat(first, n), "t": np.concatenate(ids)})
            for d, s in zip(got["d"].tolist(), got["s"].tolist()):
                out[d] = s.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def _codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, ids (little-endian 32-bit), n_tokens, ids_sha256, decoded (the bytes), decoded_sha256.

    A null text counts as empty and has no tokens. Special tokens in a text are ordinary text. Ids of documents may be
    null or repeat; other columns are ignored.
    """

    def make():
        codec = _codec(vocabulary)

        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text", 2 << 20):
                found = codec.encode([t or "" for t in part.column("text").to_pylist()])
                ids = [np.fromstring(s, "<i4", sep=",") for s in found]
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() for s in found], pa.string()),
                        pa.array(back, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"],
                )

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents")).drop("ids", "decoded")
