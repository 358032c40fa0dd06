"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Of equal texts the row with the most code points, then the smallest id, stays.

Three stages, each of which groups by the digest and by the *whole* normalised text, so equal digests alone
never merge two rows:

1. local: the partial aggregate of every map task leaves one row per distinct text of that task;
2. salted: the groups of frequent digests are dealt out by (digest, text, salt of the map task);
3. global: the winners of the salts of a group are combined.

Digests that fewer than one row in ``HOT_SHARE`` has skip the salt: after stage 1 they cannot fill a task.
At most ``HOT_SHARE`` digests can be frequent, which bounds the broadcast list of them.

Rows then meet their winner by the digest, which is short. Should different texts share all digests, the rows with those
digests meet their winner by digest and whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, saved, small, table

#: Parts into which a frequent group is dealt before its winners meet.
SALTS = 32

_KEY = ["q_sha", "q_check", "q_length"]
_TOP = "9223372036854775808"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _rank(length: Column, doc_id: Column) -> Column:
    """One number that is larger for longer texts, then for smaller ids; a null id comes last.

    A decimal keeps the aggregate on the hash path, which a struct would not.
    """
    low = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (length.cast("decimal(12,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + low).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    low = F.pmod(rank, F.lit("1" + "0" * 20).cast("decimal(38,0)"))
    return F.when(low != 0, (F.lit(_TOP).cast("decimal(20,0)") - low).cast("long"))


def _digests(text: Column) -> list[Column]:
    return [F.sha2(text.cast("binary"), 256).alias("q_sha"), F.xxhash64(text).alias("q_check"), F.length(text).alias("q_length")]


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """q_id, q_chars, q_norm (the normalised text), the key, and ``more``."""
    raw = docs.select(F.col(id_col).cast("long").alias("q_id"), F.col(text_col).alias("q_text"), *more)
    rest = raw.columns[2:]
    text = raw.select("q_id", F.coalesce(F.length("q_text"), F.lit(0)).alias("q_chars"), normalised(F.col("q_text")).alias("q_norm"), *rest)
    return text.select("q_id", "q_chars", "q_norm", *_digests(F.col("q_norm")), *rest)


_OWN = lambda: _rank(F.col("q_chars"), F.col("q_id"))


class _Winners:
    """``rows`` (without text), ``hot`` (frequent keys), ``of_key`` (the winner of every key: q_rank, q_size), and ``shared``
    (keys of different texts, None without any) with ``of_text`` (winners of those by key and text)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.rows = saved(_keyed(docs, id_col, text_col).drop("q_norm"))
        least = max(2, -(-self.rows.count() // HOT_SHARE))
        self.hot = saved(self.rows.groupBy(*_KEY).agg(F.count("*").alias("q_n")).where(F.col("q_n") >= least).select(*_KEY))
        best = [F.max(_OWN()).alias("q_rank"), F.count("*").alias("q_size")]
        combine = [F.max("q_rank").alias("q_rank"), F.sum("q_size").alias("q_size")]
        # one pass over the texts; -1 is no salt
        marked = _keyed(docs, id_col, text_col).join(F.broadcast(self.hot.withColumn("q_hot", F.lit(True))), _KEY, "left")
        salt = F.when(F.col("q_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(-1))
        salted = marked.withColumn("q_salt", salt).groupBy(*_KEY, "q_norm", "q_salt").agg(*best, F.max("q_salt").alias("q_dealt"))
        # a filter on the aggregate, not on the key, so both branches read the same shuffle
        texts = salted.where("q_dealt < 0").select(*_KEY, "q_rank", "q_size").unionByName(salted.where("q_dealt >= 0").groupBy(*_KEY, "q_norm").agg(*combine).drop("q_norm"))
        of_key = saved(texts.groupBy(*_KEY).agg(*combine, F.count("*").alias("q_texts")))
        self.of_key, self.shared = of_key.where("q_texts = 1").drop("q_texts"), None
        if of_key.where("q_texts > 1").limit(1).count():
            self.shared = small(saved(of_key.where("q_texts > 1").select(*_KEY)))
            self.rows = self.rows.join(self.shared, _KEY, "left_anti")
            self.of_text = _keyed(docs, id_col, text_col).join(self.shared, _KEY, "left_semi").groupBy(*_KEY, "q_norm").agg(*best)

    def met(self) -> DataFrame:
        """Every row with its winner. Rows of frequent groups meet it in the map task, so no group is dealt to one task."""
        of_hot = self.of_key.join(F.broadcast(self.hot), _KEY, "left_semi")
        return self.rows.join(F.broadcast(self.hot), _KEY, "left_anti").join(self.of_key, _KEY).unionByName(self.rows.join(F.broadcast(of_hot), _KEY))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Null text counts as empty, and all empty texts are one group. Of rows that repeat both the id and the length of the
    row that stays, all are marked kept, as nothing tells them apart; ``deduplicated`` returns one of them. A null id
    stays only in a group without other ids of that length. Other columns of ``docs`` are ignored, whatever their names;
    an empty table gives an empty result.
    """
    winners = _Winners(docs, id_col, text_col)
    found = winners.met()
    if winners.shared is not None:
        own = _keyed(docs, id_col, text_col).join(winners.shared, _KEY, "left_semi")
        found = found.unionByName(own.join(winners.of_text, [*_KEY, "q_norm"]).drop("q_norm"))
    return found.select(
        F.col("q_id").alias("doc_id"),
        _id_of(F.col("q_rank")).alias("keep_id"),
        F.col("q_size").alias("group_size"),
        (_OWN() == F.col("q_rank")).alias("kept"),
        F.col("q_sha").alias("text_sha256"),
        F.col("q_chars").cast("long").alias("n_chars"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row of each group, also of rows that repeat an id.

    Which row stays is as in ``exact_duplicates``; of rows with equal text, length and id any one. Columns may have any
    names; an empty table stays empty.
    """
    winners = _Winners(docs, id_col, text_col)
    # the columns of docs travel in a struct, so their names cannot clash
    every = _keyed(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row")).withColumn("q_own", _OWN())
    rows = every.drop("q_norm")
    met = winners.met().withColumn("q_own", _OWN())
    marks = [*_KEY, "q_own"]
    if winners.shared is not None:
        rows = rows.join(winners.shared, _KEY, "left_anti")
    kept = rows.join(small(saved(met.where("q_own != q_rank").select(*marks).distinct())), marks, "left_anti")
    again = saved(met.where("q_own = q_rank").groupBy(*marks).agg(F.count("*").alias("q_n")).where("q_n > 1").select(*marks))
    if again.limit(1).count():  # rows that repeat the id, too
        again = small(again)
        kept = kept.join(again, marks, "left_anti").unionByName(kept.join(again, marks, "left_semi").dropDuplicates(marks))
    if winners.shared is not None:
        own = every.join(winners.shared, _KEY, "left_semi").join(winners.of_text, [*_KEY, "q_norm"]).where("q_own = q_rank")
        kept = kept.unionByName(own.dropDuplicates([*_KEY, "q_norm"]).select(*kept.columns))
    return kept.select("q_row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chars")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), w AS (
  SELECT t, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN w ON d.t = w.t
"""
