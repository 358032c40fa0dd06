"""Benchmark decontamination in DataFrame operations only: a broadcast hash set of test windows, probed by every window of
every text.

A text is lower-cased (A-Z) and cut into words. An item's windows are its ``SIZE`` consecutive words each; an item of
fewer words is one window. The distinct windows are broadcast by their hash, in blocks of at most ``BLOCK`` windows, so
what is broadcast is bounded whatever the benchmark's size; every block is one more pass over the texts. A text gives one
row for each of its windows, of which those whose hash is in the set and whose words are equal (the verification) are
left; a first row, without a window, stands for the text itself. All of that is one stage. What is then shuffled is one row
for each text and one for each hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, table

#: Words of a window.
SIZE = 10
#: Windows that are broadcast at once.
BLOCK = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, of lower-cased and of original texts.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A word with what follows it; the first one also has what stands before it.
_PIECE = rf"(^{_BETWEEN_RAW}*)?[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{_BETWEEN_RAW}*"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _window(of: Column, before: Column, size: int) -> Column:
    """``size`` words from the one after number ``before`` on; fewer where the array ends."""
    return F.concat_ws(" ", *(F.get(of, before + k) for k in range(size)))


def _items(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item, n, w, h: the size, text and hash of every distinct window of every item. Saved: read for the set and for the items."""
    own = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`")).alias("ws")).where(F.size("ws") > 0)
    own = own.select("item", "ws", F.least(F.size("ws"), F.lit(size)).alias("n"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("n"))).alias("i"))
    # a hash passes over nulls, so a short item's window has the hash of its words alone
    return saved(each.select("item", "n", _window(F.col("ws"), F.col("i"), size).alias("w"), F.xxhash64(*(F.get("hs", F.col("i") + k) for k in range(size))).alias("h")).distinct())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sha (of the text, null for none), ws."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), words(text).alias("ws"))


def _probed(texts: DataFrame, windows: DataFrame, sizes: list[int], head: bool) -> DataFrame:
    """doc_id, sha, n_words, at, n, h, w: verified windows of the texts, ``at`` from 1; with ``head`` also one row with ``at`` 0 for each row.

    The hashes of the words, shifted by 0, 1, 2, ... places and zipped, give a row the hashes of its window in columns.
    """
    most = max(sizes, default=1)
    hashed = texts.select("*", F.concat(F.array(F.lit(0).cast("long")), F.transform("ws", lambda w: F.xxhash64(w))).alias("hs"))
    shifted = F.arrays_zip(*(F.slice("hs", k + 1, 1 << 30).alias(f"c{k}") for k in range(most)))
    rows = hashed.select("doc_id", "sha", "ws", F.size("ws").alias("n_words"), F.posexplode(shifted).alias("at", "c"))
    spot = [F.struct(F.lit(n).alias("n"), F.xxhash64(*(F.col(f"c.c{k}") for k in range(n))).alias("h")) for n in sizes] or [F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("h"))]
    rows = rows.select("doc_id", "sha", "ws", "n_words", "at", *([spot[0].alias("x")] if len(spot) == 1 else [F.explode(F.array(*spot)).alias("x")]))
    rows = rows.select("doc_id", "sha", "ws", "n_words", "at", "x.n", F.when(F.col("at") > 0, F.col("x.h")).alias("h"))
    own = windows.select(F.col("h").alias("q_h"), F.col("n").alias("q_n"), "w")
    # looked at where the hashes are equal only; two comparisons, as one equality would become a join key, made for every window
    here = F.concat_ws(" ", *(F.when(F.col("n") > k, F.get("ws", F.col("at") - 1 + k)) for k in range(most)))
    met = (F.col("h") == F.col("q_h")) & (F.col("n") == F.col("q_n")) & (F.col("at") + F.col("n") <= F.col("n_words") + 1) & (here >= F.col("w")) & (here <= F.col("w"))
    first = (F.col("at") == 0) & (F.col("n") == (sizes[0] if sizes else 1)) if head else F.lit(False)
    found = rows.join(F.broadcast(own), met, "left").where(first | F.col("w").isNotNull())
    return found.select("doc_id", "sha", "n_words", "at", "n", "h", "w")


def _spots(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """``_probed`` for all windows, saved."""
    texts = _texts(docs, id_col, text_col)
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1 to SIZE
    blocks = max(1, -(-windows.count() // block))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
        rows = _probed(texts, part, sizes, b == 0)
        found = rows if found is None else found.unionByName(rows)
    return saved(found)


def _runs(hits: DataFrame) -> DataFrame:
    """doc_id, sha, runs, n_hit from hits (doc_id, sha, at, to): merged (at, to) in order, and how many words they cover."""
    order = Window.partitionBy("doc_id", "sha").orderBy("at", "to")
    opens = F.coalesce(F.col("at") > F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = hits.withColumn("opens", opens.cast("long")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "sha", "run").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return merged.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("runs"), F.sum(F.col("to") - F.col("at") + 1).cast("long").alias("n_hit"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (item ids as strings, sorted), runs (the hit
    words as (first, last) positions from 1, merged), text_sha256 (null for a null text), contaminated.

    A null text has no words, like one without word characters; an item without words hits nothing; a null item id counts
    as the empty string, and items that repeat an id as one. Rows that repeat id and text each give a row. Other columns
    are ignored; empty tables give no rows, or no hits.
    """
    items = _items(benchmark.withColumn("q_item", F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit(""))), "q_item", item_text_col, size)
    windows = saved(items.select("n", "w", "h").distinct())
    spots = _spots(docs, windows, id_col, text_col, block)
    key = ["doc_id", "sha"]
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.sha").eqNullSafe(F.col(f"{b}.sha"))
    texts = spots.where("at = 0").groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"), F.count("*").alias("rows"))
    hits = spots.where("at > 0")
    runs = _runs(hits.select(*key, "at", (F.col("at") + F.col("n") - 1).alias("to")).distinct())
    own = hits.select(*key, "h", "w").distinct().join(small(items.select("item", F.col("h").alias("q_h"), F.col("w").alias("q_w"))), (F.col("h") == F.col("q_h")) & (F.col("w") == F.col("q_w")))
    named = own.select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = texts.alias("t").join(runs.alias("r"), same("t", "r"), "left").join(named.alias("i"), same("t", "i"), "left")
    none = lambda kind: F.array().cast(kind)
    found = both.select("t.*", F.coalesce("r.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("i.items", none("array<string>")).alias("items"), F.coalesce("r.runs", none("array<struct<at:int,to:int>>")).alias("runs"))
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "runs", F.col("sha").alias("text_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, without what the benchmark holds: ``remove`` is "spans" (the hit words with what follows
    each, up to the next word, are cut out of the text) or "documents" (rows with a hit go). Rows as in ``benchmark_hits``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError('remove must be "spans" or "documents"')
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("doc_id").alias("q_id"), F.col("text_sha256").alias("q_sha"), F.col("runs").alias("q_runs")).dropDuplicates(["q_id", "q_sha"])
    # the columns of docs travel in a struct, so their names cannot clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"), F.col(f"`{id_col}`").cast("long").alias("q_doc"), F.sha2(F.col(f"`{text_col}`").cast("binary"), 256).alias("q_text"))
    met = rows.join(hits, F.col("q_doc").eqNullSafe(F.col("q_id")) & (F.col("q_text") == F.col("q_sha")), "left")
    if remove == "documents":
        return met.where(F.col("q_sha").isNull()).select("q_row.*")
    pieces = F.regexp_extract_all(F.col("q_row")[text_col], F.lit(_PIECE), 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("q_runs", lambda r: (i + 1 >= r["at"]) & (i + 1 <= r["to"])))
    text = F.when(F.col("q_sha").isNull(), F.col("q_row")[text_col]).otherwise(F.array_join(kept, ""))
    return met.select(*(text.alias(c) if c == text_col else F.col("q_row")[c].alias(c) for c in docs.columns))


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x != '')"
ORACLE_SQL = rf"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SPLIT} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), {SIZE}) AS n, unnest(range(1, len(ws) - least(len(ws), {SIZE}) + 2)) AS i FROM items WHERE len(ws) > 0)
), docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
spots AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT r, s.n, i, item FROM spots s JOIN windows USING (n, w)),
positions AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN positions USING (r) LEFT JOIN named USING (r)
"""
