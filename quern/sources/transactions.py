"""Text and Parquet sources and text sinks of labelled transactions.

A line is ``<id> CLASS=<k> <item> <item> ...``. The last line counts with or without a newline at its end, and blank
lines are skipped. The wide form has one row per document (doc_idx, qid, label, items); the long form, ``doc_items``,
has one row per item (doc_idx, label, pos, item), positions from 1 over the distinct items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import ntile, row_numbers
from ..functions.tokens import class_label, items, leading_int, tokens

BINS = 10


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, blank lines counted) and line of a text file or folder; files follow each other by path."""
    lines = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start")
    block = ["file_path", "file_block_start"]
    # a task reads the lines of a block one after the other; one row per block
    sizes = lines.groupBy(*block).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = sizes.select(*block, "first", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(*block)) - F.col("n")).alias("before"))
    return lines.join(before, block).select((F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "line")


def parse_training(lines: DataFrame) -> DataFrame:
    """doc_idx, qid, label, items of the lines (line_no, line). A line without a class is an error."""
    found = lines.withColumn("t", tokens(F.col("line"))).where(F.size("t") > 0)
    label = class_label(F.col("t"), last=True)
    checked = F.when(label >= 0, label).otherwise(F.raise_error(F.concat(F.lit("no class in line "), F.col("line_no").cast("string"))).cast("int"))
    wide = found.select("line_no", leading_int(F.get("t", F.lit(0))).alias("qid"), checked.alias("label"), items(F.col("t")).alias("items"))
    return row_numbers(wide, "doc_idx", ["line_no"]).select("doc_idx", "qid", "label", "items")


def parse_test(lines: DataFrame) -> DataFrame:
    """test_idx, label (-1: none), items (sorted). Reading stops at the first line whose id is 0 or not a number."""
    found = lines.withColumn("t", tokens(F.col("line"))).where(F.size("t") > 0).withColumn("qid", leading_int(F.get("t", F.lit(0))))
    stop = found.where("qid = 0").agg(F.min("line_no").alias("stop"))
    kept = found.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    wide = kept.select("line_no", class_label(F.col("t"), last=False).alias("label"), F.array_sort(items(F.col("t"))).alias("items"))
    return row_numbers(wide, "test_idx", ["line_no"]).select("test_idx", "label", "items")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return parse_training(read_lines(spark, path))


def read_test(spark: SparkSession, path: str) -> DataFrame:
    return parse_test(read_lines(spark, path))


def read_feature_order(spark: SparkSession, path: str) -> DataFrame:
    """rank (from 0) and pos (from 1) of a file of positions separated by white space, the best first; a small file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda t: t != "")).alias("rank", "pos")).select("rank", F.col("pos").cast("int").alias("pos"))


def write_feature_order(order: DataFrame, path: str) -> None:
    """Write the positions (rank, pos) as one line, the best first; a row for each feature, so one file."""
    line = order.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda x: x["pos"].cast("string")), " ").alias("value"))
    line.coalesce(1).write.mode("overwrite").text(path)


def to_lines(docs: DataFrame) -> DataFrame:
    """line of each document: row (from 1), class and items, each item followed by a space."""
    return docs.select("doc_idx", F.concat(F.format_string("%d CLASS=%d ", F.col("doc_idx") + 1, F.col("label")), F.array_join(F.transform("items", lambda x: F.concat(x, F.lit(" "))), "")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: str = "doc_idx") -> None:
    """Write the column ``line`` as text, in order across the files."""
    lines.orderBy(order).select("line").write.mode("overwrite").text(path)


def doc_items(docs: DataFrame) -> DataFrame:
    """doc_idx, label, pos, item of wide documents."""
    return docs.select("doc_idx", "label", F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def documents(long: DataFrame) -> DataFrame:
    """doc_idx, label, items (by position) of the long form."""
    return long.groupBy("doc_idx", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_idx, vec_id, label (even or odd), embedding of ``embeddings``."""
    rows = row_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "doc_idx", ["vec_id"])
    return rows.select("doc_idx", "vec_id", (F.col("label") % 2).alias("label"), "embedding")


def tx_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form over ``embeddings``: position d is dimension d, its item the ten-tile of the value; label is even or odd."""
    rows = embedding_rows(spark, sf_dir)
    each = rows.select("doc_idx", "vec_id", "label", F.posexplode("embedding").alias("pos", "v")).withColumn("pos", F.col("pos") + 1)
    bins = row_numbers(each, "n", ["v", "vec_id"], by=["pos"])
    return bins.select("doc_idx", "label", "pos", F.concat(F.lit("f"), F.col("pos").cast("string"), F.lit("="), ntile(F.col("n"), F.col("n_size"), BINS).cast("string")).alias("item"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide form over labelled ``documents``: language, source, length, number of spaces and of line ends; label is the quality."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = F.col("text")
    rows = read("documents").join(read("labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "lang", "source", "n_chars",
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long").alias("spaces"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("ends"),
    )
    rows = row_numbers(row_numbers(row_numbers(rows, "a", ["n_chars", "doc_id"]), "b", ["spaces", "doc_id"]), "doc_idx", ["doc_id"])
    tile = lambda n: ntile(F.col(n), F.col(f"{n}_size"), BINS).cast("string")
    found = F.array(
        F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"), F.concat(F.lit("nchars="), tile("a")),
        F.concat(F.lit("words="), tile("b")), F.concat(F.lit("lines="), F.least(F.lit(9), F.col("ends")).cast("string")),
    )
    return rows.select("doc_idx", "label", found.alias("items"))


def tx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of ``document_rows``."""
    return doc_items(document_rows(spark, sf_dir))


def sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_rows`` without the usual items, so documents have from no to five items."""
    usual = lambda x: x.isin("lang=en", "lines=0") | x.rlike("^(nchars|words)=[0-4]$")
    return document_rows(spark, sf_dir).withColumn("items", F.filter("items", lambda x: ~usual(x)))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide form over ``orders``: priority, month, the customer's segment and nation; label is status F."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = row_numbers(rows, "doc_idx", ["o_orderkey"])
    found = F.array(F.concat(F.lit("prio="), "o_orderpriority"), F.concat(F.lit("month="), F.month("o_orderdate").cast("string")), F.concat(F.lit("seg="), "c_mktsegment"), F.concat(F.lit("nation="), "n_name"))
    return rows.select("doc_idx", (F.col("o_orderstatus") == "F").cast("int").alias("label"), found.alias("items"))


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of ``order_rows``."""
    return doc_items(order_rows(spark, sf_dir))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form over ``orders`` by customer and day: items of which many are rare; label is status F."""
    rows = row_numbers(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), "doc_idx", ["o_orderkey"])
    found = F.array(F.concat(F.lit("cust="), F.col("o_custkey").cast("string")), F.concat(F.lit("day="), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return doc_items(rows.select("doc_idx", (F.col("o_orderstatus") == "F").cast("int").alias("label"), found.alias("items")))
