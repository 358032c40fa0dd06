"""Dictionary, document frequency and feature partitions over the long form (doc_idx, label, pos, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import row_numbers
from ..functions.tokens import is_class, tokens


def item_dictionary(long: DataFrame, classes: int = 2) -> DataFrame:
    """item, item_id: dense ids by first appearance, after the ids of the classes."""
    first = long.groupBy("item").agg(F.min(F.struct("doc_idx", "pos")).alias("first"))
    return row_numbers(first.select("item", "first.*"), "n", ["doc_idx", "pos"]).select("item", (F.col("n") + classes).alias("item_id"))


def extended(dictionary: DataFrame, long: DataFrame) -> DataFrame:
    """``dictionary`` (item, item_id, ...) and, behind its ids, the items of ``long`` that it lacks, by first appearance.

    Ids that were given never change, so a dictionary can be extended batch by batch; other columns are null for new items.
    """
    new = long.join(dictionary.select("item"), "item", "left_anti").groupBy("item").agg(F.min(F.struct("doc_idx", "pos")).alias("first"))
    top = dictionary.agg(F.coalesce(F.max("item_id") + 1, F.lit(0)).alias("top"))
    more = row_numbers(new.select("item", "first.*"), "n", ["doc_idx", "pos"]).join(F.broadcast(top))
    return dictionary.unionByName(more.select("item", (F.col("n") + F.col("top")).cast("long").alias("item_id")), allowMissingColumns=True)


def encode(long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``long`` with item_id in place of the item; items that the dictionary lacks go."""
    return long.join(dictionary, "item").select("doc_idx", "label", "pos", "item_id")


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return encoded.join(dictionary, "item_id").select("doc_idx", "label", "pos", "item")


#: Documents whose numbers one row of the inverted lists covers.
BLOCK = 1 << 16


def inverted_lists(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """item, block, n, first_doc, last_doc, doc_list: documents numbered from 1, joined by commas.

    A list is cut into blocks of ``block`` consecutive documents, so no row grows with the number of documents.
    """
    return long.groupBy("item", F.floor(F.col("doc_idx") / block).alias("block")).agg(F.count("*").alias("n"), (F.min("doc_idx") + 1).alias("first_doc"), (F.max("doc_idx") + 1).alias("last_doc"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_idx")), lambda x: (x + 1).cast("string")), ",").alias("doc_list"))


def class_counts(docs: DataFrame) -> DataFrame:
    """label, n over documents (doc_idx, label), those without items included."""
    return docs.groupBy("label").agg(F.count("*").alias("n"))


def class_token_counts(lines: DataFrame) -> DataFrame:
    """label, n: class tokens of the lines; one that a line repeats counts every time."""
    found = lines.select(F.explode(F.filter(F.slice(tokens(F.col("line")), 2, 1 << 30), lambda t: is_class(t))).alias("token"))
    return found.groupBy(F.substring("token", 7, 9).cast("int").alias("label")).agg(F.count("*").alias("n"))


def item_df(long: DataFrame) -> DataFrame:
    """item, df: documents that hold the item."""
    return long.groupBy("item").agg(F.count("*").alias("df"))


def feature_order(spark: SparkSession, positions: int = 64) -> DataFrame:
    """rank, pos: the stand-in for a ranking file, a fixed permutation of the positions; a small table."""
    pos = F.col("id").cast("int")
    return spark.range(1, positions + 1).select((F.row_number().over(Window.orderBy((pos * 37) % (positions + 1))) - 1).alias("rank"), pos.alias("pos"))


def chi_square_order(long: DataFrame, classes: int = 2) -> DataFrame:
    """rank (from 0), pos, chi2: positions by the chi-square statistic of their items and the class, the best first.

    Every position is held against the classes of its own documents; of equal values (to nine digits) the lower position comes
    first. The result has as many rows as there are positions.
    """
    own = long.groupBy("pos", "item").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == c).alias(f"n_c{c}") for c in range(classes)))
    total = long.groupBy("pos").agg(F.count("*").alias("all"), *(F.count_if(F.col("label") == c).alias(f"all_c{c}") for c in range(classes)))
    both = own.join(total, "pos")
    terms = []
    for c in range(classes):
        expected = F.col("n") * F.col(f"all_c{c}") / F.col("all")
        terms.append(F.when(expected > 0, (F.col(f"n_c{c}") - expected) * (F.col(f"n_c{c}") - expected) / expected).otherwise(0.0))
    chi2 = both.groupBy("pos").agg(F.round(F.sum(sum(terms[1:], terms[0])), 9).alias("chi2"))
    return row_numbers(chi2.withColumn("minus", -F.col("chi2")), "rank", ["minus", "pos"]).select("rank", "pos", "chi2")


def feature_partitions(long: DataFrame, order: DataFrame, partitions: int) -> DataFrame:
    """part, doc_idx, label, pos, item: rank k goes to partition k modulo ``partitions``; other positions to none."""
    if partitions < 1:
        raise ValueError("at least one partition")
    return long.join(F.broadcast(order), "pos").select((F.col("rank") % partitions).alias("part"), "doc_idx", "label", "pos", "item")


def in_every_part(docs: DataFrame, partitions: int) -> DataFrame:
    """part and the columns of ``docs``, for every partition: a document may have no item in some of them."""
    return docs.select(F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("part"), *docs.columns)


def part_documents(parted: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """part, doc_idx, label, items (sorted). With ``every`` (part, doc_idx, label) documents without items there have none."""
    found = parted.groupBy("part", "doc_idx", "label").agg(F.sort_array(F.collect_list("item")).alias("items"))
    if every is None:
        return found
    both = every.select("part", "doc_idx", "label").join(found.drop("label"), ["part", "doc_idx"], "left")
    return both.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def doc_df_sum(parted: DataFrame, df: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """part, doc_idx, df_sum: the document frequencies (over all items) of the partition's items of a document.

    With ``every`` (part, doc_idx) documents without items there have the sum 0.
    """
    found = parted.join(df, "item").groupBy("part", "doc_idx").agg(F.sum("df").alias("df_sum"))
    if every is None:
        return found
    return every.select("part", "doc_idx").join(found, ["part", "doc_idx"], "left").withColumn("df_sum", F.coalesce("df_sum", F.lit(0).cast("long")))


def most_representative(sums: DataFrame) -> DataFrame:
    """part, doc_idx, df_sum: the largest sum, of ties the greatest document."""
    return sums.groupBy("part").agg(F.max_by(F.struct("doc_idx", "df_sum"), F.struct("df_sum", "doc_idx")).alias("x")).select("part", "x.doc_idx", "x.df_sum")


def current_items(parted: DataFrame, chosen: DataFrame) -> DataFrame:
    """part, item: the items of the chosen documents (part, doc_idx)."""
    return parted.join(chosen.select("part", "doc_idx").distinct(), ["part", "doc_idx"], "left_semi").select("part", "item").distinct()


def project_on(parted: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of ``parted`` whose item is current in its partition."""
    return parted.join(current, ["part", "item"], "left_semi")


def projected_sizes(parted: DataFrame, current: DataFrame, every: DataFrame) -> DataFrame:
    """part, doc_idx, n_projected: the current items of every document of ``every`` (part, doc_idx), 0 included."""
    found = project_on(parted, current).groupBy("part", "doc_idx").agg(F.count("*").alias("n_projected"))
    return every.select("part", "doc_idx").join(found, ["part", "doc_idx"], "left").withColumn("n_projected", F.coalesce("n_projected", F.lit(0).cast("long")))
