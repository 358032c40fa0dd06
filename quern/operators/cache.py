"""A stored cache of itemset supports for lazy classification.

The test documents of one batch after the other ask for the supports of their itemsets in the same training documents.
The cache is a table in the shared folder, keyed by itemset; a batch reads what is there by a join, counts only what is
missing, and writes the next version of the table. It is bounded: itemsets that were asked for longest ago go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import row_numbers
from ..sources.storage import Folder, saved
from . import bitmaps as B
from .rules import reaches

_KEYS = ["s1", "s2", "s3"]


class RuleCache:
    """Supports of itemsets in the training documents ``train`` (doc_idx, label, items).

    ``version`` names the state of the training documents: a cache of another version in the same folder is not read, and
    its table is deleted. At most ``most`` itemsets stay. ``batches`` lists what every batch asked for: itemsets, those that
    were there, those that were counted, and those that the table kept.
    """

    def __init__(self, spark: SparkSession, path: str, train: DataFrame, version: str, sizes: range, most: int = 10_000_000, classes: int = 2):
        self.folder, self.sizes, self.most, self.classes = Folder(spark, f"{path}/{version}"), sizes, most, classes
        self.spark, self.names = spark, [f"n_c{c}" for c in range(classes)]
        parent = Folder(spark, path)
        for other in parent.names():
            if other != version:
                parent.delete(other)
        if not self.folder.exists("items"):
            B.item_ids(train).write.mode("overwrite").parquet(self.folder.path("items"))
        self.ids = spark.read.parquet(self.folder.path("items"))
        self.train = train
        self._parts: DataFrame | None = None
        self.number = self.folder.last("table")
        self.batches: list[dict] = [self.folder.read(f"table-{self.number}")] if self.number else []

    def _segments(self) -> DataFrame:
        """Made when the first itemset is missing."""
        if self._parts is None:
            own = B.with_ids(self.train, self.ids, ["doc_idx", "label"])
            self._parts = B.segments(own.select(F.lit(0).alias("part"), "*"), self.classes)
        return self._parts

    def _table(self) -> DataFrame:
        schema = "s1 long, s2 long, s3 long, " + ", ".join(f"{c} long" for c in self.names) + ", n long, used long"
        return self.spark.read.schema(schema).parquet(self.folder.path(f"table-{self.number}")) if self.number else self.spark.createDataFrame([], schema)

    def rules(self, test: DataFrame, min_conf: float = 0.001, min_sup: int = 1) -> DataFrame:
        """As ``scoring.lazy_rules`` over ``test`` (test_idx, items); rows of the next table version are written on the way."""
        own = B.with_ids(test.select(F.col("test_idx").cast("long").alias("doc_idx"), "items"), self.ids, ["doc_idx"]).select(F.lit(0).alias("part"), "*")
        asked = saved(B.subset_rows(own, self.sizes))
        distinct = saved(asked.select(*_KEYS).distinct())
        here = self._table()
        missing = saved(distinct.join(here, _KEYS, "left_anti"))
        n_asked, n_missing = distinct.count(), missing.count()
        every = here
        if n_missing:
            counted = B.counted_sets(missing.select(F.lit(0).alias("part"), *_KEYS), self._segments(), self.classes)
            every = here.unionByName(counted.select(*_KEYS, *self.names, "n", F.lit(0).cast("long").alias("used")))
        now = self.number + 1
        marked = saved(every.join(distinct.withColumn("now", F.lit(now).cast("long")), _KEYS, "left").select(*_KEYS, *self.names, "n", F.coalesce("now", "used").alias("used")))
        kept = marked
        if marked.count() > self.most:  # the latest, then the smaller itemsets, which more documents share
            kept = row_numbers(marked.withColumn("ago", -F.col("used")), "place", ["ago", "s3", "s2", "s1"]).where(F.col("place") < self.most).select(marked.columns)
        kept.write.mode("overwrite").parquet(self.folder.path(f"table-{now}"))
        self.batches.append({"batch": now, "asked": n_asked, "there": n_asked - n_missing, "counted": n_missing, "kept": min(marked.count(), self.most)})
        self.folder.commit(f"table-{now}", self.batches[-1])
        self.folder.delete(f"table-{self.number}")
        self.number = now
        rows = asked.join(marked.where("n > 0").hint("merge"), _KEYS).where((F.col("s2") == 0) | (F.col("n") >= min_sup))
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"n_c{c}").alias("n_c")) for c in range(self.classes))))
        found = rows.select(F.col("doc_idx").alias("test_idx"), "n", each.alias("x")).where(reaches(F.col("x.n_c"), F.col("n"), min_conf))
        sums = found.groupBy("test_idx", "x.label").agg(F.count("*").alias("n_rules"), F.sum(F.col("x.n_c") / F.col("n")).alias("sum_conf"))
        grid = test.select("test_idx", F.explode(F.array(*(F.lit(c) for c in range(self.classes)))).alias("label"))
        return grid.join(sums, ["test_idx", "label"], "left").select("test_idx", "label", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("sum_conf", F.lit(0.0)).alias("sum_conf"))
