"""The registered queries, over the transactions that ``sources.transactions`` derives from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.combinatorics import binomial, combinations, primes
from ..functions.tokens import class_label, items, leading_int, tokens
from ..operators import bitmaps as B
from ..operators import items as I
from ..operators import rules as R
from ..operators import scoring as S
from ..operators.cache import RuleCache
from ..sources import transactions as T
from ..sources.lines import read_ranges, write_ordered
from ..sources.storage import saved, shared_dir
from ..streaming.evaluation import running_metrics
from .sampling import diagnostics, measured, partition_summary, reduced_set, selective_sampling

PARTITIONS, SPARSE_PARTITIONS = 5, 2
MIN_CONF, MIN_SUP, MAX_SIZE = 0.001, 1, 4
SIZES = R.antecedents(MAX_SIZE)
#: Support of ``itemset_levels``.
LEVEL_SUP = 5
#: Test line whose id ``scan_test_stop`` makes 0.
STOP = 300

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_idx", "label", F.size("items").alias("n_items"), F.array_join("items", " ").alias("items_text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over the embeddings, with the first item given twice: line_no, line."""
    docs = T.documents(T.tx_embeddings(spark, sf_dir))
    line = F.concat_ws(" ", (F.col("doc_idx") + 1).cast("string"), F.concat(F.lit("CLASS="), F.col("label").cast("string")), F.array_join("items", " "), F.col("items")[0])
    return docs.select(F.col("doc_idx").alias("line_no"), line.alias("line"))


def _parted(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """The embeddings by feature partition, saved: most queries read them more than once."""
    return saved(I.feature_partitions(T.tx_embeddings(spark, sf_dir), I.feature_order(spark), partitions))


def _df(parted: DataFrame) -> DataFrame:
    """Document frequencies; each item is in one partition only."""
    return I.item_df(parted)


class _Numbered:
    """All documents by partition with their items as numbers: ``every`` (part, doc_idx), ``docs`` (with label and ids), ``ids``."""

    def __init__(self, parted: DataFrame):
        docs = saved(I.part_documents(parted))
        self.every = docs.select("part", "doc_idx")
        self.ids = B.item_ids(docs)
        self.docs = saved(B.with_ids(docs, self.ids, ["part", "doc_idx", "label"]))

    def supports(self, sizes: range) -> DataFrame:
        return B.tree_supports(B.segments(self.docs), sizes)


def _counts(parted: DataFrame, sizes: range = SIZES, min_conf: float = MIN_CONF, min_sup: int = MIN_SUP) -> DataFrame:
    """Rule counts of all documents against all, which selective sampling takes on the embeddings."""
    found = _Numbered(parted)
    matched = B.table_rules(found.docs.withColumnRenamed("doc_idx", "asks"), found.docs, sizes, min_conf, min_sup)
    if matched is not None:
        return R.summed_rules(found.every, matched.withColumnRenamed("asks", "doc_idx"))
    rules = B.level_supports(found.docs, range(1, sizes.stop), min_sup) if min_sup > 1 else found.supports(range(1, sizes.stop))
    wide = rules.select("part", "size", "n", "n_c0", "n_c1", *(F.col(f"s{k}") if k < sizes.stop else F.lit(0).cast("long").alias(f"s{k}") for k in (1, 2, 3)))
    return R.rule_counts(found.every, found.docs, wide, sizes, min_conf, min_sup)


class _Sparse:
    """The sparse documents by partition: ``every`` (part, doc_idx, label), ``parted``, ``sums`` and ``docs``."""

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: int = SPARSE_PARTITIONS):
        self.wide = saved(T.sparse_documents(spark, sf_dir))
        long = T.doc_items(self.wide)
        self.parted = long.select(((F.col("pos") - 1) % partitions).alias("part"), "doc_idx", "label", "pos", "item")
        self.every = I.in_every_part(self.wide.select("doc_idx", "label"), partitions)
        self.docs = I.part_documents(self.parted, self.every)
        self.sums = I.doc_df_sum(self.parted, I.item_df(long), self.every)

    def sampled(self, log: str | None = None) -> DataFrame:
        return selective_sampling(self.docs, self.sums, MIN_CONF, MIN_SUP, MAX_SIZE, log=log)


@query
def scan_transactions(spark, sf_dir):
    return _text(T.documents(T.tx_embeddings(spark, sf_dir)))


@query
def scan_transactions_documents(spark, sf_dir):
    return _text(T.documents(T.tx_documents(spark, sf_dir)))


@query
def scan_transactions_orders(spark, sf_dir):
    return _text(T.documents(T.tx_orders(spark, sf_dir)))


@query
def tokenize(spark, sf_dir):
    t = tokens(F.col("line"))
    return _lines(spark, sf_dir).select(F.col("line_no").alias("doc_idx"), leading_int(t[0]).alias("qid"), F.posexplode(t).alias("pos", "token"))


@query
def class_extract(spark, sf_dir):
    t = tokens(F.col("line"))
    return _lines(spark, sf_dir).select(F.col("line_no").alias("doc_idx"), class_label(t).alias("label"))


@query
def dedup_items(spark, sf_dir):
    t = tokens(F.col("line"))
    return _lines(spark, sf_dir).select(F.col("line_no").alias("doc_idx"), (F.size(t) - 2).alias("n_before"), F.size(items(t)).alias("n_after"))


@query
def item_dictionary(spark, sf_dir):
    return I.item_dictionary(T.tx_embeddings(spark, sf_dir))


@query
def encode_decode(spark, sf_dir):
    long = T.tx_embeddings(spark, sf_dir)
    ids = I.item_dictionary(long)
    return I.decode(I.encode(long, ids), ids)


@query
def extended_dictionary(spark, sf_dir):
    """Customers and days of the orders: those of the training lines, then new ones of two batches of test lines, with count 0."""
    long = saved(T.order_days(spark, sf_dir))
    train = long.where(F.col("doc_idx") % 5 != 0)
    found = I.item_dictionary(train).join(I.item_df(train), "item")
    for rest in (0, 5):
        found = saved(I.extended(found, long.where(F.col("doc_idx") % 10 == rest)))
    return found.select("item", "item_id", F.coalesce("df", F.lit(0).cast("long")).alias("n"))


@query
def inverted_lists(spark, sf_dir):
    return I.inverted_lists(T.tx_embeddings(spark, sf_dir))


@query
def class_counts(spark, sf_dir):
    return I.class_counts(T.embedding_rows(spark, sf_dir))


@query
def class_counts_orders(spark, sf_dir):
    return I.class_counts(T.order_rows(spark, sf_dir))


@query
def class_counts_sparse(spark, sf_dir):
    """Documents without items count, too."""
    return I.class_counts(T.sparse_documents(spark, sf_dir))


@query
def class_token_counts(spark, sf_dir):
    """Every seventh line names its class twice, and both count."""
    twice = F.when(F.col("line_no") % 7 == 0, F.concat(F.lit(" "), F.regexp_extract("line", "CLASS=[01]", 0))).otherwise("")
    return I.class_token_counts(_lines(spark, sf_dir).withColumn("line", F.concat("line", twice)))


@query
def scan_test(spark, sf_dir):
    """Every fifth document is a test line, here and in the lazy queries."""
    found = T.parse_test(_lines(spark, sf_dir).where(F.col("line_no") % 5 == 0))
    return found.select("test_idx", "label", F.array_join("items", " ").alias("items_text"))


@query
def scan_test_stop(spark, sf_dir):
    """Reading stops at the line whose id is 0."""
    lines = _lines(spark, sf_dir).where(F.col("line_no") % 5 == 0)
    found = T.parse_test(lines.withColumn("line", F.when(F.col("line_no") == STOP, F.regexp_replace("line", "^[0-9]+", "0")).otherwise(F.col("line"))))
    return found.select("test_idx", "label", F.array_join("items", " ").alias("items_text"))


@query
def text_round_trip(spark, sf_dir):
    """Lines written as text files and read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    T.write_lines(_lines(spark, sf_dir), path, "line_no")
    return T.read_training(spark, path).select("doc_idx", "qid", "label", F.size("items").alias("n_items"), F.array_join("items", " ").alias("items_text"))


@query
def text_ranges_round_trip(spark, sf_dir):
    """Lines written by the committing sink and read back in byte ranges that cut lines."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    write_ordered(_lines(spark, sf_dir), path, "line_no")
    return T.parse_training(read_ranges(spark, path, 10_000)).select("doc_idx", "qid", "label", F.size("items").alias("n_items"), F.array_join("items", " ").alias("items_text"))


@query
def line_count(spark, sf_dir):
    return _lines(spark, sf_dir).agg(F.count("*").alias("n"))


@query
def validate_bounds(spark, sf_dir):
    """The fixed limits that the data need not keep here: checks, not errors."""
    long = T.tx_embeddings(spark, sf_dir)
    size = long.groupBy("doc_idx").count().agg(F.max("count").alias("m"))
    checks = [("lines", long.select("doc_idx").distinct().agg(F.count("*").alias("m")), 1200), ("features", size, 65), ("items", long.select("item").distinct().agg(F.count("*").alias("m")), 651)]
    out = [rows.select(F.lit(name).alias("check"), (F.col("m") <= most).alias("ok")) for name, rows, most in checks]
    return out[0].union(out[1]).union(out[2])


@query
def feature_order(spark, sf_dir):
    return I.feature_order(spark)


@query
def feature_order_file(spark, sf_dir):
    """Positions by chi-square, written to an order file and read back."""
    path = f"{shared_dir(spark)}/order-{uuid.uuid4().hex}"
    T.write_feature_order(I.chi_square_order(T.tx_embeddings(spark, sf_dir)), path)
    return T.read_feature_order(spark, path)


@query
def chi_square_order(spark, sf_dir):
    return I.chi_square_order(T.tx_embeddings(spark, sf_dir)).select("rank", "pos", F.round("chi2", 6).alias("chi2"))


@query
def ranked_subsets(spark, sf_dir):
    """The subsets of one to four items of every order by rank, at most three in a piece."""
    docs = T.order_rows(spark, sf_dir).select(F.lit(0).alias("part"), "doc_idx", "label", "items")
    ids = B.item_ids(docs)
    found = B.ranked_subsets(B.with_ids(docs, ids, ["part", "doc_idx"]), range(1, 5), 3)
    return found.select("doc_idx", "size", "rank", F.array_join("members", ",").alias("members"))


@query
def feature_partitions(spark, sf_dir):
    docs = I.part_documents(_parted(spark, sf_dir))
    return docs.select("part", "doc_idx", F.size("items").alias("n_items"), F.array_join("items", " ").alias("items_text"))


@query
def item_df(spark, sf_dir):
    return I.item_df(T.tx_embeddings(spark, sf_dir))


@query
def item_df_orders(spark, sf_dir):
    return I.item_df(T.tx_orders(spark, sf_dir))


@query
def doc_df_sum(spark, sf_dir):
    parted = _parted(spark, sf_dir)
    return I.doc_df_sum(parted, _df(parted))


@query
def doc_df_sum_sparse(spark, sf_dir):
    return _Sparse(spark, sf_dir).sums


@query
def most_representative(spark, sf_dir):
    parted = _parted(spark, sf_dir)
    return I.most_representative(I.doc_df_sum(parted, _df(parted)))


@query
def most_representative_orders(spark, sf_dir):
    long = T.tx_orders(spark, sf_dir)
    return I.most_representative(I.doc_df_sum(long.withColumn("part", F.lit(0)), I.item_df(long)))


@query
def current_items(spark, sf_dir):
    parted = _parted(spark, sf_dir)
    return I.current_items(parted, parted)


@query
def current_items_sparse(spark, sf_dir):
    """The items of the seeds."""
    found = _Sparse(spark, sf_dir)
    return I.current_items(found.parted, I.most_representative(found.sums))


@query
def project_on_current(spark, sf_dir):
    parted = _parted(spark, sf_dir)
    return I.projected_sizes(parted, I.current_items(parted, parted), parted.select("part", "doc_idx").distinct())


@query
def project_on_current_sparse(spark, sf_dir):
    """On the items of the seeds; documents that have none of them count 0."""
    found = _Sparse(spark, sf_dir)
    return I.projected_sizes(found.parted, I.current_items(found.parted, I.most_representative(found.sums)), found.every)


def _itemsets(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    found = _Numbered(_parted(spark, sf_dir))
    return R.named(found.supports(range(size, size + 1)), found.ids, size)


@query
def itemsets2_support(spark, sf_dir):
    return _itemsets(spark, sf_dir, 2)


@query
def itemsets3_support(spark, sf_dir):
    return _itemsets(spark, sf_dir, 3)


@query
def rules_size2(spark, sf_dir):
    found = _Numbered(_parted(spark, sf_dir))
    return R.rules_size2(found.supports(range(1, 2)), found.ids)


@query
def rule_count_size2(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), range(1, 2))


@query
def rule_count_size3(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), range(2, 3))


@query
def rule_count_size4(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), range(3, 4))


@query
def rule_counts(spark, sf_dir):
    return _counts(_parted(spark, sf_dir))


@query
def rules_min_conf(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), min_conf=0.5)


@query
def rules_min_sup(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), min_sup=3)


@query
def rules_min_sup_8(spark, sf_dir):
    return _counts(_parted(spark, sf_dir), min_sup=8)


@query
def itemset_levels(spark, sf_dir):
    """Candidates and frequent itemsets at every size, for the support 5."""
    return B.level_counts(_Numbered(_parted(spark, sf_dir)).docs, LEVEL_SUP)


@query
def least_representative(spark, sf_dir):
    parted = _parted(spark, sf_dir)
    return R.least_representative(_counts(parted), I.doc_df_sum(parted, _df(parted)))


@query
def bitmap_support(spark, sf_dir):
    return _itemsets(spark, sf_dir, 2).select("part", "a", "b", "n")


def _sampled(spark: SparkSession, sf_dir: str, rounds: int | None = None) -> DataFrame:
    parted = _parted(spark, sf_dir)
    return selective_sampling(I.part_documents(parted), I.doc_df_sum(parted, _df(parted)), MIN_CONF, MIN_SUP, MAX_SIZE, rounds=rounds)


@query
def sampling_step_k(spark, sf_dir):
    """The seed and two rounds."""
    return _sampled(spark, sf_dir, 2).where("not repeated").select("part", "step", "doc_idx", "rules")


@query
def selective_sampling_run(spark, sf_dir):
    """Over the embeddings: 500 rounds a partition at sf0.01, for which SQL needs minutes; it has none."""
    return _sampled(spark, sf_dir).where("not repeated").select("part", "step", "doc_idx")


@query
def selective_sampling_sparse(spark, sf_dir):
    return _Sparse(spark, sf_dir).sampled().select("part", "step", "doc_idx", "rules", "repeated")


@query
def selective_sampling_p1(spark, sf_dir):
    """One partition over all positions."""
    return _Sparse(spark, sf_dir, 1).sampled().select("part", "step", "doc_idx", "rules", "repeated")


@query
def partition_summaries(spark, sf_dir):
    return partition_summary(_Sparse(spark, sf_dir).sampled())


@query
def run_diagnostics(spark, sf_dir):
    """Figures of a run over its documents, and those that were measured while it ran."""
    found, log = _Sparse(spark, sf_dir), f"{shared_dir(spark)}/sampling-{uuid.uuid4().hex}"
    own = diagnostics(found.docs, saved(found.sampled(log)))
    run = measured(spark, log).where("metric not in ('seconds', 'looks')").select("metric", F.lit(-1).alias("part"), F.col("value").cast("long").alias("value"))
    return own.unionByName(run)


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Sparse(spark, sf_dir)
    return found.wide.join(reduced_set(found.sampled()), "doc_idx")


@query
def reduced_documents(spark, sf_dir):
    return _reduced(spark, sf_dir).select("doc_idx", "label")


@query
def reduced_set_lines(spark, sf_dir):
    """In the order of the rows."""
    return T.to_lines(_reduced(spark, sf_dir)).orderBy("doc_idx")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test documents over all positions; every fifth document is a test."""
    docs = saved(T.documents(T.tx_embeddings(spark, sf_dir)))
    test = docs.where(F.col("doc_idx") % 5 == 0).select(F.floor(F.col("doc_idx") / 5).alias("test_idx"), "label", "items")
    return docs.where(F.col("doc_idx") % 5 != 0), test


def _lazy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test documents, their rules, scores of the classes)."""
    train, test = _split(spark, sf_dir)
    rules = saved(S.lazy_rules(train, test, SIZES))
    return test, rules, S.class_scores(rules)


def _cached(spark: SparkSession, sf_dir: str) -> tuple[RuleCache, list[DataFrame]]:
    """The orders as two batches of test documents, every tenth and then every fifth, asking one cache; its answers."""
    docs = saved(T.order_rows(spark, sf_dir))
    train = docs.where(F.col("doc_idx") % 5 != 0)
    cache = RuleCache(spark, f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}", train, "v1", SIZES)
    test = lambda step: docs.where(F.col("doc_idx") % step == 0).select(F.floor(F.col("doc_idx") / 5).alias("test_idx"), "items")
    return cache, [saved(cache.rules(test(step))) for step in (10, 5)]


@query
def rule_cache_batches(spark, sf_dir):
    """What each of two batches asked the cache for: the second one counts only what the first one did not."""
    cache = _cached(spark, sf_dir)[0]
    return spark.createDataFrame(cache.batches, "batch long, asked long, there long, counted long, kept long")


@query
def cached_lazy_rules(spark, sf_dir):
    """Lazy rules of the orders by way of the cache."""
    return _cached(spark, sf_dir)[1][1].withColumn("sum_conf", F.round("sum_conf", 6))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, rules, scores = _lazy(spark, sf_dir)
    return S.predictions(test, rules, S.ordered_labels(scores))


@query
def lazy_rules(spark, sf_dir):
    return _lazy(spark, sf_dir)[1].withColumn("sum_conf", F.round("sum_conf", 6))


@query
def class_scores(spark, sf_dir):
    return _lazy(spark, sf_dir)[2].withColumn("score", F.round("score", 6))


@query
def ordered_labels(spark, sf_dir):
    return S.ordered_labels(_lazy(spark, sf_dir)[2])


@query
def lazy_predictions(spark, sf_dir):
    return _predicted(spark, sf_dir)


@query
def ranking_score(spark, sf_dir):
    return S.ranking_score(_lazy(spark, sf_dir)[2]).withColumn("value", F.round("value", 6))


@query
def prediction_entropy(spark, sf_dir):
    return S.prediction_entropy(_lazy(spark, sf_dir)[2]).withColumn("value", F.round("value", 6))


@query
def prediction_lines(spark, sf_dir):
    test, rules, scores = _lazy(spark, sf_dir)
    return S.prediction_lines(S.predictions(test, rules, S.ordered_labels(scores)), S.ranking_score(scores), S.prediction_entropy(scores))


@query
def eval_counts(spark, sf_dir):
    return S.eval_counts(_predicted(spark, sf_dir))


@query
def eval_per_class(spark, sf_dir):
    found = S.eval_per_class(S.eval_counts(_predicted(spark, sf_dir)))
    return found.select("label", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query
def eval_summary(spark, sf_dir):
    found = S.eval_summary(S.eval_counts(_predicted(spark, sf_dir)))
    return found.select(*(F.round(c, 6).alias(c) for c in ("acc", "macro_f1")))


@query
def eval_running(spark, sf_dir):
    found = S.eval_running(_predicted(spark, sf_dir))
    return found.select("seq", *(F.round(c, 6).alias(c) for c in ("acc", "macro_f1")))


@query
def eval_running_stream(spark, sf_dir):
    """``eval_running`` as a stream: predictions come in three micro-batches, one after the other, and every one is answered."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = saved(_predicted(spark, sf_dir).select(F.lit(0).alias("evaluator"), "test_idx", "label", "prediction"))
    last = found.agg(F.max("test_idx")).first()[0] or 0
    for k in range(3):
        found.where((F.col("test_idx") * 3 >= k * (last + 1)) & (F.col("test_idx") * 3 < (k + 1) * (last + 1))).coalesce(1).write.parquet(f"{path}/in/{k}")
        stream = spark.readStream.schema(found.schema).parquet(f"{path}/in/*")
        run = running_metrics(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()  # the stream is stopped and started again for every batch, and goes on with its counts
    return spark.read.schema("seq long, acc double, macro_f1 double").parquet(f"{path}/out").select("seq", F.round("acc", 6).alias("acc"), F.round("macro_f1", 6).alias("macro_f1"))


@query
def combinations_k(spark, sf_dir):
    return combinations(spark, 20, 3)


@query
def binomial_table(spark, sf_dir):
    n = spark.range(1, 65).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    return n.select("n", "k", binomial(F.col("n"), F.col("k")).alias("c"))


@query
def prime_numbers(spark, sf_dir):
    return primes(spark, 99_960)
