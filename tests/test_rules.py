"""Goldens traced by hand, and properties."""

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import combinatorics as C
from quern.functions.ranking import ntile, row_numbers
from quern.operators import bitmaps as B
from quern.operators import items as I
from quern.operators import rules as R
from quern.operators import scoring as S
from quern.operators.cache import RuleCache
from quern.plans import sampling
from quern.plans.sampling import partition_summary, reduced_set, selective_sampling
from quern.sources import lines
from quern.sources import transactions as T
from quern.sources.storage import Folder
from quern.streaming.evaluation import eval_counts as stream_eval
from quern.streaming.evaluation import running_metrics, streaming_counts

G1 = ["1 CLASS=0 a1 b1", "2 CLASS=1 a1 b2", "3 CLASS=0 a2 b1", "4 CLASS=1 a1 b1"]


def _docs(spark, tmp_path, lines):
    path = tmp_path / "train.txt"
    path.write_text("\n".join(lines))
    docs = T.read_training(spark, str(path))
    long = T.doc_items(docs)
    order = spark.createDataFrame([(0, 1), (1, 2)], "rank int, pos int")
    parted = I.feature_partitions(long, order, 1)
    return docs, I.part_documents(parted), I.doc_df_sum(parted, I.item_df(long))


def test_sampling_goldens(spark, tmp_path):
    docs, parts, sums = _docs(spark, tmp_path, G1)
    assert {r["doc_idx"]: r["df_sum"] for r in sums.collect()} == {0: 6, 1: 4, 2: 4, 3: 6}
    picks = selective_sampling(parts, sums)
    rows = [(r["step"], r["doc_idx"], r["rules"], r["repeated"]) for r in picks.orderBy("step").collect()]
    assert rows == [(0, 3, 0, False), (1, 2, 1, False), (2, 1, 1, False), (3, 1, 3, True)]
    assert [tuple(r) for r in partition_summary(picks).collect()] == [(0, 3, 1)]
    taken = docs.join(reduced_set(picks), "doc_idx")
    assert [r["line"] for r in T.to_lines(taken).orderBy("doc_idx").collect()] == ["2 CLASS=1 a1 b2 ", "3 CLASS=0 a2 b1 ", "4 CLASS=1 a1 b1 "]


def test_seed_is_counted_twice(spark, tmp_path):
    _, parts, sums = _docs(spark, tmp_path, ["1 CLASS=0 a"])
    picks = selective_sampling(parts, sums)
    assert [r["doc_idx"] for r in picks.orderBy("step").collect()] == [0, 0, 0]
    assert [tuple(r) for r in partition_summary(picks).collect()] == [(0, 2, 0)]
    assert reduced_set(picks).count() == 1


def _sampled_by_hand(rows, sums, min_conf=0.001, min_sup=1):
    """(part, step, doc, rules, repeated), one document after the other."""
    out = []
    for part in sorted({r[0] for r in rows}):
        docs = {d: (label, [x for k in (1, 2, 3) for x in combinations(items, k)]) for p, d, label, items in rows if p == part}
        pick, counts, taken = max(docs, key=lambda d: (sums[part, d], d)), {}, set()
        out.append((part, 0, pick, 0, False))
        while not out[-1][4]:
            label, subsets = docs[pick]
            for x in subsets:
                counts.setdefault(x, [0, 0])[label] += 1
            good = {x: sum(np.float32(c / sum(n)) >= np.float32(min_conf) for c in n) for x, n in counts.items() if len(x) == 1 or sum(n) >= min_sup}
            rules = {d: sum(good.get(x, 0) for x in own) for d, (_, own) in docs.items()}
            pick = min(docs, key=lambda d: (rules[d], sums[part, d], -d))
            out.append((part, len([r for r in out if r[0] == part]), pick, rules[pick], pick in taken))
            taken.add(pick)
    return out


@pytest.mark.parametrize(("min_conf", "min_sup"), [(0.001, 1), (0.4, 3)])
def test_sampling_equals_rounds_by_hand(spark, monkeypatch, tmp_path, min_conf, min_sup):
    """Documents of which some have no item in a partition; tables are written every four rounds; a run that was stopped, even
    while it wrote them, goes on from its log and takes the same documents."""
    monkeypatch.setattr(sampling, "SAVE_EVERY", 4)
    rng = random.Random(8)
    rows = [(part, d, rng.randint(0, 1), sorted({f"{rng.choice('abcdef')}{rng.randint(0, 3)}" for _ in range(rng.choice([0, 2, 4, 5][1 - part :]))})) for part in (0, 1) for d in range(60)]
    docs = spark.createDataFrame(rows, "part int, doc_idx int, label int, items array<string>")
    sums = docs.select("part", "doc_idx", F.size("items").cast("long").alias("df_sum"))
    want = sorted(_sampled_by_hand(rows, {(p, d): len(x) for p, d, _, x in rows}, min_conf, min_sup))
    log = str(tmp_path / "log")
    first = selective_sampling(docs, sums, min_conf, min_sup, rounds=6, log=log)
    assert sorted(map(tuple, first.collect())) == [r for r in want if r[1] <= 6]
    names = {x.name for x in (tmp_path / "log").iterdir()}
    assert {"round-6.json", "version-4.json", "docs-4", "counts-4"} <= names and "docs-0" not in names
    (tmp_path / "log" / "docs-8").mkdir()  # a version that was not committed

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Folder, "delete", stop)
        with pytest.raises(KeyboardInterrupt):
            selective_sampling(docs, sums, min_conf, min_sup, log=log)
    unread = docs.select("part", "doc_idx", "label", F.raise_error(F.lit("the log has them")).cast("array<string>").alias("items"))
    assert sorted(map(tuple, selective_sampling(unread, sums, min_conf, min_sup, log=log).collect())) == want


@pytest.mark.parametrize("lead", [1, 3])
@pytest.mark.parametrize("min_conf,min_sup", [(0.001, 1), (0.6, 2)])
def test_leaders_change_only_the_time(spark, tmp_path, min_conf, min_sup, lead):
    """With a confidence of 0.6 chosen documents take rules away, so the bound on the others falls."""
    rng = random.Random(5)
    rows = [(part, d, rng.randint(0, 1), sorted({f"{rng.choice('abcdef')}{rng.randint(0, 2)}" for _ in range(3)})) for part in (0, 1) for d in range(40)]
    docs = spark.createDataFrame(rows, "part int, doc_idx int, label int, items array<string>")
    sums = docs.select("part", "doc_idx", F.size("items").cast("long").alias("df_sum"))
    want = sorted(_sampled_by_hand(rows, {(p, d): len(x) for p, d, _, x in rows}, min_conf, min_sup))
    log = str(tmp_path / "log")
    assert sorted(map(tuple, selective_sampling(docs, sums, min_conf, min_sup, log=log, lead=lead).collect())) == want
    found = {r["metric"]: r["value"] for r in sampling.measured(spark, log).collect()}
    assert 1 <= found["looks"] <= found["rounds"] == max(step for _, step, *_ in want)


@pytest.mark.parametrize("sets", [None, 20])
def test_rounds_need_no_job_of_their_own(spark, monkeypatch, tmp_path, sets):
    """Every round had a Spark job, so 4,800 rounds a partition ended in no time limit; now looks and versions have them."""
    if sets:  # a look brings two or three documents
        monkeypatch.setattr(sampling, "SETS", sets)
    rng = random.Random(3)
    rows = [(part, d, rng.randint(0, 1), sorted(f"{x}{rng.randint(0, 11)}" for x in "abcd"[: 3 + d % 2])) for part in (0, 1) for d in range(240)]
    docs = spark.createDataFrame(rows, "part int, doc_idx int, label int, items array<string>")
    sums = docs.select("part", "doc_idx", F.size("items").cast("long").alias("df_sum"))
    want = sorted(_sampled_by_hand(rows, {(p, d): len(x) for p, d, _, x in rows}))
    log, group = str(tmp_path / "log"), f"rounds-{sets}"
    spark.sparkContext.setJobGroup(group, group)
    found = selective_sampling(docs, sums, log=log)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, found.collect())) == want
    run = {r["metric"]: r["value"] for r in sampling.measured(spark, log).collect()}
    assert run["rounds"] == max(step for _, step, *_ in want) > 100
    assert jobs < run["rounds"] / 2 if not sets else run["looks"] > 10


def test_changes_with_and_without_a_table(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.choice(np.arange(1, 40), k, replace=False)) for k in (0, 1, 2, 5, 5, 9) * 4]
    start, flat = np.cumsum([0, *map(len, docs)]), np.concatenate(docs)
    every = [x for d in docs[::2] for k in (1, 2, 3) for x in combinations(d.tolist(), k)]
    deltas = rng.integers(-1, 3, len(every))
    total: dict = {}
    for x, d in zip(every, deltas.tolist()):
        total[x] = total.get(x, 0) + d
    want = [sum(total.get(x, 0) for k in (1, 2, 3) for x in combinations(d.tolist(), k)) for d in docs]
    sets = np.array([(*x, 0, 0)[:3] for x in every]).T
    for table, at_once in ((1 << 25, 1 << 22), (0, 30)):
        monkeypatch.setattr(sampling, "_TABLE", table)
        monkeypatch.setattr(sampling, "_AT_ONCE", at_once)
        changes = sampling.Changes(sets, deltas, range(1, 4))
        assert changes.sums(start, flat).tolist() == want
        assert (changes.table is None) == (not table)


def test_documents_without_items(spark):
    docs = spark.createDataFrame([(0, 1, ["a", "b"]), (1, 0, []), (2, 0, ["a"])], "doc_idx int, label int, items array<string>")
    long = T.doc_items(docs)
    parted = long.withColumn("part", F.col("pos") - 1)
    every = I.in_every_part(docs.select("doc_idx", "label"), 2)
    assert sorted((r["part"], r["doc_idx"], r["items"]) for r in I.part_documents(parted, every).collect()) == [(0, 0, ["a"]), (0, 1, []), (0, 2, ["a"]), (1, 0, ["b"]), (1, 1, []), (1, 2, [])]
    assert sorted(tuple(r) for r in I.doc_df_sum(parted, I.item_df(long), every).collect()) == [(0, 0, 2), (0, 1, 0), (0, 2, 2), (1, 0, 1), (1, 1, 0), (1, 2, 0)]
    seeds = I.most_representative(I.doc_df_sum(parted, I.item_df(long), every))
    sizes = I.projected_sizes(parted, I.current_items(parted, seeds), every)
    assert sorted(tuple(r) for r in sizes.collect()) == [(0, 0, 1), (0, 1, 0), (0, 2, 1), (1, 0, 1), (1, 1, 0), (1, 2, 0)]
    assert {r["label"]: r["n"] for r in I.class_counts(docs).collect()} == {0: 2, 1: 1}
    lines = spark.createDataFrame([(0, "1 CLASS=1 a CLASS=1"), (1, "2 CLASS=0 CLASS=1 b")], "line_no long, line string")
    assert {r["label"]: r["n"] for r in I.class_token_counts(lines).collect()} == {0: 1, 1: 3}
    blocks = I.inverted_lists(spark.createDataFrame([(k, 0, 1, "x") for k in range(5)], "doc_idx int, label int, pos int, item string"), block=2)
    assert sorted((r["block"], r["doc_list"]) for r in blocks.collect()) == [(0, "1,2"), (1, "3,4"), (2, "5")]


def _brute(rows, sizes):
    """(part, itemset) -> documents of each class."""
    out = {}
    for part, _, label, items in rows:
        for k in sizes:
            for x in combinations(sorted(items), k):
                out.setdefault((part, x), [0, 0])[label] += 1
    return out


def _random_rows(seed, docs, parts=2, letters="abcdefgh", few=4):
    rng = random.Random(seed)
    return [(p, d, rng.randint(0, 1), sorted({f"{rng.choice(letters)}{rng.randint(0, few)}" for _ in range(rng.randint(0, 7))})) for p in range(parts) for d in range(docs)]


def _named(found, ids, most=3):
    names = {r["id"]: r["item"] for r in ids.collect()} | {0: None}
    return {(r["part"], tuple(names[r[f"s{k}"]] for k in range(1, r["size"] + 1))): [r["n_c0"], r["n_c1"]] for r in found.collect()}


@pytest.mark.parametrize("few", [1, 400])
def test_tree_supports_over_segments(spark, few):
    """Many documents that share items, and few that do, over more segments than one."""
    rows = _random_rows(4, 90, few=few)
    docs = spark.createDataFrame(rows, "part int, doc_idx long, label int, items array<string>")
    ids = B.item_ids(docs)
    parts = B.segments(B.with_ids(docs, ids, ["part", "doc_idx", "label"]), size=32)
    assert parts.count() == 6
    assert _named(B.tree_supports(parts, range(1, 4)), ids) == _brute(rows, (1, 2, 3))


@pytest.mark.parametrize("min_sup", [1, 2, 5, 90])
def test_levels_prune_what_cannot_be_frequent(spark, min_sup, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 40)
    rows = _random_rows(5, 60)
    docs = spark.createDataFrame(rows, "part int, doc_idx long, label int, items array<string>")
    ids = B.item_ids(docs)
    numbered = B.with_ids(docs, ids, ["part", "doc_idx", "label"])
    want = {k: n for k, n in _brute(rows, (1, 2, 3)).items() if len(k[1]) == 1 or sum(n) >= min_sup}
    assert _named(B.level_supports(numbered, range(1, 4), min_sup), ids) == want
    levels = {(r["part"], r["size"]): (r["candidates"], r["frequent"]) for r in B.level_counts(numbered, min_sup).collect()}
    for part in (0, 1):
        for size in (2, 3):
            assert levels.get((part, size), (0, 0))[1] == sum(p == part and len(x) == size for p, x in want)


def test_counts_of_cells_add_up_beyond_a_byte(spark, monkeypatch):
    """Counts travel in as few bytes as they fit; the sum over the cells of a piece needs more."""
    monkeypatch.setattr(B, "SEGMENTS", 1)
    monkeypatch.setattr(B.segments, "__defaults__", (2, 150))
    docs = spark.range(450).selectExpr("0 AS part", "id AS doc_idx", "0 AS label", "array(1L, 2L, 3L) AS ids")
    assert {(r["size"], r["n_c0"], r["n_c1"], r["n"]) for r in B.level_supports(docs, range(1, 4), 3).collect()} == {(k, 450, 0, 450) for k in (1, 2, 3)}


def test_unranked():
    for n, k in ((6, 1), (7, 3), (9, 4), (5, 5), (40, 2)):
        assert B.unranked(n, k, np.arange(math.comb(n, k))).tolist() == [list(x) for x in combinations(range(n), k)]
    last = math.comb(3000, 3) - 1
    assert B.unranked(3000, 3, np.array([0, last])).tolist() == [[0, 1, 2], [2997, 2998, 2999]]


def test_ranks_of_any_size(spark):
    docs = spark.createDataFrame([(0, 1, [2, 5, 7, 8, 11, 20]), (1, 2, [3])], "part int, doc_idx long, ids array<long>")
    got = {(r["doc_idx"], r["size"], r["rank"]): tuple(r["members"]) for r in B.ranked_subsets(docs, range(1, 7), 4).collect()}
    assert got == {(d, k, n): x for d, ids in ((1, [2, 5, 7, 8, 11, 20]), (2, [3])) for k in range(1, 7) for n, x in enumerate(combinations(ids, k))}


def test_short_pieces_share_batches():
    """Pieces of many short documents come out in a batch for each kind of piece, not in one each."""
    docs = [(d % 2, d, [10 * d + x for x in range(2 + d % 3)]) for d in range(300)]
    rows = [{"part": p, "doc_idx": d, "ids": ids, "size": 2, "first": a, "last": min(a + 2, math.comb(len(ids), 2) - 1)} for p, d, ids in docs for a in range(0, math.comb(len(ids), 2), 3)]
    whole = pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("doc_idx", pa.int64()), ("ids", pa.list_(pa.int64())), ("size", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
    found = list(B._ranked_pieces(iter([whole.slice(0, 170), whole.slice(170)])))
    assert len(found) <= 8
    got = sorted((r["part"], r["doc_idx"], r["size"], r["rank"], tuple(r["members"])) for x in found for r in x.to_pylist())
    assert got == sorted((p, d, 2, n, x) for p, d, ids in docs for n, x in enumerate(combinations(ids, 2)))


def test_long_documents_are_dealt_out(spark):
    docs = spark.createDataFrame([(0, 1, list(range(1, 31))), (0, 2, [3]), (0, 3, [])], "part int, doc_idx long, ids array<long>")
    pieces = B.rank_pieces(docs, range(1, 4), 100)
    assert pieces.count() == 1 + 5 + 41 + 1 and pieces.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == 30 + 435 + 4060 + 1
    rows = [tuple(r) for r in B.subset_rows(docs, range(1, 4), 100).collect()]
    assert len(rows) == len(set(rows)) == 30 + 435 + 4060 + 1 and (0, 1, 28, 29, 30) in rows and (0, 2, 3, 0, 0) in rows


@pytest.mark.parametrize("cells", [(64, 64, 1 << 16), (1, 2, 7)])
def test_lazy_rules(spark, monkeypatch, cells):
    """Whatever the number of cells and pieces; test items that training lacks never match, and a test without items has no rule."""
    for name, value in zip(("SEGMENTS", "PIECES", "PIECE"), cells):
        monkeypatch.setattr(B, name, value)
    monkeypatch.setattr(B.rank_pieces, "__defaults__", (cells[2],))
    monkeypatch.setattr(B.segments, "__defaults__", (2, 16))
    rng = random.Random(9)
    rows = [(d, rng.randint(0, 1), sorted({f"{c}{rng.randint(0, 2)}" for c in "abcdef" if rng.random() < 0.8})) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_idx int, label int, items array<string>")
    test = docs.where("doc_idx < 9").select(F.col("doc_idx").alias("test_idx"), "label", F.when(F.col("doc_idx") == 8, F.array().cast("array<string>")).otherwise(F.array_union("items", F.array(F.lit("unseen")))).alias("items"))
    for sizes in (range(1, 4), range(1, 2)):
        counts, want = _brute([(0, *r) for r in rows[9:]], sizes), {}
        for d, _, items in rows[:9]:
            for c in (0, 1):
                found = [counts[0, x] for k in sizes for x in combinations(items if d < 8 else [], k) if (0, x) in counts]
                conf = [n[c] / sum(n) for n, k in ((n, sum(n)) for n in found) if n[c] / k >= 0.4]
                want[d, c] = found, conf
        for r in S.lazy_rules(docs.where("doc_idx >= 9"), test, sizes, 0.4, 1).collect():
            conf = want[r["test_idx"], r["label"]][1]
            assert (r["n_rules"], round(r["sum_conf"], 6)) == (len(conf), round(sum(conf), 6))


@pytest.mark.parametrize("values", [{}, {"BLOCK": 7, "GROUP": 2, "TABLE_BYTES": 2000}, {"TABLE_ITEMS": 0}])
def test_matched_rules_by_tables_and_pieces(spark, monkeypatch, values):
    """Parts with items of their own and shared ones; asked items that no document has; one table or many, in one task or more."""
    for name, value in values.items():
        monkeypatch.setattr(B, name, value)
    rows, asks = _random_rows(12, 90), _random_rows(13, 40, letters="bcdefghx")
    frame = lambda x: spark.createDataFrame(x, "part int, doc_idx long, label int, items array<string>")
    docs, asking = frame(rows), frame([(p, d, c, [*items, *(["own"] if p else [])]) for p, d, c, items in asks])
    ids = B.item_ids(docs.unionByName(asking))
    known, own = (B.with_ids(x, ids, ["part", "doc_idx", "label"]) for x in (docs, asking))
    for sizes, min_sup in ((range(1, 4), 1), (range(1, 4), 3), (range(2, 3), 1), (range(3, 4), 2), (range(1, 2), 1)):
        counts, want = _brute(rows, sizes), {}
        for p, d, _, items in asks:
            for c in (0, 1):
                found = [counts[p, x] for k in sizes for x in combinations(items, k) if (p, x) in counts and (k == 1 or sum(counts[p, x]) >= min_sup)]
                conf = [n[c] / sum(n) for n in found if n[c] / sum(n) >= 0.3]
                if conf:
                    want[p, d, c] = len(conf), round(sum(conf), 6)
        got = B.matched_rules(own.withColumnRenamed("doc_idx", "asks"), known, sizes, 0.3, min_sup).where("n_rules > 0").collect()
        assert len(got) == len(want) and {(r["part"], r["asks"], r["label"]): (r["n_rules"], round(r["sum_conf"], 6)) for r in got} == want


def test_rule_cache(spark, tmp_path, monkeypatch):
    """Every batch counts only what is missing and answers as without a cache; the oldest go; another version starts anew."""
    rows = _random_rows(3, 80, parts=1)
    docs = spark.createDataFrame([r[1:] for r in rows], "doc_idx long, label int, items array<string>").cache()
    train = docs.where("doc_idx >= 30")
    test = lambda lo, hi: docs.where(f"doc_idx between {lo} and {hi}").select(F.col("doc_idx").alias("test_idx"), "items")
    known = {x for r in rows[30:] for x in r[3]}
    asked = lambda lo, hi: {x for r in rows[lo : hi + 1] for k in (1, 2, 3) for x in combinations([i for i in r[3] if i in known], k)}
    counted = []
    real = B.counted_sets
    monkeypatch.setattr(B, "counted_sets", lambda sets, *a: (counted.append(sets.count()), real(sets, *a))[1])
    want = lambda lo, hi: sorted((r[0], r[1], r[2], round(r[3], 6)) for r in S.lazy_rules(train, test(lo, hi), range(1, 4)).collect())
    got = lambda c, lo, hi: sorted((r[0], r[1], r[2], round(r[3], 6)) for r in c.rules(test(lo, hi)).collect())
    cache = RuleCache(spark, str(tmp_path), train, "a", range(1, 4))
    assert got(cache, 0, 9) == want(0, 9) and got(cache, 5, 19) == want(5, 19) and got(cache, 5, 19) == want(5, 19)
    assert counted == [len(asked(0, 9)), len(asked(5, 19) - asked(0, 9))]
    again = RuleCache(spark, str(tmp_path), train, "a", range(1, 4), most=len(asked(20, 29)))  # reads what is stored
    assert got(again, 20, 29) == want(20, 29) and counted[2] == len(asked(20, 29) - asked(0, 19)) and again.batches[-1]["kept"] == len(asked(20, 29))
    assert got(again, 20, 29) == want(20, 29) and len(counted) == 3  # the latest were kept
    assert got(again, 0, 9) == want(0, 9) and counted[3] == len(asked(0, 9) - asked(20, 29))
    other = RuleCache(spark, str(tmp_path), train, "b", range(1, 4))
    assert other.number == 0 and got(other, 0, 9) == want(0, 9) and {x.name for x in tmp_path.iterdir()} == {"b"}


def test_thresholds(spark):
    rows = spark.createDataFrame([(1, 1000), (1, 1001), (0, 0), (0, 5)], "c long, n long")
    assert [r[0] for r in rows.select(R.reaches(F.col("c"), F.col("n"), 0.001)).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(R.valid_rules(F.lit(1), F.col("n"), [F.col("c"), F.col("n") - F.col("c")], 0.0, 9)).collect()] == [2, 2, 0, 2]
    assert [r[0] for r in rows.select(R.valid_rules(F.lit(2), F.col("n"), [F.col("c")], 0.0, 9)).collect()] == [1, 1, 0, 0]
    assert list(R.antecedents(9)) == [1, 2, 3] and list(R.antecedents(0)) == [1]


def test_scores_golden(spark):
    rules = spark.createDataFrame([(0, 0, 3, 1.5), (0, 1, 1, 0.75), (1, 0, 0, 0.0), (1, 1, 1, 0.75)], "test_idx int, label int, n_rules long, sum_conf double")
    scores = S.class_scores(rules)
    assert {(r[0], r[1]): r[2] and round(r[2], 6) for r in scores.collect()} == {(0, 0): 0.4, (0, 1): 0.6, (1, 0): None, (1, 1): 0.75}
    assert [tuple(r) for r in S.ordered_labels(scores).orderBy("test_idx", "rank").collect()] == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 1)]
    assert [r[1] and round(r[1], 6) for r in S.ranking_score(scores).orderBy("test_idx").collect()] == [0.6, None]
    assert [r[1] and round(r[1], 6) for r in S.prediction_entropy(scores).orderBy("test_idx").collect()] == [0.970951, None]
    assert sum(math.isnan(r["score"]) for r in S.class_scores(rules, strict_nan=True).collect()) == 1


def test_metrics_golden(spark):
    found = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, 0), (3, -1, 0)], "test_idx int, label int, prediction int")
    counts = S.eval_counts(found)
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 2, 1, 1), (1, 1, 1, 2)]
    per = {r["label"]: (r["p"], r["r"], round(r["f1"], 4)) for r in S.eval_per_class(counts).collect()}
    assert per == {0: (0.5, 1.0, 0.6667), 1: (1.0, 0.5, 0.6667)}
    last = S.eval_running(found).orderBy(F.desc("seq")).first()
    assert (last["seq"], round(last["acc"], 4), round(last["macro_f1"], 4)) == (3, 0.6667, 0.6667)


def test_streaming_counts(spark, tmp_path):
    found = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, 0), (3, -1, 0)], "test_idx int, label int, prediction int")
    found.write.parquet(str(tmp_path / "in"))
    stream = streaming_counts(spark.readStream.schema(found.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("pairs").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in stream_eval(spark.table("pairs")).collect()) == [(0, 2, 1, 1), (1, 1, 1, 2)]


def test_running_metrics_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(e, k, rng.choice([-1, 0, 1]), rng.randint(0, 1)) for e in (4, 9) for k in range(40)]
    schema = "evaluator int, test_idx long, label int, prediction int"
    for lo in (0, 1, 25):  # the first holds one document, whose other class is never defined
        hi = {0: 1, 1: 25, 25: 40}[lo]
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).repartition(3).write.parquet(str(tmp_path / f"in/{lo}"))
        run = running_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    for e in (4, 9):
        own = spark.createDataFrame([r[1:] for r in rows if r[0] == e], "test_idx long, label int, prediction int")
        want = {r["seq"]: (round(r["acc"], 9), r["macro_f1"] and round(r["macro_f1"], 9)) for r in S.eval_running(own).collect()}
        assert {r["seq"]: (round(r["acc"], 9), r["macro_f1"] and round(r["macro_f1"], 9)) for r in got.where(F.col("evaluator") == e).collect()} == want


def test_dictionary_grows_without_changing_ids(spark):
    long = lambda rows: spark.createDataFrame(rows, "doc_idx long, label int, pos int, item string")
    first = I.item_dictionary(long([(0, 0, 1, "b"), (0, 0, 2, "a"), (1, 0, 1, "a")]))
    second = I.extended(first, long([(3, 0, 2, "z"), (3, 0, 1, "a"), (2, 0, 1, "c"), (9, 0, 1, "c")]))
    third = I.extended(second, long([(0, 0, 1, "z"), (0, 0, 2, "d")]))
    assert {r["item"]: r["item_id"] for r in third.collect()} == {"b": 2, "a": 3, "c": 4, "z": 5, "d": 6}
    assert sorted(map(tuple, I.extended(second, long([])).collect())) == sorted(map(tuple, second.collect()))


def test_numbers(spark):
    assert [tuple(r)[1:] for r in C.combinations(spark, 4, 2).orderBy("r").collect()] == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert [r["r"] for r in C.combinations(spark, 7, 3).orderBy("i", "j", "k").collect()] == list(range(35))
    assert [r[0] for r in C.primes(spark, 30).collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    rows = row_numbers(spark.range(37).select((F.col("id") * 7 % 37).alias("x")), "n", ["x"])
    assert all(r["x"] == r["n"] for r in rows.collect())
    nulls = row_numbers(spark.createDataFrame([("b", 1), (None, 2), ("a", None), ("a", 1)], "x string, y int"), "n", ["x", "y"])
    assert [(r["x"], r["y"]) for r in nulls.orderBy("n").collect()] == [(None, 2), ("a", None), ("a", 1), ("b", 1)]
    groups = row_numbers(spark.range(50).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("x")), "n", ["x"], by=["g"], ranges=7)
    assert sorted((r["g"], r["n"]) for r in groups.collect()) == [(g, n) for g in range(3) for n in range(17 if g < 2 else 16)]
    assert [r["x"] for r in groups.where("g = 0").orderBy("n").collect()] == list(range(-48, 1, 3)) and {r["n_size"] for r in groups.where("g = 2").collect()} == {16}
    clash = row_numbers(spark.range(9).select(*(F.col("id").alias(c) for c in ("x", "_range", "_n", "_before", "_own", "n_"))), "n", ["x"], ranges=3)
    assert all(r["x"] == r["n"] == r["_range"] == r["_own"] for r in clash.collect()) and clash.columns[-2:] == ["n_size", "n"]
    tiles = [r[0] for r in rows.orderBy("n").select(ntile(F.col("n"), F.col("n_size"), 10)).collect()]
    assert tiles == [min(t for t in range(10) if n < sum(4 if k < 7 else 3 for k in range(t + 1))) for n in range(37)]


def test_lines_and_documents_of_any_length(spark):
    items = " ".join(f"i{k}" for k in range(1_000_005))
    rows = T.parse_training(spark.createDataFrame([(0, f"1 CLASS=1 {items} CLASS=0")], "line_no long, line string"))
    assert rows.select(F.size("items"), "label").first()[:] == (1_000_005, 0)
    long = spark.createDataFrame([(0, 0, 1 << 20, "late"), (1, 0, 1, "next"), (1 << 40, 0, 1, "far"), (0, 0, 1, "first")], "doc_idx long, label int, pos int, item string")
    assert [tuple(r) for r in I.item_dictionary(long).orderBy("item_id").collect()] == [("first", 2), ("late", 3), ("next", 4), ("far", 5)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_byte_ranges_cut_lines_anywhere(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(lines, "CHUNK", 5)
    (tmp_path / "in").mkdir()
    texts = ["ab\n\ncdé\n", "", "x" * 40 + "\ny", "\n", "last\n日本\n"] if size > 1 else ["ab\n\ncdé\n", "", "xy\nz", "\n"]
    for k, text in enumerate(texts):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
    (tmp_path / "in" / "_not").write_text("no\n")
    want = [line for text in texts for line in (text.removesuffix("\n").split("\n") if text else [])]
    reader = lines._Reader({"path": str(tmp_path / "in"), "rangebytes": size})
    assert [line.decode() for x in reader.partitions() for line in reader._lines(x)] == want
    if size > 1:
        assert [r["line"] for r in lines.read_ranges(spark, str(tmp_path / "in"), size).orderBy("line_no").collect()] == want


def test_sink_commits_each_line_once(spark, tmp_path):
    """A task that fails after it has written leaves nothing; a run that fails leaves no file that readers see."""
    sink, out = lines.LineSink(str(tmp_path / "out")), tmp_path / "out"

    class Context:
        def __init__(self, number):
            self.number = number

        def partitionId(self):
            return self.number

    batch = lambda *x: iter([pa.RecordBatch.from_pydict({"line": list(x)})])

    def broken():
        yield from batch("half")
        raise OSError("lost")

    with pytest.MonkeyPatch.context() as m:
        done = []
        for number, rows in ((2, batch("c")), (0, batch("a", None)), (1, broken()), (1, batch("b")), (3, batch())):
            m.setattr(lines.TaskContext, "get", lambda number=number: Context(number))
            try:
                done.append(sink.write(rows))
            except OSError:
                pass
    sink.commit([*done, None])
    assert [x.read_text() for x in sorted(out.glob("part-*"))] == ["a\n\n", "b\n", "c\n"] and {x.name for x in out.iterdir()} == {"part-000000.txt", "part-000001.txt", "part-000002.txt", "_MANIFEST.json"}
    rows = spark.range(1000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    lines.write_ordered(rows.repartition(5), str(out), "id")
    assert [r["line"] for r in lines.read_ranges(spark, str(out), 100).orderBy("line_no").collect()] == [f"line {k}" for k in range(1000)]
    before = {x.name for x in out.iterdir()}
    with pytest.raises(Exception, match="no such row"):
        lines.write_ordered(rows.withColumn("line", F.when(F.col("id") == 700, F.raise_error(F.lit("no such row"))).otherwise(F.col("line"))), str(out), "id")
    assert {x.name for x in out.iterdir()} - {"_MANIFEST.json"} == before - {"_MANIFEST.json"}


def test_readers(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("5 CLASS=1  b\ta a\n\nx7 CLASS=0 c\n6 CLASS=0 d\n")
    rows = [tuple(r) for r in T.read_training(spark, str(path)).orderBy("doc_idx").collect()]
    assert rows == [(0, 5, 1, ["b", "a"]), (1, 0, 0, ["c"]), (2, 6, 0, ["d"])]
    assert [tuple(r) for r in T.read_test(spark, str(path)).collect()] == [(0, 1, ["a", "b"])]
    # files follow each other by path, whatever their sizes
    (tmp_path / "many").mkdir()
    for k, n in enumerate((1, 40, 3)):
        (tmp_path / "many" / f"{k}.txt").write_text("".join(f"{100 * k + i + 1} CLASS=0 x{'y' * 50}\n" for i in range(n)))
    assert [r["qid"] for r in T.read_training(spark, str(tmp_path / "many")).orderBy("doc_idx").collect()] == [1, *range(101, 141), 201, 202, 203]
    order = tmp_path / "o.txt"
    order.write_text("3 1\n2 ")
    assert [tuple(r) for r in T.read_feature_order(spark, str(order)).collect()] == [(0, 3), (1, 1), (2, 2)]
    T.write_lines(T.to_lines(T.read_training(spark, str(path))), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 CLASS=1 b a ", "2 CLASS=0 c ", "3 CLASS=0 d "]
    assert T.read_test(spark, str(tmp_path / "o.txt")).count() == 2
