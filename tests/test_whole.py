"""The queries over the whole table against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quern.operators import bitmaps as B
from quern.operators import rules as R
from quern.plans.queries import QUERIES
from quern.sources import transactions as T

DOCS = 25


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    path = tmp_path_factory.mktemp("whole")
    rows = [(i, int(rng.integers(10)), [float(x) for x in rng.normal(size=64)]) for i in range(DOCS)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_idx"]: (r["label"], sorted(r["items"])) for r in T.documents(T.tx_embeddings(spark, sf_dir)).collect()}


def _sets(items):
    return [s for k in (1, 2, 3) for s in combinations(items, k)]


def test_lazy_rules(spark, sf_dir, documents):
    counts = [Counter(s for d, (label, items) in documents.items() if d % 5 and label == c for s in _sets(items)) for c in (0, 1)]
    want = {}
    for d, (_, items) in documents.items():
        if d % 5 == 0:
            for c in (0, 1):
                conf = [counts[c][s] / (counts[0][s] + counts[1][s]) for s in _sets(items) if counts[c][s]]
                want[d // 5, c] = len(conf), round(sum(conf), 4)
    got = {(r["test_idx"], r["label"]): (r["n_rules"], round(r["sum_conf"], 4)) for r in QUERIES["lazy_rules"](spark, sf_dir).collect()}
    assert got == want
    rules = {r["test_idx"]: r["rules"] for r in QUERIES["lazy_predictions"](spark, sf_dir).collect()}
    assert rules == {t: want[t, 0][0] + want[t, 1][0] for t, c in want if c == 0}


def test_rule_counts(spark, sf_dir, documents):
    """All documents are chosen."""
    pos = {p: r for r, p in enumerate(sorted(range(1, 65), key=lambda p: p * 37 % 65))}
    part = {(d, k): sorted(x for x in items if pos[int(x[1 : x.index("=")])] % 5 == k) for d, (_, items) in documents.items() for k in range(5)}
    counts = {(k, s): [0, 0] for (d, k), items in part.items() for s in _sets(items)}
    for (d, k), items in part.items():
        for s in _sets(items):
            counts[k, s][documents[d][0]] += 1
    rules = {(k, d): sum((n > 0) for s in _sets(items) for n in counts[k, s]) for (d, k), items in part.items()}
    assert {(r["part"], r["doc_idx"]): r["rules"] for r in QUERIES["rule_counts"](spark, sf_dir).collect()} == rules
    for size in (2, 3):
        got = {(r["part"], tuple(r[x] for x in "abc"[:size])): (r["n_c0"], r["n_c1"]) for r in QUERIES[f"itemsets{size}_support"](spark, sf_dir).collect()}
        assert got == {key: tuple(n) for key, n in counts.items() if len(key[1]) == size}
    assert {(r["part"], r["a"], r["b"]): r["n"] for r in QUERIES["bitmap_support"](spark, sf_dir).collect()} == {(k, *s): sum(n) for (k, s), n in counts.items() if len(s) == 2}
    assert all(r["n_projected"] == len(part[r["doc_idx"], r["part"]]) for r in QUERIES["project_on_current"](spark, sf_dir).collect())


@pytest.mark.parametrize("name", ["rule_count_size4", "rules_min_conf", "least_representative"])
def test_no_row_for_each_subset_of_a_document(spark, sf_dir, monkeypatch, name):
    """Rules meet the documents in tables, not as rows; with more items than tables take, as rows, which gives the same."""
    with monkeypatch.context() as rows:
        rows.setattr(B, "TABLE_ITEMS", 0)
        want = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))

    def no_rows(*_):
        raise AssertionError("a row for each subset")

    monkeypatch.setattr(R, "subset_rows", no_rows)
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())) == want
