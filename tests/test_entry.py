"""Some registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", [
    "feature_partitions", "rule_counts", "rules_min_sup", "itemset_levels", "itemsets3_support", "sampling_step_k", "selective_sampling_sparse", "run_diagnostics", "project_on_current_sparse", "text_ranges_round_trip",
    "scan_test_stop", "class_token_counts", "lazy_predictions", "eval_running_stream", "scan_transactions_orders", "scan_transactions_documents", "extended_dictionary", "rule_cache_batches", "ranked_subsets", "feature_order_file",
])
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
