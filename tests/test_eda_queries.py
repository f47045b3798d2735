"""The bundle's queries read and clean the raw labels once, whatever the number of their tables."""

import datetime

import pytest

from checks import catalog


@pytest.mark.parametrize("name", ["K9_eda_bundle_values", "K9_eda_bundle_counts"])
def test_labels_are_cleaned_once(spark, tmp_path, name):
    day = datetime.date(2020, 1, 1)
    orders = [(i, i % 30, 1000.0 * i if i % 4 else None, day, "2-HIGH" if i % 2 else "1-URGENT") for i in range(1, 60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i,) for i in range(30)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.count() and not [f for f in found.inputFiles() if "orders.parquet" in f]
