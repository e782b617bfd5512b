"""A part of the registered queries beside their SQL on the smallest tables; `oracle_check.py` runs them all."""

import pytest

import oracle_check

SF = "/root/testdata/sf0.001"
NAMES = ["summary_stats", "anomaly_all", "granularity", "clean_rows", "column_mapping", "bill_metrics", "bill_monthly",
         "bill_labels", "fuel_kwh", "verify_consumption", "provider_detect", "extract_universal", "hdf_normalise"]


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    assert oracle_check.compare(spark, duck, name, SF).startswith("ok")
