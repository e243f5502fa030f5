"""A sample of registered queries against their SQL; ``tests.check`` runs all of them."""

from __future__ import annotations

import pytest

from promolift.operators import allocation, cost, fraud, impact, redemption, uplift
from testbed.queries import MEASURE_SQL, ORACLES, QUERIES
from tests.check import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [
    "src_app_customers", "enrich_slot_segment", "agg_null_and_total_labels", "report_cost",
    "fraud_mal_redemptions", "impact_category_not_product", "rdm_index_vs_mailed", "uplift_sales",
])
def test_query_equals_its_sql(spark, connection, name):
    problem, rows = check(spark, connection, name, FOLDER)
    assert problem is None and rows


def test_every_measure_is_registered():
    for module, source in {
        "allocation": allocation, "cost": cost, "customer_impact": impact, "fraud": fraud,
        "redemption": redemption,
    }.items():
        assert {name for owner, name in MEASURE_SQL if owner == module} == set(source.NAMES)
    assert len(MEASURE_SQL) + len(uplift.NAMES) == 59
    assert set(QUERIES) == set(ORACLES)
