"""Every registered query equals its DuckDB oracle at sf0.01 and is not vacuous."""

import pytest

from moatlens.plans import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SF01

# Columns that hold one value by their meaning or by the landed data.
CONSTANT = {
    "registry_merge": {"review_slug"}, "registry_upsert": {"review_slug"},
    "report_write": {"generated_at"},  # given
    "material_events": {"form_type"},  # one form has events
    "patent_counts": {"shown_active", "shown_pending"},  # every supplier has more line items than the report shows
    "pricing_summary": {"highest_price"},  # every company has a page with the highest planted price
}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    r = compare(spark, key, SF01, duck)
    assert r["rows"] > 0, f"{key} returned no rows"
    assert r["equal"], r
    for column, distinct in r["distinct"].items():
        assert distinct > 1 or r["rows"] == 1 or column in CONSTANT.get(key, ()), f"{key}.{column} is constant"


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
