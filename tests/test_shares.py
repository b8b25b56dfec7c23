"""Tasks whose number follows the rows, so that one of them takes the same memory at any size."""

import pytest

from susceptra import storage
from susceptra.plans import catalogue, fitting  # noqa: F401 (registers its queries)


def test_shares_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(storage, "SHARE", 100)
    for n in (2_000, 8_000):
        shares = storage.dealt(spark.range(n), n, "id").rdd.glom().map(len).collect()
        assert len(shares) == n // 100 and sum(shares) == n and max(shares) < 200


@pytest.mark.parametrize("name", ["interval_union_coverage", "score_released_model"])
def test_queries_deal_their_rows(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
