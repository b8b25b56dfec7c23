"""Whole lineages on one side, the share of the test set, both classes of every drug, even folds."""

from collections import Counter, defaultdict

import pytest

from susceptra.operators import splits
from susceptra.plans import catalogue


def test_splits_of_the_table(spark, sf_dir):
    rows = catalogue.queries()["lineage_splits"](spark, sf_dir).collect()
    sizes = Counter(r.cluster for r in rows)
    side = defaultdict(set)
    for r in rows:
        side[r.cluster].add((r.split, r.fold))
        assert (r.fold is None) == (r.split == "test")
    assert all(len(x) == 1 for x in side.values()) and len(rows) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert 0.15 <= sum(r.split == "test" for r in rows) / len(rows) <= 0.20
    test = {r.cluster for r in rows if r.split == "test"}
    counts = defaultdict(Counter)
    by = {r.genome: r.cluster for r in rows}
    for o in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", "o_orderkey").collect():
        counts[by[o.o_custkey]][o.o_orderstatus, "SR"[o.o_orderkey % 2 == 0]] += 1
    total = sum((counts[c] for c in test), Counter())
    assert all(total[d, x] >= 10 for d in "FO" for x in "RS")
    assert test == splits.fill_with_classes(sorted(sizes), [sizes[c] for c in sorted(sizes)], counts, ["F", "O"], 7)
    rest = sorted(set(sizes) - test)
    assert {c: next(iter(side[c]))[1] for c in rest} == splits.folds(rest, [sizes[c] for c in rest], 5)


def test_no_seed_has_both_classes(spark):
    lineages = spark.createDataFrame([(i, f"c{i % 20}", i) for i in range(100)], "genome int, cluster string, extra int")
    labels = spark.createDataFrame([(i, "d", "R") for i in range(100)], "genome int, drug string, sir string")
    with pytest.raises(ValueError, match="no seed"):
        splits.make_splits(lineages, labels, ["d"], 1)
    out = splits.make_splits(lineages, labels, [], 1)
    assert out.columns == ["genome", "cluster", "extra", "split", "fold"] and 15 <= out.filter("split = 'test'").count() <= 20
