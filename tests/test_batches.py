"""Python runs over batches of rows, not once a row or group: the plans say which."""

import pytest

from susceptra.plans import catalogue, columns, stateful, udtfs  # noqa: F401 (registers its queries)


@pytest.mark.parametrize(("name", "slow"), [("alignment_scores", "FlatMapGroupsInPandas"), ("kmer_sketch_u64", "MapInPandas")])
def test_python_takes_batches(spark, sf_dir, name, slow):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and slow not in plan


@pytest.mark.parametrize("name", ["fasta_table_function", "cs_table_function"])
def test_table_functions_make_no_frame_a_call(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_deliveries_have_a_file_a_core():
    from types import SimpleNamespace

    cluster = lambda cores: SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=cores))
    assert [stateful.file_count(cluster(n)) for n in (1, 8, 13)] == [4, 8, 12]
