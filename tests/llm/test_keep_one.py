"""Near-duplicate removal decides by row."""

from susceptra.llm import simhash


def test_keep_one_decides_by_row(spark):
    a = " ".join(f"alpha{i} beta{i * 7} gamma{i * 3}" for i in range(60))
    b = " ".join(f"other{i * 5} words{i} delta{i * 11}" for i in range(60))
    c = " ".join(f"third{i} theme{i * 13} kappa{i * 2}" for i in range(60))
    d = " ".join(f"fourth{i * 3} topic{i} sigma{i * 17}" for i in range(60))
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (None, a, "n"), (None, c, "n"), (None, c, "m"), (8, d, "p"), (8, d, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, a), (5, b), (None, c), (8, d)], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0
