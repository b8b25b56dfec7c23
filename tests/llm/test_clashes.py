"""Columns of the user's that are named like the operators' own working columns."""

from susceptra.llm import licenses, linededup, simhash, urlfilter, warc

OWN = ("__row", "__gone", "__key", "__n", "__low", "__hint", "__f", "__own", "__first", "__size", "__digest", "__page", "row", "key")


def clashing(df):
    return df.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(OWN)])


def same(df, got):
    assert got.columns[: len(df.columns)] == df.columns or set(df.columns) <= set(got.columns)
    for r in got.select(*OWN).collect():
        assert tuple(r) == tuple(range(len(OWN)))


def test_documents(spark):
    long = " ".join(f"word{i} of a line that is repeated" for i in range(6))
    docs = clashing(spark.createDataFrame([(1, f"{long}\nonly here, and nowhere else at all"), (2, f"{long}\nsomething different in this one"), (3, None), (3, None)], "doc_id long, text string"))
    lines = linededup.dedup_lines(docs)
    assert {r.doc_id: r.text for r in lines.collect()}[2] == "something different in this one" and lines.count() == 4
    same(docs, lines)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < 4
    same(docs, kept)
    found = licenses.license_scan(docs.unionByName(clashing(spark.createDataFrame([(4, "under the MIT License")], "doc_id long, text string"))))
    assert {r.doc_id: (r.n_words, r.base_labels) for r in found.collect()}[4] == (4, "mit")
    same(docs.drop("text"), found)


def test_pages(spark):
    pages = clashing(spark.createDataFrame([(1, "http://a.net/x", "same"), (2, "http://b.org/fr/", "same"), (3, None, None)], "page_id long, url string, html string"))
    judged = urlfilter.judge(pages)
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow", 3: "allow"}
    same(pages, judged)
    again = warc.revisits(pages)
    assert {r.page_id: r.refers_to for r in again.collect()} == {1: None, 2: 1, 3: None}
    same(pages, again)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(docs).count() == 0 and linededup.dedup_lines(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
