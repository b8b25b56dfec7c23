"""Line dedup against brute force over all code-point shingles of whole lines."""

import random

from pyspark.sql import functions as F

from susceptra.llm import linededup


def similar(lines):
    """Pairs of places in lines whose Jaccard similarity over all 5-code-point shingles is 0.8 or more."""
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    everywhere = set.intersection(*sets)
    least = min(map(len, sets))
    assert len(everywhere) * 5 < 4 * (2 * least - len(everywhere)), "what all lines share must not make them similar"
    where, pairs = {}, set()
    for k, s in enumerate(sets):
        for x in s - everywhere:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        counts = {}
        for x in s - everywhere:
            for j in where[x]:
                counts[j] = counts.get(j, len(everywhere)) + 1
        pairs |= {(j, k) for j, n in counts.items() if j < k and n * 5 >= 4 * (len(s) + len(sets[j]) - n)}
    return pairs


def linked(spark, lines):
    """The component of each place in lines."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    signed = linededup.signed_lines(df).filter("bands is not null")
    found = linededup.line_components(df, signed.select(F.explode("bands").alias("band"), "line_id", "sketch"))
    ids = {r.line: r.line_id for r in df.select(F.col("text").alias("line"), F.xxhash64("text").alias("line_id")).collect()}
    root = {r.line_id: r.component for r in found.collect()}
    assert set(root) <= set(ids.values())
    return [root.get(ids[x], ids[x]) for x in lines]


def roots(n, pairs):
    """The component of each place by plain union-find."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def assert_joined_rightly(root, true):
    """No component found reaches over those of the true pairs."""
    want, seen = roots(len(root), true), {}
    assert all(seen.setdefault(r, w) == w for r, w in zip(root, want, strict=True))


def sharing(lines):
    """Pairs (2 k, 2 k + 1) of places that share a band."""
    bands, _ = linededup.signatures(lines)
    return {(k, k + 1) for k in range(0, len(lines), 2) if set(bands[k].tolist()) & set(bands[k + 1].tolist())}


def test_word_tails_are_compared(spark):
    texts = ["telephone identification 1234567890123456", "telephone identification 9999888877776666"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == dict(enumerate(texts))


def test_links_are_those_of_whole_lines(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = [r.line for r in df.filter(F.length("line").between(40, 400)).distinct().orderBy("line").collect()]
    true = similar(lines)
    root = linked(spark, lines)
    assert_joined_rightly(root, true)
    assert len(true) > 50 and sum(root[a] == root[b] for a, b in true) >= 0.98 * len(true)


def test_large_band_is_compared_in_full(spark):
    """Thousands of different lines with one opening, and among them similar ones that share bands of the opening only."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    opening = " ".join(word(4) for _ in range(40))
    lines = []
    for _ in range(1500):
        rest = [word(60) for _ in range(4)]
        lines.append(" ".join([opening, *(f"0{x}" for x in rest)]))
        lines.append(" ".join([opening, *(f"1{x}" for x in rest)]))
    true = similar(lines)
    root = linked(spark, lines)
    assert_joined_rightly(root, true)
    assert len(true) == 1500
    # a pair that shares no band is never a candidate; most share one
    shared = sharing(lines)
    assert len(true & shared) > 1200
    assert all(root[a] == root[b] for a, b in true & shared)


def test_short_lines_go_once(spark):
    texts = ["All rights reserved.\nReleased under the MIT License.", "All rights reserved.", "x\nReleased under the MIT License.\n\n}", "x\n\n}", "return 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in linededup.dedup_lines(df).orderBy("doc_id").collect()] == [texts[0], "", "x\n\n}", "x\n\n}", "return 1"]


def test_line_hash_is_sparks(spark):
    lines = ["abcdef", "ß é 中\U0001f600 and more", "x" * 5000]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert [r.line_id for r in linededup.signed_lines(df).orderBy("line_no").collect()] == [r.h for r in spark.createDataFrame([(x,) for x in lines], "x string").select(F.xxhash64("x").alias("h")).collect()]


def test_signatures_against_plain_python():
    """A line's minima are its own: whatever stands beside it in a block changes nothing."""
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab cde") for _ in range(rng.choice([5, 6, 7, 50, 300]))) for _ in range(400)]
    bands, sketch = linededup.signatures(lines)
    for k in (0, 1, 17, 399):
        one, own = linededup.signatures([lines[k]])
        assert (one[0] == bands[k]).all() and own[0] == sketch[k]
    assert linededup.signatures([])[0].shape == (0, linededup.BANDS)


def test_kept_text_against_plain_python(spark):
    """Whole operator on sf0.001: of the lines that similar pairs (and equality) join, the first place stays."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").distinct()
    docs = {r.doc_id: r.text for r in df.filter("text is not null").orderBy("doc_id").collect()}
    places = [(i, k, x) for i, t in sorted(docs.items()) for k, x in enumerate(t.split("\n")) if len(x) >= linededup.MIN_CHARS]
    distinct = sorted({x for _, _, x in places})
    index = {x: k for k, x in enumerate(distinct)}
    sets = [linededup.shingles(x) for x in distinct]
    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = set()
    for k, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in where[x]:
                counts[j] = counts.get(j, 0) + 1
        pairs |= {(j, k) for j, n in counts.items() if j < k and n * 5 >= 4 * (len(s) + len(sets[j]) - n)}
    root, seen, gone = roots(len(distinct), pairs), set(), set()
    for i, k, x in places:
        if root[index[x]] in seen:
            gone.add((i, k))
        seen.add(root[index[x]])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df.filter("text is not null")).collect()}
    differ = sum(got[i] != want[i] for i in want)
    assert len(gone) > 50 and differ <= 0.01 * len(want)
