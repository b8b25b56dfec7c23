"""Quality rules against plain Python: counts by definition, the ratio by Python integers and dictionaries."""

import math
import re
from collections import Counter

import pytest

from susceptra.llm import ngramrules
from susceptra.llm.text import table

MASK = (1 << 64) - 1
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def plain_ngrams(text):
    hashes = [sum(c * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(t)) & MASK for t in TOKEN.findall(text.encode().lower())]
    one = [h * 0xA0761D6478BD642F & MASK for h in hashes]
    two = [((a * 0xD6E8FEB86659FD93 & MASK) ^ b) * 0xC2B2AE3D27D4EB4F & MASK for a, b in zip(hashes, hashes[1:], strict=False)]
    return [h >> 64 - ngramrules.BITS for h in one + two]


def plain(docs, labels):
    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    raw, target = Counter(), Counter()
    for i, text in docs:
        found = plain_ngrams(text or "")
        raw.update(found)
        if quality.get(i) == 1:
            target.update(found)
    size = 1 << ngramrules.BITS
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + size)
    totals = sum(raw.values()) + size, sum(target.values()) + size
    out = []
    for i, text in docs:
        counts, found = plain_counts(text or ""), plain_ngrams(text or "")
        score = sum(math.log((target[b] + 1) / totals[1]) - math.log((raw[b] + 1) / totals[0]) for b in found) / len(found) if found else 0.0
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out.append((i, *counts, failed, score, not failed and score >= ngramrules.THRESHOLD))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*r[:7], r[8]) for r in got] == [(*r[:7], r[8]) for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want], abs=1e-9)


def test_whole_table(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    same(ngramrules.judge(docs, labels).collect(), plain([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()]))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(ngramrules, "PIECE", 64)
    texts = [None, "", " \n\t", "one", "a a a a", "x y z x y z", "é ü\x1c# ß\x85|", "same\nsame\n \n \nsame ", "w" * 5000, "many words " * 900, " ".join(map(str, range(400)))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")] + [(3, "one")] * 3 + [(10, texts[10])] * 2
    labels = [(10, 1), (6, 1), (6, 0), (3, None), (None, 1), (77, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as raw", "2 as score", "3 as n_words")
    same(ngramrules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect(), plain(docs, labels))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert ngramrules.judge(docs, labels).count() == 0
    one = ngramrules.judge(spark.createDataFrame([(1, "word " * 60)], docs.schema), labels).first()
    assert one.base_failed and not one.kept and one.n_words == 60


def test_clean_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = ngramrules.judge(table(spark, sf, "documents"), labels).filter("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0 and n[1, True] > 300 and n[0, False] > 20
