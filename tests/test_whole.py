"""Operators over whole tables against plain Python."""

import hashlib
import re
from collections import defaultdict

from susceptra.plans import catalogue


def test_components_whole(spark, sf_dir):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        one, two = sorted((find(r.l_partkey * 2), find(r.l_suppkey * 2 + 1)))
        root[two] = one
    got = {r.node: r.component for r in catalogue.queries()["components_whole"](spark, sf_dir).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_sketch_containment_all(spark, sf_dir):
    hashes, source = defaultdict(set), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect():
        source[r.doc_id] = r.source
        for w in re.findall(r"[^ \n]+", (r.text or "").lower()):
            if (m := hashlib.md5(w.encode()).hexdigest())[0] == "0":
                hashes[r.doc_id].add(m[:12])
    want = set()
    for q, own in hashes.items():
        best = {}
        for shared, i in sorted((-len(own & h), i) for i, h in hashes.items() if i != q and own & h):
            best.setdefault(source[i], (shared, i))
        want |= {(q, i, round(-shared / len(own), 9), k) for k, (shared, i) in enumerate(sorted(best.values())[:5], 1)}
    rows = catalogue.queries()["sketch_containment_all"](spark, sf_dir).collect()
    assert {(r.query_id, r.doc_id, round(r.containment, 9), r.rank) for r in rows} == want and len(rows) == len(want)
    assert len({r.query_id for r in rows}) > 20


def test_reverse_complement_whole(spark, sf_dir):
    to = str.maketrans("acgtnACGTN", "TGCANTGCAN")
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        rc = None if r.text is None else r.text.translate(to)[::-1]
        want[r.doc_id] = (None, None) if rc is None else (len(rc), hashlib.sha256(rc.encode()).hexdigest())
    rows = catalogue.queries()["reverse_complement_whole"](spark, sf_dir).collect()
    assert {r.doc_id: (r.rc_chars, r.rc_sha256) for r in rows} == want and len(rows) == len(want)
