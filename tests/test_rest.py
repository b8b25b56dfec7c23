"""REST sources against a server in this process: short last pages, repeated keys, failures, refusals."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from susceptra.sources import rest

ROWS = [{"id": f"r{i:03d}", "genome_id": f"g{i % 40}", "biosample_accession": f"s{i % 25}", "n": i, "tags": ["a", i]} for i in range(107)]


@pytest.fixture
def server():
    seen, failing = [], {"left": 3, "code": 503}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append(body)
            if failing["left"] > 0 and ("limit(10,20)" in body or "bad" in body):
                failing["left"] -= 1
                self.send_response(failing["code"])
                self.end_headers()
                return
            if m := re.match(r"in\((\w+),\(([^)]*)\)\)", body):
                found = [r for r in ROWS if r[m[1]] in m[2].split(",")]
            else:
                limit, offset = map(int, re.search(r"limit\((\d+),(\d+)\)", body).groups())
                found = ROWS[offset : offset + limit]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/", seen, failing
    httpd.shutdown()


@pytest.mark.parametrize(("page", "parts"), [(10, 3), (107, 2), (25, 8), (1000, 1)])
def test_paged(spark, server, page, parts):
    url, seen, _ = server
    got = rest.paged(spark, url, "eq(a,b)&sort(+id)", ["id", "n", "tags", "absent"], page_rows=page, partitions=parts, wait_s=0.01).collect()
    assert sorted(map(tuple, got)) == [(r["id"], str(r["n"]), json.dumps(r["tags"]), None) for r in ROWS]
    # a partition ends at its first short page
    assert len({b for b in seen}) <= -(-107 // page) + parts


def test_lookup_of_repeated_and_unknown_keys(spark, server):
    url, seen, _ = server
    keys = spark.createDataFrame([(f"g{i % 12}", f"s{i % 5}") for i in range(60)] + [("none", None), (None, "s7")], "genome_id string, biosample_accession string")
    got = rest.lookup(keys, "genome_id", url, ["id", "genome_id"], at_once=4, partitions=2, wait_s=0.01).collect()
    assert sorted(map(tuple, got)) == sorted((r["id"], r["genome_id"]) for r in ROWS if int(r["genome_id"][1:]) < 12)
    asked = [k for b in seen for k in re.match(r"in\(\w+,\(([^)]*)\)", b)[1].split(",")]
    assert len(asked) == len(set(asked)) == 13 and all(b.count(",") <= 8 for b in seen)
    meta = rest.genome_metadata(keys, url, ["genome_id", "id", "n"], at_once=4, partitions=2, wait_s=0.01).collect()
    wanted = {r["genome_id"] for r in ROWS if int(r["genome_id"][1:]) < 12 or r["biosample_accession"] in {"s0", "s1", "s2", "s3", "s4", "s7"}}
    assert {r.genome_id for r in meta} == wanted and len(meta) == len(wanted)


def test_failures_are_repeated_and_refusals_are_not(server):
    url, seen, failing = server
    assert len(rest.post(url, "x&limit(10,20)", {}, first_wait_s=0.001)) == 10 and len(seen) == 4
    failing.update(left=9, code=404)
    with pytest.raises(Exception, match="404"):
        rest.post(url, "bad", {}, first_wait_s=0.001)
    assert len(seen) == 5
    failing.update(left=9, code=429)
    with pytest.raises(Exception, match="429"):
        rest.post(url, "bad", {}, first_wait_s=0.001)
    assert len(seen) == 9


def test_table_functions_equal_the_column_forms(spark, tmp_path):
    from pyspark.sql import functions as F

    from susceptra.functions import tables
    from susceptra.operators.reports import cs_events
    from susceptra.sources import files

    tables.register(spark)
    (tmp_path / "a.fa").write_text(">one x\nacgt\nAC GT\n>empty\n>two\nTT\n\nNN")
    lines = spark.read.option("wholetext", True).text(str(tmp_path / "a.fa")).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "line"))
    lines.createOrReplaceTempView("lines_of_files")
    got = spark.sql("SELECT * FROM fasta_records(TABLE(lines_of_files) PARTITION BY file ORDER BY place)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, files.fasta(spark, str(tmp_path)).collect())) and len(got) == 2
    spark.createDataFrame([(1, ":5*ag+cc-t=ACG"), (2, ""), (3, None)], "k int, cs string").createOrReplaceTempView("cs_rows")
    sums = spark.sql("SELECT k, sum(CASE WHEN sign IN (':', '=') THEN size ELSE 0 END) m, sum(CASE WHEN sign = '+' THEN size ELSE 0 END) i FROM cs_rows, LATERAL cs_events(cs) GROUP BY k").collect()
    whole = spark.table("cs_rows").filter("k = 1").select(cs_events(F.col("cs")).alias("e")).first().e
    assert [(r.k, r.m, r.i) for r in sums] == [(1, whole.matched, whole.inserted)] == [(1, 8, 2)]
    with pytest.raises(Exception, match="unsupported token"):
        spark.sql("SELECT * FROM cs_events(':5?')").collect()
