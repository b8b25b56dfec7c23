"""Brute force, round trips and edge cases of the training-data operators."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from susceptra.llm import licenses, linededup, mixing, order_minhash, pieces, quality, simhash, urlfilter, warc, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    long_text = "\n".join(f"word{i % 97} and some more words here number {i} of many lines in the text" for i in range(3000))
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, long_text), (5, "one two three four five six"), (5, "one two three four five six"), (None, "a null id \U0001f600 ß é"), (7, " \t\n "), (8, "x")]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash") for i, t in texts], SCHEMA)


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_mix_targets_and_taken(spark, odd):
    """On 50 documents a source; a source of a few documents can only be met to within half a document."""
    for df in (docs(spark, "/root/testdata/sf0.01"), odd):
        rows = mixing.mix_sources(df).collect()
        total = sum(r["size"] for r in rows)
        targets, taken, sizes = {}, defaultdict(int), {}
        for r in rows:
            targets[r.source], sizes[r.source] = r.target, r.source_size
            taken[r.source] += r["size"] * r.copies
            assert r.copies <= 3 or not r["size"]
        assert abs(sum(targets.values()) - total) < 1e-6 * total
        for s in targets:
            assert targets[s] <= 3 * sizes[s] + 1e-6
            if df is not odd:
                assert abs(taken[s] - targets[s]) <= 0.03 * targets[s]
    assert mixing.take(odd.limit(0)).count() == 0
    taken = mixing.take(odd)
    assert taken.columns == odd.columns and {r["size"] for r in taken.collect()} == {"clash"}


def test_fingerprints(spark, odd):
    rows = order_minhash.fingerprint_pairs(odd).collect()
    assert len(rows) == odd.count() and order_minhash.fingerprint_pairs(odd.limit(0)).count() == 0
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[1] == by_id[5] and len(by_id[5]) == 1
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    one = next(r for r in rows if r.doc_id == 8)
    assert one.edited_sha256 == hashlib.sha256(b"x").hexdigest()
    seven = next(r for r in rows if r.doc_id == 4)
    half = len(texts[4]) // 2
    assert seven.edited_sha256 == hashlib.sha256((texts[4][: len(texts[4]) - half] + texts[3][:half]).encode()).hexdigest()


def test_fingerprint_against_plain_python(spark):
    text = "a b a b a b c a b c d " * 3
    got = spark.createDataFrame([(text,)], "t string").select(order_minhash.fingerprint(F.col("t"))).first()[0]
    words = text.split()
    grams = spark.createDataFrame([(i, *words[i : i + 2]) for i in range(len(words) - 1)], "i int, a string, b string").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()
    mask, seen, rows = (1 << 40) - 1, defaultdict(int), []
    for r in grams:
        h = r.h & mask
        rows.append((r.i, h, seen[h]))
        seen[h] += 1
    second = spark.createDataFrame(rows, "i int, h long, n int").select("i", F.xxhash64("h", "n").alias("k")).collect()
    classes = defaultdict(list)
    for r in second:
        k = r.k & mask
        classes[k >> 35].append((k, r.i))
    blocks = []
    for c in range(order_minhash.BUCKETS):
        best = [k for k, i in sorted(sorted(classes[c])[: order_minhash.TAKE], key=lambda x: x[1])]
        blocks.append(best)
    hashed = spark.createDataFrame([(c, b) for c, b in enumerate(blocks) if b], "c int, b array<long>").select("c", F.substring(F.lpad(F.lower(F.hex(F.xxhash64("b"))), 16, "0"), 1, 8).alias("x")).collect()
    want = {r.c: r.x for r in hashed}
    assert got == "".join(want.get(c, order_minhash.EMPTY) for c in range(order_minhash.BUCKETS))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.RADIUS:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, sf_dir, odd):
    for df in (docs(spark, sf_dir), odd):
        rows = [r for r in simhash.near_duplicates(df).collect() if r.doc_id is not None]
        fps = [int(r.fingerprint, 16) for r in rows]
        groups = defaultdict(list)
        for r, root in zip(rows, brute_components(fps), strict=True):
            groups[root].append(r)
        for g in groups.values():
            assert {r.component_id for r in g} == {min(r.doc_id for r in g)}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.simhash("") == simhash.simhash(None) == simhash.simhash(" \n") == 0


def test_ball_links_are_complete(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4, 6)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bits in (2, 8):
        links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, route_bits=bits).collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
        parent = {f: f for f in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        want = brute_components(fps)
        assert len({find(f) for f in fps}) == len(set(want))


def test_url_rules_and_cascade(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "http://sub.free-bets.example.com/a?b#c", "http://free-bets.example.com", "http://example.com/de/x", "http://a.org/fr/", "nothing", None, "", "http://h?q=1#f"]
    rows = urlfilter.judge(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string"), listed_md5=None).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("sub.free-bets.example.com", "/a", None, "block"), ("free-bets.example.com", "", None, "block"),
        ("example.com", "/de/x", "example.com/de/", "block"), ("a.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
    ]


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter("crc32(cast(key as binary)) % 7 = 0")
    c = urlfilter.build_cascade(universe, listed)
    rows = urlfilter._hashed(universe).toPandas()
    found = c.contains(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64))
    assert (found == [zlib.crc32(k.encode()) % 7 == 0 for k in rows.key]).all() and len(c.levels) > 2
    assert not urlfilter.build_cascade(universe, listed.limit(0)).levels


def test_url_table_blocklist_and_edges(spark):
    urls = [f"http://h{i}.d{i % 50}.example/x" for i in range(3000)] + ["http://h1.d1.example/x", None]
    pages = spark.createDataFrame([(u, "clash") for u in urls], "url string, verdict string")
    listed = spark.createDataFrame([(f"d{i}.example",) for i in range(0, 50, 7)] + [("h3.d3.example",)], "key string")
    got = {(r.url, r.verdict) for r in urlfilter.judge(pages, rules=(), blocklist=(), listed_md5=None, listed=listed).collect()}
    assert got == {(u, "block" if u and ((int(u.split(".d")[1].split(".")[0]) % 7 == 0) or "h3.d3." in u) else "allow") for u in urls}
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert urlfilter.judge(pages).count() == len(urls)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ß\x00\r\n\r\nWARC/1.0", "y" * 300000, "<p>a</p>"]
    pages = spark.createDataFrame([(i if i != 6 else None, f"http://h/{i} ü", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    for i, t in enumerate(html[:6]):
        raw = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.base32_sha1(raw))
    assert [got[i].record_type for i in (0, 1, 2, 3, 4, None)] == ["response", "revisit", "response", "revisit", "response", "revisit"]
    assert got[1].refers_to == 0 and got[3].refers_to == 2 and got[None].refers_to == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0
    clash = pages.withColumn("record_type", F.lit("x")).withColumn("__digest", F.lit("y")).withColumn("refers_to", F.lit(99))
    twice = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(clash.unionByName(clash)).collect()}
    assert (0, "response", None) in twice and (1, "revisit", 0) in twice and (4, "response", None) in twice
    whole = warc.read_records(warc.normalise(warc.write_archives(warc.revisits(pages)))).collect()
    assert {r.page_id: r.payload for r in whole if r.page_id is not None} == {0: b"<p>a</p>", 1: None, 2: b"", 3: None, 4: html[4].encode(), 5: html[5].encode()}
    with pytest.raises(ValueError):
        warc.unwrap(b"no message")
    raw = warc.record(1, "u", b"x" * 10) + warc.record(2, None, b"")
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    content = packed.compress(raw) + packed.flush()
    assert b"".join(warc.split_stream(content)) == raw
    with pytest.raises(ValueError):
        list(warc.split_stream(content[:-12]))


def test_license_templates(spark, odd):
    automata = [licenses.compile_template(*t) for t in licenses.TEMPLATES]
    scan = lambda t: licenses.scan(t.lower(), automata)
    body = licenses.TEMPLATES[0][2]
    plain = body.replace("<<opt>>\"<</opt>>", "").replace("<<opt>>(including the next paragraph)<</opt>>", "").replace("<<var:1-12>>", "the authors or copyright holders")
    assert "mit-text" in scan(plain)["labels"]
    assert "mit-text" not in scan(plain.replace("sublicense", "sell"))["labels"]
    assert scan("Released under the MIT License.")["labels"] == ["mit", "mit-notice"]
    two = scan("mit license x general public license mit license")
    assert (two["n_base"], two["base_labels"]) == (3, ["gpl", "mit"])
    with pytest.raises(ValueError):
        licenses.compile_template("bad", 1.0, "a <<opt>> b")
    rows = {r.doc_id: r for r in licenses.license_scan(odd.filter("doc_id in (1, 2, 3)")).collect()}
    assert (rows[1].n_words, rows[2].n_words, rows[2].score, rows[3].labels) == (6, 0, 0.0, "")


def test_quality(spark, sf_dir, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    p = quality.judge(docs(spark, sf), labels).join(labels, "doc_id").toPandas()
    held = p[p.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert {r.doc_id: r.held_out for r in quality.judge(docs(spark, sf).limit(20), labels).collect()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs(spark, sf).limit(20).collect()}
    model = quality.fit(odd, labels.limit(0))
    assert model.score("") == model.score(None) == 0.5
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())


def test_lines(spark, odd):
    line = "the quick brown fox jumps over the lazy dog near the river bank while the old farmer watches the evening sun go down slowly over the distant hills and fields of yellow corn that sway gently in the warm summer wind as birds fly home"
    near = line.replace("yellow", "golden")
    other = "an entirely different line about trains and stations that shares nothing with the first one at all"
    df = spark.createDataFrame([(1, f"{line}\nshort\n{other}"), (2, f"short\n{near}\nnew line of text that is long enough to be identified by the operator"), (3, line), (4, None), (5, ""), (None, other)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == {1: f"{line}\nshort\n{other}", 2: "short\nnew line of text that is long enough to be identified by the operator", 3: "", 4: None, 5: "", None: ""}
    assert linededup.dedup_lines(odd).count() == odd.count() and linededup.dedup_lines(odd.limit(0)).count() == 0


def test_line_recall(spark, sf_dir):
    """Pairs found against all pairs of similar lines."""
    lines = linededup.lines_of(docs(spark, sf_dir).select("text")).distinct().collect()
    sets = [(r.line_id, linededup.shingles(r.line)) for r in lines]
    where = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(k)
    pairs = {(min(i, j), max(i, j)) for c in where.values() for i in c for j in c if i < j}
    true = [(sets[i][0], sets[j][0]) for i, j in pairs if len(sets[i][1] & sets[j][1]) >= 0.8 * len(sets[i][1] | sets[j][1])]
    signed = linededup.signed_lines(docs(spark, sf_dir).select("doc_id", "text")).filter("bands is not null")
    found = linededup.line_components(docs(spark, sf_dir).select("doc_id", "text"), signed.select(F.explode("bands").alias("band"), "line_id", "sketch"))
    root = {r.line_id: r.component for r in found.collect()}
    assert true and sum(root.get(a, a) == root.get(b, b) for a, b in true) >= 0.9 * len(true)


def test_webp_payload(spark, odd):
    rows = {r.doc_id: r for r in webp.digests(odd).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        padded = webp.pad(raw)
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert webp.digests(odd.limit(0)).count() == 0


def test_webp_round_trip_and_what_it_reaches(monkeypatch):
    """Small images pass through codes, references and cache, all through three transforms."""
    rng, reached = random.Random(2), set()
    for name in ("_undo_predictor", "_undo_cross_colour", "_fixed_image", "_amount"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (reached.add(n), f(*a))[1])
    for text in ("", "x", "abcd" * 100, "a small text of words and more words", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(180)), "aXbY" * 30 + "zz" * 77):
        payload = webp.pad(text.encode())
        media = webp.encode_bytes(payload)
        assert webp.decode_bytes(media)[1] == payload
    assert len(webp.encode_bytes(webp.pad(b"one two three"))) < 300
    for text in ("word " * 500, "".join(chr(rng.randrange(32, 0x2000)) for _ in range(5000))):
        payload = webp.pad(text.encode())
        assert webp.decode_bytes(webp.encode_bytes(payload))[1] == payload
    assert reached == {"_undo_predictor", "_undo_cross_colour", "_fixed_image", "_amount"}
    noise = np.frombuffer(rng.randbytes(4 * 7 * 9), np.uint8).reshape(7, 9, 4)
    assert (webp.decode_stream(next(webp.frames(webp.encode(noise)))) == noise).all()


class Writer:
    """Writes the format's harder parts, for the decoder to read."""

    def __init__(self, width, height):
        self.bits = webp.BitsOut()
        for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.bits.put(v, n)

    def simple(self, *symbols):
        self.bits.put(1, 1)
        self.bits.put(len(symbols) - 1, 1)
        self.bits.put(1, 1)
        for s in symbols:
            self.bits.put(s, 8)

    def lengths(self, lengths):
        """All lengths sent as they are, with a flat 4-bit code for 0 to 15."""
        self.bits.put(0, 1)
        self.bits.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.bits.put(4 if s < 16 else 0, 3)
        self.bits.put(0, 1)
        for n in lengths:
            self.symbol({i: (4, i) for i in range(16)}, n)

    def symbol(self, codes, s):
        n, code = codes[s]
        for k in range(n - 1, -1, -1):
            self.bits.put(code >> k & 1, 1)

    def stream(self):
        return self.bits.value.to_bytes(-(-self.bits.n // 8) + 8, "little")


def canonical(lengths):
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (n, code)
        code, last = code + 1, n
    return out


def test_webp_references_and_cache():
    w = Writer(4, 2)
    w.bits.put(0, 1)  # no transform
    w.bits.put(1, 1)  # a colour cache of 2 colours
    w.bits.put(1, 4)
    w.bits.put(0, 1)  # no meta codes
    green = [0] * (256 + 24 + 2)
    argb = 0xFF0A1409
    slot = (0x1E35A7BD * argb & 0xFFFFFFFF) >> 31
    for s, n in ((20, 2), (40, 2), (256 + 1, 2), (280 + slot, 2)):
        green[s] = n
    w.lengths(green)
    w.simple(10)
    w.simple(9)
    w.simple(255)
    w.simple(1)  # distance code 1: distance prefix 2, the pixel to the left
    codes = canonical(green)
    w.symbol(codes, 20)
    w.symbol(codes, 40)
    w.symbol(codes, 280 + slot) if (0x1E35A7BD * 0xFF0A2809 & 0xFFFFFFFF) >> 31 != slot else w.symbol(codes, 20)
    for _ in range(2):
        w.symbol(codes, 257)  # two pixels from one to the left
    w.symbol(codes, 40)
    got = webp.decode_stream(w.stream())
    assert got.reshape(-1, 4)[:, 1].tolist() == [20, 40, 20, 20, 20, 20, 20, 40]
    assert (got[..., 0] == 10).all() and (got[..., 2] == 9).all() and (got[..., 3] == 255).all()


def test_webp_palette_and_green():
    w = Writer(5, 1)
    w.bits.put(1, 1)
    w.bits.put(3, 2)  # palette of two colours, eight pixels to a word
    w.bits.put(1, 8)
    w.bits.put(0, 1)
    for symbols in ((7, 3), (1,), (2,), (255, 0), (0,)):
        w.simple(*symbols)
    codes_green, codes_alpha = canonical([1 if s in (3, 7) else 0 for s in range(256)]), canonical([1 if s in (0, 255) else 0 for s in range(256)])
    for g, a in ((7, 255), (3, 0)):
        w.symbol(codes_green, g)
        w.symbol(codes_alpha, a)
    w.bits.put(0, 1)
    w.bits.put(0, 1)
    w.bits.put(0, 1)
    for s in (0b10110, 0, 0, 0, 0):
        w.simple(s)
    got = webp.decode_stream(w.stream())
    one, two = [1, 7, 2, 255], [2, 10, 4, 255]
    assert got[0].tolist() == [one, two, two, one, two]


def test_webp_inverse_transforms():
    """Each inverse against a forward transform written plainly."""
    rng = np.random.default_rng(3)
    w, h = 7, 6
    px = rng.integers(0, 256, (h * w, 4)).astype(np.int16)
    for mode in range(14):
        residual = px.copy().astype(int)
        for y in range(h):
            for x in range(w):
                i = y * w + x
                if not y:
                    guess = px[i - 1].tolist() if x else [255, 0, 0, 0]
                elif not x:
                    guess = px[i - w].tolist()
                else:
                    guess = webp._predict(mode, px[i - 1].tolist(), px[i - w].tolist(), px[i - w - 1].tolist(), px[i - w + 1].tolist())
                residual[i] = (px[i] - np.array(guess)) & 255
        modes = np.full(4, mode << 8, np.uint32)
        assert (webp._channels(webp._undo_predictor(webp._words(residual), w, h, modes, 2)) == px).all(), mode
    factors = np.array([0x00F31A07] * 4, np.uint32)
    s = lambda v: v - 256 if v > 127 else v
    forward = px.copy().astype(int)
    for i in range(len(px)):
        a, r, g, b = px[i].tolist()
        forward[i] = [a, (r - (s(0x07) * s(g) >> 5)) & 255, g, (b - (s(0x1A) * s(g) >> 5) - (s(0xF3) * s(r) >> 5)) & 255]
    assert (webp._channels(webp._undo_cross_colour(webp._words(forward), w, h, factors, 2)) == px).all()


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.vocabulary(f.read())


def test_scan_equals_library(vocabulary, spark, sf_dir):
    texts = [r.text[:3000] for r in docs(spark, sf_dir).limit(25).collect()]
    texts += ["a  b   c    d     e", "  x", "\n\n\n", "x" * 300, "abcdefghij" * 50, "▁▁ a", "é中\x00 z", "", " ", "   ", "don't stop " * 40, "supercalifragilistic" * 10, "的中国是" * 40 + "\n\t \r\n x"]
    for t in texts:
        for chunk in (64, 100, 257):
            assert pieces.scan_encode(vocabulary, t, chunk) == vocabulary.library.encode(t), (t[:40], chunk)


def test_encode_and_decode(vocabulary, spark, odd):
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    rows = pieces.decode(pieces.encode(odd, model, chunk=500), model, ["doc_id", "n_tokens", "ids"]).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        assert np.frombuffer(r.ids, "<i4").tolist() == vocabulary.library.encode(texts[r.doc_id])
        assert r.decoded == texts[r.doc_id]
    assert pieces.encode(odd.limit(0), model).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs_in = docs(spark, sf_dir)
    seen = docs_in
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir)
        assert seen.columns == docs_in.columns
        assert seen.count() > 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == seen.count()
