"""Upload checks on real files, plain and packed."""

import gzip

import pytest

from susceptra.sources import uploads

FASTA = b">one\nACGT\n"


def test_check_uploads(spark, tmp_path):
    big = b">x\n" + b"A" * 5_000_000
    files = {
        "ok.fasta": FASTA, "UP.FNA": b"\n \r\n" + FASTA, "ok.fa.gz": gzip.compress(FASTA), "two.fa.gz": gzip.compress(b"\n") + gzip.compress(FASTA) + b"\0\0", "bomb.fa.gz": gzip.compress(big), "cut.fa.gz": gzip.compress(FASTA)[:-9],
        "no.fa.gz": FASTA, "text.fa": b"ACGT", "blank.fa": b" \n\n", "spaces.fa": b"  >x", "return.fa": b"\r>x", "name.txt": FASTA, "only.gz": gzip.compress(FASTA), ".fasta": FASTA, "a.b.fa": FASTA, "large.fa": big,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.reason) for r in uploads.check_uploads(spark, str(tmp_path), 1_000_000).collect()}
    want = dict.fromkeys(("ok.fasta", "UP.FNA", "ok.fa.gz", "two.fa.gz", "a.b.fa"), (200, None))
    want |= {"bomb.fa.gz": (413, "unpacked_too_large"), "cut.fa.gz": (422, "bad_gzip"), "no.fa.gz": (422, "bad_gzip"), "large.fa": (413, "too_large"), "name.txt": (415, "extension"), "only.gz": (415, "extension")}
    want |= dict.fromkeys(("text.fa", "blank.fa", "spaces.fa", "return.fa"), (422, "not_fasta"))
    # names that start with a dot are hidden from Spark's readers
    assert got == want


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_bounded_inflation(monkeypatch, chunk):
    monkeypatch.setattr(uploads, "CHUNK", chunk)
    for text, found in ((FASTA, True), (b"\n \n>x", True), (b" \n  >x", False), (b"", None), (b"\n\nACGT\n>x", False)):
        assert uploads.unpacked(gzip.compress(text), 1000) == (len(text), found, None)
    size, _, why = uploads.unpacked(gzip.compress(b"A" * 10_000_000), 1000)
    assert why == "unpacked_too_large" and size <= 1000 + chunk
