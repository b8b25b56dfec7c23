import gzip

import pytest

from susceptra.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# note\nid,v\n1,NA\n2,\n3,"a,b"\n')
    assert rows(files.text_table(spark, str(tmp_path / "a.csv"), comment="#")) == [("1", "NA"), ("2", ""), ("3", "a,b")]
    (tmp_path / "b.tsv").write_text("x\t0.1\ny\t\n")
    assert rows(files.text_table(spark, str(tmp_path / "b.tsv"), "\t", ["q", "d"])) == [("x", "0.1"), ("y", "")]


def test_versions(spark, tmp_path):
    for name in ("clsi_2020.csv", "eucast_2021.csv", "notes.csv"):
        (tmp_path / name).write_text("drug,s\nmeropenem,1\n")
    assert rows(files.versioned_tables(spark, str(tmp_path), "drug string, s double")) == [("meropenem", 1.0, "CLSI", 2020), ("meropenem", 1.0, "EUCAST", 2021)]


def test_reports(spark, tmp_path):
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"accession":"A","organism":{"organism_name":"x y"},"assembly_info":{"biosample":{"accession":"S"}},"assembly_stats":{"number_of_contigs":3,"total_sequence_length":"12"}}\n{"accession":"B"}\n')
    assert rows(files.assembly_reports(spark, str(tmp_path))) == [("A", "x y", "S", 3, 12)]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one a>b\nacgt\nAC\n>two\n\n>three\r\nGG\r\n")
    found = files.fasta(spark, str(tmp_path / "g.fa"))
    assert rows(found) == [("g.fa", "one a>b", "ACGTAC"), ("g.fa", "three", "GG")]
    long = spark.createDataFrame([("l", "ACGTN" * 50), ("m", "A" * 80)], "header string, sequence string")
    files.write_fasta(long, str(tmp_path / "out"))
    assert rows(files.fasta(spark, str(tmp_path / "out")).select("header", "sequence")) == rows(long)


def test_hits_and_classes(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("Gene symbol\tClass\nblaX\tBETA-LACTAM\n")
    assert rows(files.hits(spark, str(tmp_path / "h.tsv")).select("symbol", "class", "method")) == [("blaX", "BETA-LACTAM", "")]
    (tmp_path / "n.tsv").write_text("Class\nX\n")
    with pytest.raises(ValueError):
        files.hits(spark, str(tmp_path / "n.tsv"))
    one, two = (spark.createDataFrame(r, "symbol string, class string") for r in ([("a", "X"), ("b", "Y")], [("a", "Z"), ("b", "")]))
    assert rows(files.class_table([one, two])) == [("a", "Z"), ("b", "Y")]


def test_alignments(spark, tmp_path):
    (tmp_path / "p.paf").write_text("q\t1000\t0\t600\t-\td\t2000\t100\t700\t550\t600\t60\ttp:A:P\nq\t1000\t0\t400\t+\td\t2000\t0\t400\t400\t400\t60\nq\t1000\t0\t600\t+\td\t2000\t0\t600\t300\t600\t60\n")
    assert [tuple(r) for r in files.alignments(spark, str(tmp_path)).select("ts", "te").collect()] == [(1300, 1900)]


def test_strict_fasta(spark, tmp_path):
    (tmp_path / "ok.fa").write_text(">a\nac\n>b >c\nGT\n")
    assert rows(files.fasta(spark, str(tmp_path), strict=True).select("header", "sequence")) == [("a", "AC"), ("b >c", "GT")]
    (tmp_path / "bare.fa").write_text(">a\n>b\nGT\n")
    with pytest.raises(Exception, match="empty FASTA: bare.fa a"):
        files.fasta(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "none.fa").write_text("")
    with pytest.raises(ValueError, match="none.fa"):
        files.fasta(spark, str(tmp_path), strict=True)
    assert files.fasta(spark, str(tmp_path)).count() == 3


def test_alignments_of_parts(spark, tmp_path):
    row = lambda *x: "\t".join(map(str, x))
    (tmp_path / "a.paf").write_text("\n".join([row("left", 900, 0, 800, "+", "d0", 4000, 100, 900, 790, 800, 60), row("right", 900, 50, 900, "-", "d0", 4000, 1000, 1850, 850, 850, 60), row("right", 900, 0, 100, "+", "d0", 4000, 0, 100, 100, 100, 60)]))
    found = files.alignments(spark, str(tmp_path), offsets={"right": 5000})
    assert sorted((r.query, r.qs, r.qe, r.ts, r.te) for r in found.collect()) == [("left", 0, 800, 100, 900), ("right", 5050, 5900, 2150, 3000)]
    assert {(r.donor, r.strand, len(r.hits)) for r in files.alignments_by_donor(found).collect()} == {("d0", "+", 1), ("d0", "-", 1)}
