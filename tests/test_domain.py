"""The two-source flow, overrides, checks and sinks on small rows of their own and on fixed expectations."""

import json
import os

import pytest
from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.operators import harmonize, reports, splits, validate
from susceptra.sources import files, sinks

A = "genome_id string, antibiotic string, resistant_phenotype string, measurement_sign string, measurement_value string, measurement_unit string, laboratory_typing_method string, testing_standard string, testing_standard_year int, evidence string"
B = "biosample string, organism string, antibiotic string, resistance_phenotype string, measurement_sign string, measurement string, measurement_units string, laboratory_typing_method string, testing_standard string"
LAB, COMP = "Laboratory Method", "Computational Method"
SPECIES = {"Klebsiella pneumoniae": "KPNEU"}
DRUGS = {"meropenem": "meropenem", "ciprofloxacin": "ciprofloxacin", "piperacillin/tazobactam": "piperacillin-tazobactam"}


@pytest.fixture(scope="module")
def flow(spark):
    # fixed expectations of the domain: which row is kept, merged or dropped for which reason
    a = spark.createDataFrame([
        ("573.1", "meropenem", "Resistant", "=", "4", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
        ("573.1", "ciprofloxacin", "Resistant", "", "", "", "Broth dilution", "CLSI", 2020, COMP),
        ("573.2", "meropenem", "Susceptible", "", "25", "mm", "Disk diffusion", "CLSI", 2020, LAB),
        ("573.2", "ciprofloxacin", "Susceptible", "", "", "", "Disk diffusion", "", None, LAB),
        ("573.3", "meropenem", "Susceptible", "", "1.5", "mg/L", "Etest", "CLSI", 2020, LAB),
        ("573.3", "ciprofloxacin", "Susceptible", "<=", "0.06", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
        ("573.4", "piperacillin/tazobactam", "Resistant", ">", "64/4", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
        ("573.5", "meropenem", "Resistant", "=", "16", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
        ("573.6", "meropenem", "Resistant", "=", "32", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
        ("573.7", "gentamicin", "Resistant", "=", "32", "mg/L", "Broth dilution", "CLSI", 2020, LAB),
    ], A)
    b = spark.createDataFrame([("SAMN1", "Klebsiella pneumoniae", "meropenem", "resistant", "==", "8", "mg/L", "broth dilution", "CLSI"), ("SAMN9", "Klebsiella pneumoniae", "ciprofloxacin", "not defined", "<=", "0.25", "mg/L", "broth dilution", "")], B)
    bio = {"573.1": "SAMN1", "573.5": "SAMN5", "573.6": "SAMN5"}
    meta = spark.createDataFrame([(f"573.{i}", "Klebsiella pneumoniae", bio.get(f"573.{i}"), 50 - i, "blood culture" if i == 1 else None, None, None) for i in range(1, 8)], "genome_id string, species string, biosample_accession string, contigs int, isolation_source string, isolation_country string, collection_year int")
    meta_b = spark.createDataFrame([("SAMN9", "2018-05", "Germany: Berlin", "missing")], "biosample string, collection_date string, geo_loc_name string, isolation_source string")
    versions = spark.createDataFrame([("KPNEU", "meropenem", "CLSI", 2018, 1.0, 4.0)], "species string, drug string, standard string, effective_year int, s double, r double")
    rows = harmonize.admitted(harmonize.source_a(a, meta).unionByName(harmonize.source_b(b)), SPECIES, DRUGS)
    kept, dropped = harmonize.split_audit(rows)
    kept, more = harmonize.split_audit(harmonize.routed(kept, versions))
    return harmonize.genome_ids(kept, meta), dropped.unionByName(more), meta, meta_b


def test_routing_and_reasons(flow):
    kept, dropped, _, _ = flow
    assert sorted((r.record_id, r.reason) for r in dropped.collect()) == [("573.1", "not_lab_method"), ("573.2", "no_standard_for_sir_only"), ("573.3", "off_grid_value"), ("573.7", "drug_not_in_panel")]
    got = {(r.genome_id, r.drug, r.raw_result): (r.mic_lower, r.mic_upper) for r in kept.collect()}
    assert got == {
        ("573.1", "meropenem", "=4"): (2.0, 4.0), ("573.1", "meropenem", "=8"): (4.0, 8.0), ("573.2", "meropenem", "S"): (0.0, 1.0), ("573.3", "ciprofloxacin", "<=0.06"): (0.0, 0.0625),
        ("573.4", "piperacillin-tazobactam", ">64/4"): (64.0, mic.INF), ("573.6", "meropenem", "=16"): (8.0, 16.0), ("573.6", "meropenem", "=32"): (16.0, 32.0), ("NCBI_SAMN9", "ciprofloxacin", "<=0.25"): (0.0, 0.25),
    }


def test_metadata_of_two_sources(flow):
    kept, _, meta, meta_b = flow
    out = harmonize.attach_metadata(kept.filter("reason is null"), meta, meta_b)
    assert tuple(out.columns) == harmonize.LABELS
    rows = out.collect()
    nine = next(r for r in rows if r.genome_id == "NCBI_SAMN9")
    assert (nine.country, nine.year, nine.isolation_source, nine.sir) == ("Germany", 2018, None, None)
    assert next(r for r in rows if r.genome_id == "573.1").isolation_source == "blood"
    keys = [(r.species, r.drug, r.genome_id) for r in rows]
    assert keys == sorted(keys)


def test_label_rules(flow, spark):
    kept, _, meta, meta_b = flow
    labels = harmonize.attach_metadata(kept.filter("reason is null"), meta, meta_b).dropDuplicates(["genome_id", "drug"])
    assert validate.label_failures(labels, ("KPNEU",)).count() == 0
    bad = labels.withColumn("country", F.lit("NA")).withColumn("mic_lower", F.col("mic_upper")).unionByName(labels)
    assert {"placeholder in country", "lower not below upper", "repeated key", "left is not lower 0"} <= {r.rule for r in validate.label_failures(bad, ("KPNEU",)).collect()}
    with pytest.raises(ValueError):
        validate.label_failures(labels.drop("year"), ("KPNEU",))
    assert validate.schema_differences(labels, ("genome_id", "other"), ("sir",)) == ["missing column other", "forbidden column sir"]


def test_tags_and_genotypes(spark):
    rows = [("g", 1, "blaKPC-2", "AMR", "AMR", "EXACTX"), ("g", 2, "ompK36", "AMR", "POINT_DISRUPT", "EXACTX"), ("g", 3, "x", "STRESS", "BIOCIDE", "EXACTX"), ("g", 4, "y", "AMR", "AMR", "INTERNAL_STOP"), ("g", 5, "z", "AMR", "AMR", "PARTIAL_CONTIG_ENDX"), ("g", 6, "w", "AMR", "AMR", "PARTIALX"), ("g", 7, "v", "AMR", "AMR", "HMM")]
    df = spark.createDataFrame(rows, "key string, ord int, symbol string, type string, subtype string, method string")
    assert reports.genotype_string(df, "key").first().genotypes == "blaKPC-2,ompK36=POINT,y=MISTRANSLATION,z=PARTIAL_END_OF_CONTIG,w=PARTIAL,v=HMM"
    t = spark.createDataFrame([("a=b=POINT, c=POINT",)], "x string").select(mic.genotype_tokens(F.col("x")).alias("t")).first().t
    assert [tuple(x) for x in t] == [("a", "gene"), ("c", "point")]


def test_small_functions(spark):
    df = spark.createDataFrame([(3.0, 0.01, "gyrA_S83I", "a.FASTA.gz", True), (600.0, 2.0, "ompK36_x_y", "b.fa", False)], "v double, m double, s string, f string, p boolean")
    got = df.select(mic.round_up(F.log2("v")), mic.display_mic(F.col("m")), mic.display_mic(F.col("v")), mic.marker_label(F.col("s"), F.col("p")), mic.sample_id(F.col("f")), mic.steps_between(F.col("v"), F.lit(1.5))).collect()
    assert tuple(got[0])[:5] == (4.0, "≤0.016", "3.00", "gyrA S83I", "a") and abs(got[0][5] - 1) < 1e-12
    assert tuple(got[1])[:5] == (1024.0, "2.00", ">512", "ompK36_x_y", "b")


def test_overrides(spark):
    schema = "k int, drug string, pred_mic double, band_low double, band_high double, p_active double, confidence_level string, call string, margin_steps int, reasons array<string>"
    rows = spark.createDataFrame([(1, d, 1.0, 0.5, 2.0, 0.9, "leans_active", "likely_active", 2, ["r"]) for d in "abc"], schema)
    over = spark.createDataFrame([(1, "a", "natural_resistance", None), (1, "b", "strong_marker", ["y", "x", "y"])], "k int, drug string, kind string, markers array<string>")
    got = {r.drug: r for r in reports.with_overrides(rows, over, ["k", "drug"]).collect()}
    assert (got["a"].pred_mic, got["a"].p_active, got["a"].call, got["a"].margin_steps, got["a"].reasons) == (None, None, "likely_inactive", None, ["r"])
    assert (got["b"].pred_mic, got["b"].reasons, got["b"].call) == (1.0, ["x", "y"], "likely_inactive")
    assert (got["c"].call, got["c"].override) == ("likely_active", None)


def test_genome_qc_and_novelty(spark):
    df = spark.createDataFrame([(1, 0, 0, None, None, None), (2, 600, 4000000, "K", 5600000.0, 0.07), (3, 5, 5500000, None, None, 0.9), (4, 5, 5500000, "K", 5600000.0, None)], "id int, n_contigs int, total_length long, species string, expected double, distance double")
    got = {r.id: r.qc_fail_reason for r in validate.genome_qc(df).collect()}
    assert got == {1: "empty_assembly", 2: "too_fragmented;wrong_genome_size;too_distant", 3: "species_not_covered", 4: None}
    g = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "k string, checked boolean")
    dist = spark.createDataFrame([("a", 0.01), ("a", 0.5), ("b", 0.03), ("c", 0.5)], "k string, distance double")
    assert {r.k: (r.nearest, r.in_range) for r in validate.novelty(g, dist, "k").collect()} == {"a": (0.01, True), "b": (0.03, False), "c": (None, True), "d": (None, False)}


def test_difference_strings(spark):
    schema = "k int, target string, query string, qs int, qe int, strand string, ts int, te int, cs string"
    df = spark.createDataFrame([(1, "ACGTACGT", "ACGAACG", 0, 7, "+", 0, 7, ":3*ta:3"), (2, "ACGTNN", "TTACGT", 2, 6, "-", 0, 4, ":4"), (3, "ACGT", "AC", None, None, None, None, None, None)], schema)
    got = {r.k: (round(r.recall, 6), round(r.precision, 6)) for r in reports.cs_decode(df, "k").collect()}
    assert got == {1: (0.75, round(6 / 7, 6)), 2: (1.0, round(4 / 6, 6)), 3: (0.0, 0.0)}


def test_pairwise_weights(spark):
    df = spark.createDataFrame([(g, c, c / 4 + g / 100, (c * 7 + g) % 4 / 1.0, c / 4) for g in range(20) for c in range(4)], "g int, c int, good double, noise double, target double")
    w = reports.fit_pairwise(reports.pairwise_rank(df, "g", "c", ["good", "noise"], "target"), ["good", "noise"])
    assert w[0] > 1 and abs(w[1]) < w[0] / 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id int, s string, v double")
    sinks.write_summary(df, str(tmp_path / "s"), "\t")
    assert files.text_table(spark, str(tmp_path / "s"), "\t").count() == 2
    sinks.write_artifact(df, str(tmp_path / "a.json"))
    with open(tmp_path / "a.json") as f:
        assert json.load(f)[0] == {"id": 1, "s": "a", "v": 1.5}
    with pytest.raises(ValueError):
        sinks.write_artifact(df, str(tmp_path / "b.json"), most=1)
    with pytest.raises(TypeError):
        sinks.write_json({"x": object()}, str(tmp_path / "a.json"))
    assert sorted(os.listdir(tmp_path)) == ["a.json", "s"]
    root = str(tmp_path / "releases")
    assert sinks.release({"t": df}, root, "v1").first().n == 2
    assert sinks.verify_release(spark, root, "v1").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.release({"t": df}, root, "v1")
    spark.createDataFrame([(1, "a", 9.0), (2, None, 2.5)], df.schema).write.mode("overwrite").parquet(f"{root}/v1/t")
    assert [r.name for r in sinks.verify_release(spark, root, "v1").collect()] == ["t"]
    place = str(tmp_path / "jobs")
    assert sinks.current(spark, place) is None
    sinks.upsert(spark, place, df, ["id"], "v")
    sinks.upsert(spark, place, spark.createDataFrame([(2, "new", 3.5), (1, "old", 0.5), (3, "x", 1.0)], df.schema), ["id"], "v")
    assert sorted((r.id, r.s) for r in sinks.current(spark, place).collect()) == [(1, "a"), (2, "new"), (3, "x")]


def test_more_sources(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<BioSampleSet><BioSample><Ids><Id db="BioSample">S1</Id></Ids><Attributes><Attribute attribute_name="geo" harmonized_name="geo_loc_name">Germany: X</Attribute><Attribute attribute_name="odd">z</Attribute></Attributes><Description><Comment><Table class="Antibiogram.1"><Header><Cell>Antibiotic</Cell><Cell>Measurement Sign</Cell></Header><Body><Row><Cell>meropenem</Cell><Cell>==</Cell></Row><Row><Cell>colistin</Cell><Cell></Cell></Row></Body></Table></Comment></Description></BioSample></BioSampleSet>')
    attributes, results = files.biosamples(spark, str(tmp_path / "b.xml"), ["geo_loc_name"])
    assert [tuple(r) for r in attributes.collect()] == [("S1", "Germany: X")]
    assert sorted((r.biosample, r.cells["antibiotic"], r.cells["measurement_sign"]) for r in results.collect()) == [("S1", "colistin", ""), ("S1", "meropenem", "==")]
    (tmp_path / "rows.csv").write_text("row,column,value\n0,1,1\n1,0,1\n")
    assert files.sparse_matrix(spark, str(tmp_path / "rows.csv"), 2, 2).count() == 2
    with pytest.raises(Exception, match="shape"):
        files.sparse_matrix(spark, str(tmp_path / "rows.csv"), 1, 2).collect()
    (tmp_path / "ref.fa").write_text(">one\n" + "ACGT" * 10 + "\n")
    import hashlib

    good = hashlib.sha256((tmp_path / "ref.fa").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("ref.fa", good, 40)], "file string, sha256 string, length int")
    assert [tuple(r) for r in files.reference_bank(spark, str(tmp_path / "*.fa"), manifest).collect()] == [("ref.fa", "one", 40, None)]
    wrong = spark.createDataFrame([("ref.fa", "0", 40), ("gone.fa", "0", 1)], "file string, sha256 string, length int")
    assert {r.file: r.reason for r in files.reference_bank(spark, str(tmp_path / "*.fa"), wrong).collect()} == {"ref.fa": "checksum_differs", "gone.fa": "missing_file"}


def test_fill_until_classes_are_there():
    names, sizes = [f"c{i}" for i in range(40)], [5] * 40
    counts = {n: {("d", "R"): int(i % 4 == 0) * 5, ("d", "S"): 5 - int(i % 4 == 0) * 5} for i, n in enumerate(names)}
    chosen = splits.fill_with_classes(names, sizes, counts, ["d"], seed=1, least_per_class=5)
    assert 30 <= len(chosen) * 5 <= 40 and sum(counts[c][("d", "R")] for c in chosen) >= 5
    with pytest.raises(ValueError):
        splits.fill_with_classes(names, sizes, {}, ["d"], seed=1)
