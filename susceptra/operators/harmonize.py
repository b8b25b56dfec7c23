"""Two sources of laboratory results under one layout, routed to intervals: one projection and one pass, no union per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.operators.relational import asof_backward, consensus, first_in_group, with_reason
from susceptra.storage import free_name

#: Fixed value: the evidence class that counts.
LAB_EVIDENCE = "Laboratory Method"
LAYOUT = ("source", "record_id", "own_id", "biosample", "organism", "antibiotic", "phenotype", "sign", "value", "unit", "method_text", "standard_text", "standard_year", "evidence")
LABELS = ("genome_id", "biosample", "species", "drug", "mic_lower", "mic_upper", "censor", "sir", "raw_result", "method", "standard", "standard_year", "source", "isolation_source", "country", "year")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def source_a(results: DataFrame, meta: DataFrame) -> DataFrame:
    """PR1: results by genome id, biosample and organism from the metadata (one row per genome_id)."""
    known = meta.select("genome_id", F.col("biosample_accession").alias("__b"), F.col("species").alias("__o"))
    r = results.join(known, "genome_id", "left")
    year = F.col("testing_standard_year").cast("int") if "testing_standard_year" in r.columns else F.lit(None).cast("int")
    own = F.col("genome_id").cast("string")
    values = (F.lit("BVBRC"), own, own, F.col("__b"), F.col("__o"), _text(r, "antibiotic"), _text(r, "resistant_phenotype"), _text(r, "measurement_sign"), _text(r, "measurement_value"), _text(r, "measurement_unit"), _text(r, "laboratory_typing_method"), _text(r, "testing_standard"), year, _text(r, "evidence"))
    return r.select(*[v.alias(n) for v, n in zip(values, LAYOUT, strict=True)])


def source_b(results: DataFrame) -> DataFrame:
    """PR1: results by biosample; all are laboratory results and none names a year."""
    b = _text(results, "biosample")
    values = (F.lit("NCBI"), b, F.lit(""), b, _text(results, "organism"), _text(results, "antibiotic"), _text(results, "resistance_phenotype"), _text(results, "measurement_sign"), _text(results, "measurement"), _text(results, "measurement_units"), _text(results, "laboratory_typing_method"), _text(results, "testing_standard"), F.lit(None).cast("int"), F.lit(LAB_EVIDENCE))
    return results.select(*[v.alias(n) for v, n in zip(values, LAYOUT, strict=True)])


def split_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PR2: (rows without a reason, (source, record_id, reason) of the others)."""
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null").select("source", "record_id", "reason")


def species_of(organism: Column, names: dict[str, str]) -> Column:
    """PR4: the species whose name the organism's text starts with (whole words), longest name first."""
    out = F.lit(None).cast("string")
    clean = F.lower(mic.strip(F.coalesce(organism, F.lit(""))))
    for name in sorted(names, key=len):
        low = name.lower()
        out = F.when((clean == low) | F.startswith(clean, F.lit(low + " ")), F.lit(names[name])).otherwise(out)
    return out


def admitted(rows: DataFrame, species: dict[str, str], drugs: dict[str, str]) -> DataFrame:
    """PR3 to PR8: rows plus species, drug, method, sir, standard and reason. Mappings are small fixed panels; aliases are normalised."""
    panel = {a.strip().lower().replace("/", "-").replace(" ", "-"): d for a, d in drugs.items()}
    r = rows.withColumn("species", species_of(F.col("organism"), species)).withColumn("drug", mic.lookup(mic.alias_key(F.col("antibiotic")), panel))
    r = r.withColumn("method", mic.first_keyword(F.col("method_text"), mic.METHOD_KEYWORDS)).withColumn("sir", mic.phenotype_sir(F.col("phenotype"))).withColumn("standard", mic.standard_name(F.col("standard_text")))
    return with_reason(r, [
        (~F.col("evidence").eqNullSafe(LAB_EVIDENCE), "not_lab_method"), (F.col("species").isNull(), "species_out_of_scope"),
        (F.col("drug").isNull(), "drug_not_in_panel"), (F.col("method").isNull(), "unknown_method"),
    ])


def takes_mic(method: Column, value: Column) -> Column:
    """PR9: dilution and gradient results with a value; all others go by their category. A row that fails is not rerouted."""
    return method.isin("dilution", "gradient") & (mic.strip(F.coalesce(value, F.lit(""))) != "")


def routed(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """PR9 to PR16, JN7, JN8: admitted rows plus mic_lower, mic_upper, censor, raw_result and reason.

    versions (species, drug, standard, effective_year, s, r) serve the rows of the category path: the edition in force in
    standard_year, or, where no year is known, what all editions agree on.
    """
    keys, columns = ["species", "drug", "standard"], rows.columns
    key, own_s, own_r, by, sign, number, step, i, s, res = (free_name(rows, x) for x in ("__row", "__s", "__r", "__by_mic", "__sign", "__number", "__step", "__interval", "s", "r"))
    editions = versions.select(*keys, "effective_year", F.col("s").alias(s), F.col("r").alias(res))
    by_year = asof_backward(rows.withColumn(key, F.lit(0)), editions, keys, "standard_year").drop("effective_year", key)
    agreed = consensus(versions, ["species", "drug"]).select(*keys, F.col("s").alias(own_s), F.col("r").alias(own_r))
    # each step is a column before the next uses it: written into one another, the branches repeat them beyond what can be compiled
    r = by_year.join(agreed, keys, "left").withColumns({by: takes_mic(F.col("method"), F.col("value")), sign: mic.normal_sign(F.col("sign")), number: mic.first_number(F.col("value"))})
    r = r.withColumn(step, mic.snap(F.col(number)))
    unknown = F.col("standard_year").isNull()
    low, high = F.when(unknown, F.col(own_s)).otherwise(F.col(s)), F.when(unknown, F.col(own_r)).otherwise(F.col(res))
    r = r.withColumn(i, F.when(F.col(by), mic.from_mic(F.col(sign), F.col(step))).otherwise(mic.from_sir(F.col("sir"), low, high)))
    by_mic, no_unit = F.col(by), ~F.coalesce(mic.known_unit(F.col("unit")), F.lit(False))
    r = with_reason(r, [
        (by_mic & (F.col(sign).isNull() | F.col(number).isNull()), "unparseable_value"), (by_mic & no_unit, "bad_unit"), (by_mic & F.col(step).isNull(), "off_grid_value"),
        (~by_mic & F.col("sir").isNull(), "no_value_no_phenotype"), (~by_mic & F.col("standard").isNull(), "no_standard_for_sir_only"), (~by_mic & F.col(i).isNull(), "no_breakpoint"),
    ])
    lower, upper = F.col(f"{i}.lower"), F.col(f"{i}.upper")
    r = r.withColumn("mic_lower", lower).withColumn("mic_upper", upper).withColumn("censor", F.when(F.col(i).isNotNull(), mic.censor(lower, upper)))
    r = r.withColumn("raw_result", F.when(by_mic, F.concat(F.col(sign), mic.strip(F.col("value")))).otherwise(F.col("sir")))
    made = ("reason", "mic_lower", "mic_upper", "censor", "raw_result")
    return r.select(*[c for c in columns if c not in made], *made)


def genome_ids(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """PR17, AG5, AG6: rows plus genome_id and reason: the biosample's genome of fewest contigs, else the row's own id.

    meta (genome_id, biosample_accession, contigs). Genomes that then have several species are rejected.
    """
    m = meta.select(F.col("genome_id").cast("string").alias("__g"), mic.clean_text(F.col("biosample_accession")).alias("__b"), F.col("contigs").try_cast("long").alias("__c")).filter("__b is not null")
    canonical = m.groupBy("__b").agg(F.min(F.struct(F.col("__c").isNull(), "__c", "__g")).alias("best")).select("__b", F.col("best.__g").alias("__canonical"))
    r = rows.withColumn("biosample", mic.clean_text(F.col("biosample"))).join(canonical, F.col("biosample") == F.col("__b"), "left")
    own = F.when(F.col("source") == "BVBRC", F.col("own_id")).otherwise(F.concat(F.lit("NCBI_"), F.coalesce("biosample", F.lit(""))))
    r = r.withColumn("genome_id", F.coalesce("__canonical", own)).drop("__b", "__canonical")
    mixed = r.groupBy("genome_id").agg(F.count_distinct("species").alias("__n")).filter("__n > 1")
    return with_reason(r.join(mixed, "genome_id", "left"), [(F.col("__n").isNotNull(), "species_conflict")]).drop("__n")


def attach_metadata(labels: DataFrame, meta_a: DataFrame, meta_b: DataFrame) -> DataFrame:
    """PR18 to PR21, PR23: metadata of source A before that of source B, in the layout and total order of the labels."""
    c = mic.clean_text
    a = meta_a.select(F.col("genome_id").cast("string").alias("genome_id"), c(F.col("biosample_accession")).alias("__b"), c(F.col("isolation_source")).alias("__sa"), c(F.col("isolation_country")).alias("__ca"), mic.year_of(F.col("collection_year").cast("string")).alias("__ya"))
    b = first_in_group(meta_b, ["biosample"], F.col("collection_date"), F.col("geo_loc_name"), F.col("isolation_source"))
    b = b.select("biosample", c(F.col("isolation_source")).alias("__sb"), c(mic.country_of(F.col("geo_loc_name"))).alias("__cb"), mic.year_of(F.col("collection_date").cast("string")).alias("__yb"))
    out = labels.join(a, "genome_id", "left").withColumn("biosample", F.coalesce("biosample", "__b")).join(b, "biosample", "left")
    out = out.withColumn("isolation_source", mic.first_keyword(F.coalesce("__sa", "__sb"), mic.ISOLATION_KEYWORDS, "other")).withColumn("country", F.coalesce("__ca", "__cb")).withColumn("year", F.coalesce("__ya", "__yb"))
    return out.select(*LABELS).orderBy("species", "drug", "genome_id")
