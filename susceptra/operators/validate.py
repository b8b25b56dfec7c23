"""Acceptance checks as tables of broken rules: all rules in one pass, an empty result where all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.operators.harmonize import LABELS
from susceptra.operators.relational import violations

#: What the labels may hold.
ALLOWED = {"censor": ("interval", "left", "right"), "sir": ("S", "I", "R"), "method": ("dilution", "gradient", "disk"), "standard": ("CLSI", "EUCAST"), "source": ("BVBRC", "NCBI")}
PLACEHOLDERS = ("", "NA", "nan", "None", "-1")
NEVER_NULL = ("genome_id", "species", "drug", "mic_lower", "mic_upper", "censor", "raw_result", "method", "source")
TEXTS = ("biosample", "sir", "standard", "isolation_source", "country")
QC_COLUMNS = ("genome_id", "n_contigs", "total_length", "n50", "gc_percent", "mash_species", "mash_distance", "qc_pass", "qc_fail_reason")
GRID, FINE_GRID = (*range(20, 100, 10), 100), (*range(20, 100, 10), 95, 98, 100)


def schema_differences(df: DataFrame, wanted: tuple[str, ...], forbidden: tuple[str, ...] = ()) -> list[str]:
    """ST6: what is missing, forbidden or out of order among the columns."""
    missing = [f"missing column {c}" for c in wanted if c not in df.columns]
    banned = [f"forbidden column {c}" for c in forbidden if c in df.columns]
    order = [] if missing or [c for c in df.columns if c in wanted] == list(wanted) else ["columns out of order"]
    return missing + banned + order


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).agg(F.count_if(F.col("__c") > 1).alias("n"))


def label_rules(species: tuple[str, ...]) -> dict[str, Column]:
    lower, upper, censor = F.col("mic_lower"), F.col("mic_upper"), F.col("censor")
    rules = {f"null {c}": F.col(c).isNull() for c in NEVER_NULL}
    rules |= {"lower not below upper": ~(lower < upper), "left is not lower 0": (censor == "left") != (lower == 0), "right is not upper infinite": (censor == "right") != (upper == mic.INF)}
    rules |= {f"unexpected {c}": ~F.col(c).isin(*v) for c, v in {**ALLOWED, "species": species}.items()}
    return rules | {f"placeholder in {c}": mic.strip(F.col(c)).isin(*PLACEHOLDERS) for c in TEXTS}


def label_failures(labels: DataFrame, species: tuple[str, ...]) -> DataFrame:
    """DQ1: (rule, n) of every broken rule of the labels; other columns than theirs raise."""
    if tuple(labels.columns) != LABELS:
        raise ValueError(f"columns differ: {labels.columns}")
    for c in ("standard_year", "year"):
        if dict(labels.dtypes)[c] not in ("int", "bigint"):
            raise ValueError(f"{c} is no whole number")
    twice = repeated_keys(labels, ["genome_id", "drug"]).select(F.lit("repeated key").alias("rule"), "n")
    return violations(labels, label_rules(species)).unionByName(twice).filter("n > 0")


def qc_failures(qc: DataFrame) -> DataFrame:
    """DQ2: (rule, n) of every broken rule of the quality table; a missing column raises."""
    if (wrong := schema_differences(qc, QC_COLUMNS)) or len(qc.columns) != len(QC_COLUMNS):
        raise ValueError(f"columns differ: {wrong or qc.columns}")
    rules = {"null qc_pass": F.col("qc_pass").isNull(), "reason does not match qc_pass": F.col("qc_pass") != F.col("qc_fail_reason").isNull(), "negative n_contigs": F.col("n_contigs") < 0}
    twice = repeated_keys(qc, ["genome_id"]).select(F.lit("repeated key").alias("rule"), "n")
    return violations(qc, rules).unionByName(twice).filter("n > 0")


def genome_qc(rows: DataFrame, max_contigs: int = 500, size_tolerance: float = 0.20, max_distance: float = 0.05) -> DataFrame:
    """DQ4: rows (n_contigs, total_length, species, expected, distance) plus qc_fail_reason and qc_pass.

    expected is null where the species is; an unknown distance does not fail.
    """
    covered = F.col("species").isNotNull()
    checks = ((F.col("n_contigs") > max_contigs, "too_fragmented"), (~covered, "species_not_covered"), (covered & (F.abs(F.col("total_length") / F.col("expected") - 1) > size_tolerance), "wrong_genome_size"), (covered & (F.col("distance") > max_distance), "too_distant"))
    joined = F.nullif(F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]), F.lit(""))
    out = rows.withColumn("qc_fail_reason", F.when(F.coalesce("n_contigs", F.lit(0)) == 0, "empty_assembly").otherwise(joined))
    return out.withColumn("qc_pass", F.col("qc_fail_reason").isNull())


def identified(distances: DataFrame, key: str, max_distance: float = 0.05) -> DataFrame:
    """DQ5: (key, ord, reference, distance) -> (key, reference, distance): the nearest, the first line on ties; null beyond the bound."""
    best = distances.groupBy(key).agg(F.min(F.struct("distance", "ord", "reference")).alias("b"))
    return best.select(key, F.when(F.col("b.distance") <= max_distance, F.col("b.reference")).alias("reference"), F.col("b.distance").alias("distance"))


def novelty(genomes: DataFrame, distances: DataFrame, key: str, max_distance: float = 0.02) -> DataFrame:
    """DQ6: genomes (key, checked) -> plus nearest, in_range: unchecked genomes count as in range, checked ones without a distance do not."""
    near = distances.groupBy(key).agg(F.min("distance").alias("nearest"))
    out = genomes.join(near, key, "left").withColumn("nearest", F.when(F.col("checked"), F.col("nearest")))
    return out.withColumn("in_range", ~F.col("checked") | F.coalesce(F.col("nearest") <= max_distance, F.lit(False)))


def report_rules() -> dict[str, Column]:
    """DQ7: the rules of a report's drug rows."""
    three = [F.col(c).isNull().cast("int") for c in ("pred_mic", "band_low", "band_high")]
    missing = three[0] + three[1] + three[2]
    return {
        "mic fields set in part": ~missing.isin(0, 3), "mic outside its band": ~((F.col("band_low") <= F.col("pred_mic")) & (F.col("pred_mic") <= F.col("band_high"))),
        "breakpoints out of order": F.col("s_breakpoint") > F.col("r_breakpoint"), "probability without level": F.col("p_active").isNull() != F.col("confidence_level").isNull(),
        "override of another call": F.col("override").isNotNull() & (F.col("call") != "likely_inactive"), "ranked but not active": F.col("rank").isNotNull() & (F.col("call") != "likely_active"),
    }


def report_failures(rows: DataFrame) -> DataFrame:
    return violations(rows, report_rules()).filter("n > 0")


def matrix_failures(labels: DataFrame, species: tuple[str, ...]) -> DataFrame:
    """DQ9: duplicate keys, inverted bounds, unknown species, genomes of several species."""
    plain = violations(labels, {"inverted bounds": ~(F.col("mic_lower") < F.col("mic_upper")), "unknown species": ~F.col("species").isin(*species)})
    twice = repeated_keys(labels, ["genome_id", "drug"]).select(F.lit("repeated key").alias("rule"), "n")
    mixed = labels.groupBy("genome_id").agg(F.count_distinct("species").alias("__c")).agg(F.count_if(F.col("__c") > 1).alias("n")).select(F.lit("several species").alias("rule"), "n")
    return plain.unionByName(twice).unionByName(mixed).filter("n > 0")


def step_failures(steps: DataFrame, states: DataFrame, fine: bool = False) -> DataFrame:
    """DQ10: steps (session, species, percent, observed) against states (session, species, percent, bases, sha256) -> steps plus reason.

    A session starts at 20 or 100; each further step is the next of the schedule, of the same species, and extends exactly
    the sequence of the step before.
    """
    grid = FINE_GRID if fine else GRID
    nxt = F.lit(None).cast("int")
    for a, b in zip(grid, grid[1:], strict=False):
        nxt = F.when(F.col("__percent") == a, F.lit(b)).otherwise(nxt)
    old = states.select("session", F.col("species").alias("__species"), F.col("percent").alias("__percent"), F.col("bases").alias("__bases"), F.col("sha256").alias("__sha"))
    j = steps.join(old, "session", "left")
    known, n = F.col("__percent").isNotNull(), F.length("observed")
    prefix = F.sha2(F.expr("substring(observed, 1, __bases)"), 256)
    reason = (
        F.when(~F.col("percent").isin(*grid), "percentage_not_scheduled").when(~known & ~F.col("percent").isin(20, 100), "session_starts_elsewhere")
        .when(known & (F.col("__species") != F.col("species")), "species_changed").when(known & ((n < F.col("__bases")) | (prefix != F.col("__sha"))), "prefix_changed")
        .when(known & ~F.col("percent").eqNullSafe(nxt), "not_the_next_step").when(known & (n <= F.col("__bases")), "no_more_sequence")
    )
    return j.withColumn("reason", reason).select(*steps.columns, "reason")


def leakage_failures(rows: DataFrame, unit: str, cluster: str) -> DataFrame:
    """AG13, EX6: rows (unit, cluster, split, fold): clusters or units in several splits or folds, and train rows without a fold."""
    per = lambda k, rule: rows.groupBy(k).agg(F.greatest(F.count_distinct("split"), F.count_distinct("fold")).alias("__c")).agg(F.count_if(F.col("__c") > 1).alias("n")).select(F.lit(rule).alias("rule"), "n")
    plain = violations(rows, {"train row without fold": (F.col("split") == "train") & F.col("fold").isNull(), "test row with fold": (F.col("split") == "test") & F.col("fold").isNotNull()})
    return plain.unionByName(per(cluster, "cluster in several splits")).unionByName(per(unit, "unit in several splits")).filter("n > 0")
