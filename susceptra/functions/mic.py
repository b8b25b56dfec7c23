"""Column functions of the susceptibility domain; null-safe, and native but for normal_cdf."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from susceptra.functions.normal import cdf

INF = float("inf")
#: Keyword -> class, first match wins.
METHOD_KEYWORDS = (("disk", "disk"), ("kirby", "disk"), ("zone", "disk"), ("etest", "gradient"), ("e-test", "gradient"), ("gradient", "gradient"), ("strip", "gradient"), ("broth", "dilution"), ("microdilution", "dilution"), ("agar dilution", "dilution"), ("dilution", "dilution"), ("mic", "dilution"))
# Keywords, units, phenotypes, signs, standards, missing texts, and the levels with their lower edges.
ISOLATION_KEYWORDS = (("blood", "blood"), ("bacteremia", "blood"), ("urin", "urine"), ("sputum", "respiratory"), ("bronch", "respiratory"), ("trache", "respiratory"), ("lung", "respiratory"), ("respir", "respiratory"), ("rectal", "gut"), ("stool", "gut"), ("feces", "gut"), ("faeces", "gut"), ("fecal", "gut"), ("perianal", "gut"), ("wound", "wound"), ("pus", "wound"), ("abscess", "wound"))
UNITS = ("mg/l", "ug/ml", "µg/ml", "μg/ml", "mcg/ml")
PHENOTYPES = {"susceptible": "S", "intermediate": "I", "susceptible-dose dependent": "I", "resistant": "R"}
SIGNS = {"": "=", "=": "=", "==": "=", "<=": "<=", "≤": "<=", "=<": "<=", "<": "<", ">": ">", ">=": ">=", "≥": ">=", "=>": ">="}
STANDARDS = {"clsi": "CLSI", "eucast": "EUCAST"}
MISSING = ("", "na", "n/a", "nan", "none", "missing", "unknown", "not collected", "not applicable", "not provided")
SNAP_TOLERANCE = 0.05
LEVEL_EDGES = (0.02, 0.10, 0.30, 0.70, 0.90, 0.98)
LEVEL_NAMES = ("very_likely_inactive", "probably_inactive", "leans_inactive", "unclear", "leans_active", "probably_active", "very_likely_active")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lookup(x: Column, table: dict[str, str]) -> Column:
    """A small fixed mapping as CASE; null where absent."""
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def first_keyword(x: Column, keywords, default: str | None = None) -> Column:
    """PR6, PR7: the class of the first keyword, in list order, that the lower-cased text holds; null text stays null."""
    low, out = F.lower(x), F.lit(default).cast("string")
    for k, v in reversed(keywords):
        out = F.when(F.contains(low, F.lit(k)), F.lit(v)).otherwise(out)
    return F.when(x.isNotNull(), out)


def clean_text(x: Column) -> Column:
    """PR18: stripped text, null for the placeholder words."""
    s = strip(x)
    return F.when(~F.lower(s).isin(*MISSING), s)


def alias_key(x: Column) -> Column:
    """PR5."""
    return F.regexp_replace(F.translate(F.lower(strip(x)), "/ ", "--"), "-+", "-")


def phenotype_sir(x: Column) -> Column:
    """PR8."""
    return lookup(F.lower(strip(x)), PHENOTYPES)


def standard_name(x: Column) -> Column:
    return lookup(F.lower(strip(x)), STANDARDS)


def normal_sign(x: Column) -> Column:
    """PR10: null is the empty sign; unknown signs give null."""
    return lookup(strip(F.coalesce(x, F.lit(""))), SIGNS)


def first_number(x: Column) -> Column:
    """PR11: the number the text starts with; null where there is none."""
    return F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?|\.\d+)", 1).try_cast("double")


def known_unit(x: Column) -> Column:
    """PR12."""
    return F.lower(strip(x)).isin(*UNITS)


def snap(v: Column, tolerance: float = SNAP_TOLERANCE) -> Column:
    """PR13: the nearest doubling step within the relative tolerance, else null."""
    step = F.pow(F.lit(2.0), F.round(F.log2(v)))
    return F.when((v > 0) & (F.abs(v - step) / step <= tolerance), step)


def from_mic(sign: Column, v: Column) -> Column:
    """PR14: struct (lower, upper]; null for any other sign."""
    lower = F.when(sign.isin("=", ">="), v / 2).when(sign.isin("<=", "<"), 0.0).when(sign == ">", v)
    upper = F.when(sign.isin(">", ">="), F.lit(INF)).when(sign.isin("=", "<=", "<"), v)
    return F.when(lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper")))


def from_sir(sir: Column, s: Column, r: Column) -> Column:
    """PR15."""
    lower = F.when(sir == "S", 0.0).when(sir == "R", r).when((sir == "I") & (s < r), s)
    upper = F.when(sir == "S", s).when(sir == "R", F.when(r.isNotNull(), F.lit(INF))).when((sir == "I") & (s < r), r)
    return F.when(lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper")))


def censor(lower: Column, upper: Column) -> Column:
    """PR22."""
    return F.when(lower == 0, "left").when(upper == INF, "right").otherwise("interval")


def year_of(x: Column) -> Column:
    """PR19."""
    s = strip(x)
    y = F.substring(s, 1, 4).try_cast("int")
    return F.when(s.rlike("^[0-9]{4}") & y.between(1900, 2100), y)


def country_of(x: Column) -> Column:
    """PR20."""
    return F.split_part(x, F.lit(":"), F.lit(1))


def column_name(prefix: str, symbol: Column) -> Column:
    """PR24."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(symbol), "[^a-z0-9]+", "_"), "^_|_$", ""))


def family(symbol: Column, kept: tuple[str, ...] = ()) -> Column:
    """PR25: bla alleles collapse to their family unless the family is kept apart."""
    collapse = F.startswith(symbol, F.lit("bla"))
    for k in kept:
        collapse = collapse & ~F.startswith(symbol, F.lit(k))
    return F.when(collapse, F.regexp_replace(symbol, "-[0-9]+$", "")).otherwise(symbol)


def genotype_tokens(x: Column) -> Column:
    """PR26: array of (symbol, kind) of a genotype list, without broken entries."""
    first = lambda t: F.substring_index(t, "=", 1)
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.struct(first(strip(t)).alias("symbol"), F.substring(strip(t), F.length(first(strip(t))) + 2, F.length(t)).alias("tag")))
    kept = F.filter(parts, lambda p: (p["symbol"] != "") & (p["tag"] != "MISTRANSLATION"))
    return F.transform(kept, lambda p: F.struct(p["symbol"].alias("symbol"), F.when(p["tag"] == "POINT", "point").otherwise("gene").alias("kind")))


def hit_tag(method: Column, subtype: Column) -> Column:
    """PR27: order matters, points go by subtype; empty where no tag is due."""
    m, s = F.coalesce(method, F.lit("")), F.coalesce(subtype, F.lit(""))
    tag = F.when(F.startswith(s, F.lit("POINT")), "POINT").when(m == "INTERNAL_STOP", "MISTRANSLATION")
    tag = tag.when(F.startswith(m, F.lit("PARTIAL_CONTIG_END")), "PARTIAL_END_OF_CONTIG").when(F.startswith(m, F.lit("PARTIAL")), "PARTIAL")
    return tag.when(m == "HMM", "HMM").otherwise("")


def log2_bound(x: Column) -> Column:
    """PR29."""
    return F.when(x == 0, F.lit(-INF)).when(x == INF, F.lit(INF)).otherwise(F.log2(x))


def round_up(log2_value: Column) -> Column:
    """PR30."""
    return F.pow(F.lit(2.0), F.ceil(log2_value - 1e-9))


def steps_between(a: Column, b: Column) -> Column:
    """PR31."""
    return F.log2(a) - F.log2(b)


def sir_of_mic(v: Column, s: Column, r: Column) -> Column:
    """PR32."""
    return F.when(v <= s, "S").when(v > r, "R").when(v.isNotNull() & s.isNotNull() & r.isNotNull(), "I")


def _normal_cdf(z: pd.Series) -> pd.Series:
    p = cdf(z.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p))


def normal_cdf(z: Column) -> Column:
    """PR33: erfc has no Spark function; numpy on Arrow batches. Null and nan give null."""
    return F.pandas_udf(_normal_cdf, "double")(z)


def confidence_level(p: Column) -> Column:
    """PR34: lower edges belong to the level above; a probability outside 0..1 raises."""
    out = F.lit(LEVEL_NAMES[0])
    for edge, name in zip(LEVEL_EDGES, LEVEL_NAMES[1:], strict=True):
        out = F.when(p >= edge, F.lit(name)).otherwise(out)
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p.between(0, 1), out).otherwise(F.raise_error(F.lit("a probability outside 0..1")).cast("string"))


def active_call(low: Column, high: Column, p: Column, s: Column, r: Column, active_min: Column, inactive_max: Column) -> Column:
    """PR35: thresholds where the pair has them and p is known, else the band; struct (call, margin)."""
    by_p = active_min.isNotNull() & p.isNotNull()
    active = F.when(by_p, p >= active_min).otherwise(high <= s)
    inactive = F.when(by_p, p <= inactive_max).otherwise(low > r)
    call = F.when(s.isNull() | r.isNull(), "uncertain").when(active, "likely_active").when(inactive, "likely_inactive").otherwise("uncertain")
    margin = F.when(call == "likely_active", F.greatest(F.lit(0), F.round(F.log2(s) - F.log2(high)).cast("int")))
    return F.struct(call.alias("call"), margin.alias("margin"))


def marker_label(symbol: Column, is_point: Column) -> Column:
    """PR37."""
    return F.when(is_point, F.regexp_replace(symbol, "^([^_]*)_", "$1 ")).otherwise(symbol)


def sample_id(name: Column) -> Column:
    """PR43."""
    return F.left(F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.(fasta|fa|fna)$", ""), F.lit(128))


def display_mic(v: Column) -> Column:
    """PR42."""
    return F.when(v <= 2.0**-6, F.lit("≤0.016")).when(v > 512, F.lit(">512")).otherwise(F.format_string("%.3g", v))
