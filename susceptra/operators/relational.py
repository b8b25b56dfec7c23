"""Audit filters, as-of joins, first-in-group, duplicate resolution, pivots, metrics and thresholds over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.functions import mic


def with_reason(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """PR2: a column reason, the first failing rule's; rules that are null do not fail."""
    reason = F.lit(None).cast("string")
    for failed, name in reversed(rules):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def resolve_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG1, AG2: rows (keys, ord, lower, upper, sir, raw) -> one row per key with lower, upper, sir, raw, n and reason.

    reason is conflict_s_vs_r, conflict_gt_1_step or null; one aggregate, which gathers a key's
    reading texts to join the distinct ones in the order of ord: readings of one key are few. streaming/merging.py keeps bounds and
    distinct texts only.
    """
    best = F.max(F.struct("lower", "upper", (-F.col("ord")).alias("o")))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("lower").alias("low"), F.min("upper").alias("high"), best.alias("best"),
        F.max(F.coalesce(F.col("sir") == "S", F.lit(False))).alias("has_s"), F.max(F.coalesce(F.col("sir") == "R", F.lit(False))).alias("has_r"), F.max(F.coalesce(F.col("sir") == "I", F.lit(False))).alias("has_i"),
        F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("readings"),
    )
    meets = F.col("low") < F.col("high")
    apart = F.log2(F.col("low") / F.when(F.col("high") > 0, F.col("high"))) + 1 > 1
    reason = F.when(F.col("n") == 1, None).when(F.col("has_s") & F.col("has_r"), "conflict_s_vs_r").when(~meets & apart, "conflict_gt_1_step")
    return g.select(
        *keys, F.when(meets, F.col("low")).otherwise(F.col("best.lower")).alias("lower"), F.when(meets, F.col("high")).otherwise(F.col("best.upper")).alias("upper"),
        F.when(F.col("has_r"), "R").when(F.col("has_i"), "I").when(F.col("has_s"), "S").alias("sir"),
        F.array_join(F.array_distinct(F.transform("readings", lambda x: x["raw"])), "|").alias("raw"), "n", reason.cast("string").alias("reason"),
    )


def pair_counts(labels: DataFrame, keys: list[str], min_s: int = 50, min_ns: int = 50, min_mic: int = 4) -> DataFrame:
    """AG3, AG4."""
    exact = F.forall(F.split("raw", r"\|"), lambda p: F.startswith(p, F.lit("=")))
    c = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("sir") == x).alias(f"n_{x.lower()}") for x in "SIR"],
        F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_censored"), F.count_distinct(F.when(exact, F.col("upper"))).alias("n_distinct_mic"),
    )
    c = c.withColumn("n_nonsusceptible", F.col("n_i") + F.col("n_r"))
    return c.withColumn("kept", (F.col("n_nonsusceptible") >= min_ns) & (F.col("n_s") >= min_s) & (F.col("n_distinct_mic") >= min_mic))


def first_in_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """AG6-AG8, AG32, ST3: the first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def validity_ranges(versions: DataFrame, keys: list[str], year: str = "effective_year") -> DataFrame:
    """JN7: versions plus valid_to, the next version's year: as-of becomes an equi-join with a range on a small side."""
    return versions.withColumn("valid_to", F.lead(year).over(W.partitionBy(*keys).orderBy(year)))


def asof_backward(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, year: str = "effective_year") -> DataFrame:
    """JN7: facts left-joined to the latest version whose year is not after theirs. Spark broadcasts versions where they are small."""
    v = validity_ranges(versions, keys, year)
    on = [facts[k] == v[k] for k in keys] + [facts[at] >= v[year], v["valid_to"].isNull() | (facts[at] < v["valid_to"])]
    joined = facts.join(v, on, "left")
    for k in keys:
        joined = joined.drop(v[k])
    return joined.drop("valid_to")


def consensus(versions: DataFrame, keys: list[str], standard: str = "standard", year: str = "effective_year") -> DataFrame:
    """JN8: (keys, standard, s, r) of pairs in the standard's oldest edition on which all editions agree."""
    oldest = versions.groupBy(standard).agg(F.min(year).alias("__oldest"))
    g = versions.groupBy(*keys, standard).agg(F.min(year).alias("__first"), F.count_distinct(F.struct("s", "r")).alias("__n"), F.max("s").alias("s"), F.max("r").alias("r"))
    return g.join(oldest, standard).filter("__first = __oldest and __n = 1").select(*keys, standard, "s", "r")


def presence_pivot(hits: DataFrame, key: str, column: str, values: list[str], counts: bool = False, limit: int = 127) -> DataFrame:
    """AG9, AG10: wide 0/1 or clipped counts with a fixed list of columns."""
    wide = hits.groupBy(key).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.least(F.coalesce(F.col(f"`{v}`"), F.lit(0)), F.lit(limit if counts else 1)).cast("int").alias(v) for v in values])


def n50(lengths: DataFrame, keys: list[str], length: str) -> DataFrame:
    """AG29: the length at which lengths, longest first, reach half of their sum. Equal lengths are summed before they are ranked."""
    g = lengths.groupBy(*keys, length).agg(F.sum(length).alias("w"))
    w = W.partitionBy(*keys)
    ranked = g.withColumn("upto", F.sum("w").over(w.orderBy(F.col(length).desc()).rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(w))
    return ranked.filter("upto * 2 >= total").groupBy(*keys).agg(F.max(length).alias("n50"))


def interval_coverage(hits: DataFrame, key: str, start: str, end: str, weight: str) -> DataFrame:
    """AG30: covered length, and length-weighted best weight, of the union of intervals per key."""
    points = hits.select(key, F.explode(F.array(start, end)).alias("p")).distinct()
    segments = points.withColumn("q", F.lead("p").over(W.partitionBy(key).orderBy("p"))).filter("q is not null")
    s, h = segments.alias("s"), hits.alias("h")
    inside = s.join(h, (F.col(f"s.{key}") == F.col(f"h.{key}")) & (F.col(f"h.{start}") <= F.col("s.p")) & (F.col(f"h.{end}") >= F.col("s.q")))
    best = inside.groupBy(F.col(f"s.{key}").alias(key), "s.p", "s.q").agg(F.max(f"h.{weight}").alias("w"))
    size = F.col("q") - F.col("p")
    return best.groupBy(key).agg(F.sum(size).alias("covered"), F.sum(size * F.col("w")).alias("weighted"))


def agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG15, AG17: rows (pred, low, high, lab_lower, lab_upper, pred_sir, lab_sir) -> rates; undefined ones are null."""
    exact = (F.col("lab_lower") > 0) & (F.col("lab_upper") < mic.INF)
    step = F.abs(F.log2("pred") - F.log2("lab_upper"))
    rate = lambda of, given: F.avg(F.when(given, of.cast("double")))
    known = F.col("pred_sir").isNotNull() & F.col("lab_sir").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("n_exact"),
        rate(F.col("pred_sir") == "S", known & (F.col("lab_sir") == "R")).alias("vme"), rate(F.col("pred_sir") == "R", known & (F.col("lab_sir") == "S")).alias("me"),
        rate((F.col("pred_sir") != F.col("lab_sir")) & ((F.col("pred_sir") == "I") | (F.col("lab_sir") == "I")), known).alias("mine"),
        rate(F.col("pred_sir") == F.col("lab_sir"), known).alias("categorical"), rate(step <= 1.0 + 1e-9, exact).alias("essential"), rate(step < 1e-9, exact).alias("exact"),
        F.avg(((F.col("high") > F.col("lab_lower")) & (F.col("low") <= F.col("lab_upper"))).cast("double")).alias("coverage"), F.avg(F.log2("high") - F.log2("low")).alias("width"),
    )


def auroc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """AG16: rank-sum with half credit for ties, over (score) groups: ties are summed before anything is ranked."""
    g = rows.groupBy(*keys, score).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    won = g.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    pairs = F.sum("p") * F.sum("q")
    return won.groupBy(*keys).agg(F.when(pairs > 0, F.sum("won") / F.when(pairs > 0, pairs)).alias("auroc"))


def conformal_quantile(rows: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """AG18: the k-th smallest, k = min(ceil((n + 1) level), n), found over counts of distinct values."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys)
    g = g.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    k = F.least(F.ceil((F.col("n") + 1) * F.lit(level)), F.col("n"))
    return g.filter(F.col("upto") >= k).groupBy(*keys).agg(F.min(value).alias("q"), F.first("n").alias("n"))


def conformal_fit(rows: DataFrame, pair: str, drug: str, value: str, level: float, min_rows: int = 20) -> DataFrame:
    """AG19: pair, else drug, else global quantile, with its source. rows (pair column, drug, value)."""
    own, wider = conformal_quantile(rows, [pair, drug], value, level), conformal_quantile(rows, [drug], value, level).select(drug, F.col("q").alias("dq"), F.col("n").alias("dn"))
    everything = conformal_quantile(rows.withColumn("__all", F.lit(1)), ["__all"], value, level).select(F.lit(1).alias("__one"), F.col("q").alias("gq"))
    pairs = rows.select(pair, drug).distinct().withColumn("__one", F.lit(1))
    j = pairs.join(own, [pair, drug], "left").join(wider, drug, "left").join(F.broadcast(everything), "__one", "left")
    near, mid = F.coalesce(F.col("n"), F.lit(0)) >= min_rows, F.coalesce(F.col("dn"), F.lit(0)) >= min_rows
    return j.select(pair, drug, F.when(near, F.col("q")).when(mid, F.col("dq")).otherwise(F.coalesce("gq", F.lit(1.0))).alias("q"), F.coalesce("n", F.lit(0)).alias("n_exact"), F.when(near, "pair").when(mid, "drug").otherwise("global").alias("source"))


def thresholds(rows: DataFrame, keys: list[str], p: str, resistant: str, vme: float = 0.01, me: float = 0.03, min_class: int = 20, steps: int = 200) -> DataFrame:
    """AG22: smallest active_min and largest inactive_max on the grid i / steps that keep the error targets.

    Probabilities are counted per grid cell first: the grid meets at most steps + 1 cells a key, never the rows.
    """
    up, down = F.floor(F.col(p) * steps + 1e-9).cast("int"), F.ceil(F.col(p) * steps - 1e-9).cast("int")
    cells = rows.select(*keys, F.when(F.col(resistant), up).otherwise(down).alias("cell"), F.col(resistant).alias("r")).groupBy(*keys, "cell").agg(F.count_if("r").alias("r"), F.count_if(~F.col("r")).alias("s"))
    totals = cells.groupBy(*keys).agg(F.sum("r").alias("nr"), F.sum("s").alias("ns")).filter((F.col("nr") >= min_class) & (F.col("ns") >= min_class))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("cell", F.col("i"))
    laid = grid.join(cells, [*keys, "cell"], "left").fillna(0, ["r", "s"])
    w = W.partitionBy(*keys).orderBy("i")
    laid = laid.withColumn("r_at_or_above", F.sum("r").over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("s_at_or_below", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = laid.groupBy(*keys).agg(F.first("nr").alias("n_resistant"), F.first("ns").alias("n_susceptible"), F.min(F.when(F.col("r_at_or_above") <= vme * F.col("nr"), F.col("i") / steps)).alias("a"), F.max(F.when(F.col("s_at_or_below") <= me * F.col("ns"), F.col("i") / steps)).alias("b"))
    a, b = F.coalesce("a", F.lit(1.01)), F.coalesce("b", F.lit(-0.01))
    return found.select(*keys, F.when(b >= a, (a + b) / 2).otherwise(a).alias("active_min"), F.when(b >= a, (a + b) / 2 - 1e-9).otherwise(b).alias("inactive_max"), "n_resistant", "n_susceptible")


def interpolate(rows: DataFrame, curve: DataFrame, keys: list[str], x: str) -> DataFrame:
    """AG21: piecewise-linear value of curve (keys, cx, cy) at x, clipped at both ends; null where a key has no curve."""
    w = W.partitionBy(*keys).orderBy("cx")
    seg = curve.withColumn("nx", F.lead("cx").over(w)).withColumn("ny", F.lead("cy").over(w)).withColumn("first", F.row_number().over(w) == 1)
    on = [rows[k] == seg[k] for k in keys] + [(F.col("first") | (rows[x] >= seg["cx"])) & (seg["nx"].isNull() | (rows[x] < seg["nx"]))]
    j = rows.join(seg, on, "left")
    for k in keys:
        j = j.drop(seg[k])
    y = F.when((F.col(x) <= F.col("cx")) | F.col("nx").isNull(), F.col("cy")).otherwise(F.col("cy") + (F.col("ny") - F.col("cy")) * (F.col(x) - F.col("cx")) / (F.col("nx") - F.col("cx")))
    return j.withColumn("y", y).drop("cx", "cy", "nx", "ny", "first")


def frequent_columns(long: DataFrame, group: str, key: str, column: str, least: int) -> DataFrame:
    """AG26: columns present in at least so many keys of some group."""
    return long.groupBy(group, column).agg(F.count_distinct(key).alias("n")).groupBy(column).agg(F.max("n").alias("most")).filter(F.col("most") >= least)


def qc_flags(rows: DataFrame, max_contigs: int = 500, size_tolerance: float = 0.20, max_distance: float = 0.05) -> DataFrame:
    """DQ3: rows (n_contigs, total_length, expected, species, mash_species, mash_distance) -> plus qc_fail_reason, qc_pass; measures of empty assemblies are null."""
    empty = F.coalesce("n_contigs", F.lit(0)) == 0
    checks = (
        (F.col("n_contigs") > max_contigs, "too_fragmented"), (F.abs(F.col("total_length") / F.col("expected") - 1) > size_tolerance, "wrong_genome_size"), (F.col("mash_species").isNull(), "no_mash_result"),
        (F.col("mash_species") != F.col("species"), "species_mismatch"), (F.col("mash_distance") > max_distance, "too_distant"),
    )
    joined = F.nullif(F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]), F.lit(""))
    out = rows.withColumn("qc_fail_reason", F.when(empty, "download_failed").otherwise(joined))
    for c in ("total_length", "n50", "gc_percent"):
        if c in rows.columns:
            out = out.withColumn(c, F.when(~empty, F.col(c)))
    return out.withColumn("qc_pass", F.col("qc_fail_reason").isNull())


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """DQ1, DQ2, DQ7, DQ9: one row per rule with the number of rows that break it; all in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("v")).select("v.rule", "v.n")


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """WN2, WN4, SO9."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
