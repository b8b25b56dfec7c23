"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document of a source with rate r = target / size is expected r times: floor(r) whole copies are certain, and the
fractional part is the inclusion probability p of one more. For that copy documents are ranked by Pareto's statistic
(random odds u/(1-u)) / (inclusion odds p/(1-p)); the lowest ranks are taken until the fixed size, counted in words, is
reached. Probabilities are unequal between sources, and inside one when a preference column multiplies the odds.

The cut is found by distributed selection, never by sorting a source: ranks are counted in 1024 bins per source, and only
the bin holding the cut is ordered. A first pass stops before the document that would overshoot; a second pass fills what
is left from the documents small enough for it, so a very long document at the cut costs no accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.llm.text import word_count
from susceptra.storage import materialise, small_join

BINS = 1024
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size, docs) -> plus target: shares by weight of the sum of sizes, stopped at cap times the source's size.

    Sources rank by code point, null last, and take the weights in turn. What a stopped source leaves is reshared by weight
    until no source is above its stop. One row per source, so the two global windows see only that many rows.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("__n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__n") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("__cap", (F.col("source_size") * cap).cast("double")).withColumn("__full", F.col("__cap") / F.col("__w"))
    order = W.orderBy("__full", "__n")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = ((F.sum("source_size").over(everything)).cast("double") - before) / rest
    ranked = ranked.withColumn("__level", level)
    ranked = ranked.withColumn("__place", F.struct("__full", "__n", "__level"))
    found = F.min(F.when(F.col("__level") <= F.col("__full"), F.col("__place"))).over(everything)["__level"]
    return ranked.withColumn("target", F.least(F.col("__cap"), F.coalesce(found, F.lit(0.0)) * F.col("__w"))).select("source", "source_size", "docs", "target")


def _cuts(rows: DataFrame, nearest: bool) -> DataFrame:
    """rows (source, v, doc_id, size, goal) -> (source, cut, got): the last key taken and the words taken up to it.

    Keys (v, doc_id, size) are taken in order while the words stay within goal (or nearest to it); equal keys together.
    """
    binned = rows.withColumn("__bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int"))
    per_bin = binned.groupBy("source", "__bin").agg(F.sum("size").alias("w"), F.first("goal").alias("goal"), F.max(F.struct("v", "doc_id", "size")).alias("last"))
    by_bin = W.partitionBy("source").orderBy("__bin")
    per_bin = per_bin.withColumn("end", F.sum("w").over(by_bin)).withColumn("start", F.col("end") - F.col("w"))
    whole = per_bin.filter("end <= goal").groupBy("source").agg(F.max("last").alias("cut"), F.max("end").alias("got"))
    split = materialise(per_bin.filter("end > goal").groupBy("source").agg(F.min(F.struct("__bin", "start")).alias("s")).select(F.col("source").alias("__src"), F.col("s.__bin").alias("__at"), F.col("s.start").alias("__start")), "cut")
    inside = small_join(binned, split, "source", "__src", F.xxhash64("doc_id")).filter(F.col("__bin") == F.col("__at"))
    inside = inside.groupBy("source", "v", "doc_id", "size").agg(F.sum("size").alias("w"), F.first("goal").alias("goal"), F.first("__start").alias("start"))
    upto = F.sum("w").over(W.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) + F.col("start")
    inside = inside.withColumn("end", upto)
    fits = (2 * F.col("end") - F.col("w") <= 2 * F.col("goal")) if nearest else (F.col("end") <= F.col("goal"))
    inside = inside.filter(fits).groupBy("source").agg(F.max(F.struct("v", "doc_id", "size")).alias("cut"), F.max("end").alias("got"))
    return whole.unionByName(inside).groupBy("source").agg(F.max("cut").alias("cut"), F.max("got").alias("got"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = "", preference: Column | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs plus size, source_size, target and copies (how often the mix takes the document).

    Null text has size 0; null sources form a source of their own; null ids draw one common number; rows with equal
    (id, size) in a source are taken together; no rows give no rows. Documents are never shuffled: only (source, bin) sums are.
    Columns of docs named size, source_size, target or copies are replaced by the result's.
    """
    clash = [c for c in docs.columns if c.lower() in {"size", "source_size", "target", "copies"} or c.startswith("__")]
    docs = docs.drop(*clash)
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = u / (1 - u) / (preference if preference is not None else F.lit(1.0))
    keyed = docs.withColumn("size", word_count(F.col(text))).withColumn("__v", odds / (1 + odds) if preference is not None else u)
    slim = materialise(keyed.select(F.col(source).cast("string").alias("source"), F.col("__v").alias("v"), F.col(doc_id).alias("doc_id"), "size"), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = source_targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan.withColumnRenamed("source", "__src"), "plan")
    ranked = small_join(slim, plan, "source", "__src", F.xxhash64("doc_id")).filter("goal > 0 and size > 0")
    first = materialise(_cuts(ranked.select("source", "v", "doc_id", "size", "goal"), False).select(F.col("source").alias("__one"), F.col("cut").alias("cut1"), F.col("got").alias("got1")), "cut1")
    left = small_join(ranked, first, "source", "__one", F.xxhash64("doc_id")).withColumn("goal", F.col("goal") - F.coalesce("got1", F.lit(0)))
    left = left.filter(F.coalesce(F.struct("v", "doc_id", "size") > F.col("cut1"), F.lit(True)) & (F.col("size") <= F.col("goal")))
    second = _cuts(left.select("source", "v", "doc_id", "size", "goal"), True).select(F.col("source").alias("__two"), F.col("cut").alias("cut2"))
    room = first.select("__one", "cut1", "got1").join(second, F.col("__one").eqNullSafe(F.col("__two")), "full")
    decided = materialise(plan.join(room.select(F.coalesce("__one", "__two").alias("__k"), "cut1", "got1", "cut2"), F.col("__src").eqNullSafe(F.col("__k")), "left").drop("__k"), "decided")
    out = small_join(keyed.withColumn("__source", F.col(source).cast("string")), decided, "__source", "__src", F.xxhash64(F.col(doc_id)))
    key = F.struct(F.col("__v").alias("v"), F.col(doc_id).alias("doc_id"), "size")
    within = F.coalesce(key <= F.col("cut1"), F.lit(False))
    fill = ~within & (F.col("size") <= F.col("goal") - F.coalesce("got1", F.lit(0))) & F.coalesce(key <= F.col("cut2"), F.lit(False))
    extra = F.when((F.col("goal") > 0) & (F.col("size") > 0) & (within | fill), 1).otherwise(0)
    return out.withColumn("copies", F.col("whole") + extra).drop("__v", "__source", "whole", "goal", "docs", "cut1", "cut2", "got1")


def take(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of docs as often as mix_sources takes it, in the columns of docs, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"))
    mixed = mix_sources(packed, **options)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.select("row", F.explode(times).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
