"""Genotype strings, report rows and their summaries, label counts, holdouts, and the completion scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.storage import bounded_batches

#: Weights of the support score.
SUPPORT = {"containment": 0.4, "coverage": 0.4, "identity": 0.2}
RATIO_COST, CLIP_COST = 0.08, 0.1


def genotype_string(hits: DataFrame, key: str) -> DataFrame:
    """PR27, PR28: hits (key, ord, symbol, type, subtype, method) -> (key, genotypes) of the AMR hits in their order."""
    tag = mic.hit_tag(F.col("method"), F.col("subtype"))
    item = F.concat(F.col("symbol"), F.when(tag != "", F.concat(F.lit("="), tag)).otherwise(""))
    g = hits.filter("type = 'AMR'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), item.alias("item")))).alias("items"))
    return g.select(key, F.array_join(F.col("items.item"), ",").alias("genotypes"))


def class_of_symbol(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """JN12: rows (symbol) plus class: by the symbol, else by the symbol without its allele number; an empty class counts as none."""
    known = classes.filter("class <> ''").groupBy("symbol").agg(F.min("class").alias("class"))
    bare = known.select(F.col("symbol").alias("__bare"), F.col("class").alias("__fallback"))
    r = rows.join(known, "symbol", "left").withColumn("__key", F.regexp_replace("symbol", "-[0-9]+$", ""))
    return r.join(bare, F.col("__key") == F.col("__bare"), "left").withColumn("class", F.coalesce("class", "__fallback")).drop("__key", "__bare", "__fallback")


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """PR36: report rows and overrides (keys, kind, markers), one per key at most: natural resistance hides MIC and probability, a strong marker replaces the reasons."""
    r = rows.join(overrides.select(*keys, F.col("kind").alias("override"), "markers"), keys, "left")
    over, natural = F.col("override").isNotNull(), F.col("override").eqNullSafe("natural_resistance")
    for c in ("pred_mic", "band_low", "band_high", "p_active", "confidence_level"):
        r = r.withColumn(c, F.when(~natural, F.col(c)))
    reasons = F.when(over & ~natural, F.array_sort(F.array_distinct("markers"))).otherwise(F.col("reasons"))
    return r.withColumn("reasons", reasons).withColumn("call", F.when(over, "likely_inactive").otherwise(F.col("call"))).withColumn("margin_steps", F.when(~over, F.col("margin_steps"))).drop("markers")


def report_summary(rows: DataFrame, key: str) -> DataFrame:
    """AG37: (key, call, reasons) -> (key, n_active, n_inactive, n_uncertain, markers): distinct and sorted."""
    counts = [F.count_if(F.col("call") == c).alias(n) for c, n in (("likely_active", "n_active"), ("likely_inactive", "n_inactive"), ("uncertain", "n_uncertain"))]
    return rows.groupBy(key).agg(*counts, F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ",").alias("markers"))


def recent_of_two(memory: DataFrame, stored: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """JN18, SO3: the latest rows of two histories; where both have a key, memory's row counts."""
    both = memory.withColumn("__p", F.lit(0)).unionByName(stored.withColumn("__p", F.lit(1)))
    one = both.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy("__p"))).filter("__rn = 1").drop("__rn", "__p")
    return one.orderBy(F.col(at).desc(), key).limit(limit)


def label_counts(labels: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """AG14, AG28: counts of each value for every key, absent ones as zero: one pass, no cross join."""
    return labels.groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values])


def support_score(r: DataFrame) -> DataFrame:
    """ML9: candidates (containment, coverage, identity, length_ratio, clips) plus support."""
    weighted = sum((F.col(c) * w for c, w in SUPPORT.items()), F.lit(0.0))
    return r.withColumn("support", weighted - RATIO_COST * F.abs(F.log("length_ratio")) - CLIP_COST * F.col("clips"))


def margins(scores: DataFrame, key: str, score: str) -> DataFrame:
    """WN3: (key, score) -> (key, best, margin over the second best; null for a single candidate)."""
    top = F.slice(F.reverse(F.array_sort(F.collect_list(score))), 1, 2)
    ranked = scores.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.col(score).desc()))).filter("__r <= 2")
    return ranked.groupBy(key).agg(top.alias("t")).select(key, F.get("t", F.lit(0)).alias("best"), (F.get("t", F.lit(0)) - F.get("t", F.lit(1))).alias("margin"))


def pairwise_rank(rows: DataFrame, group: str, candidate: str, features: list[str], target: str) -> DataFrame:
    """ML11, JN20: feature differences of ordered pairs of a group's candidates, the label of the better one and the gap as weight.

    Candidates of a group are few (those of one query); the pairs train a logistic regression without intercept.
    """
    one, two = (rows.select(group, *[F.col(c).alias(f"{c}_{k}") for c in (candidate, target, *features)]) for k in "ab")
    pairs = one.join(two, group).filter(F.col(f"{candidate}_a") < F.col(f"{candidate}_b")).filter(F.col(f"{target}_a") != F.col(f"{target}_b"))
    gap = F.col(f"{target}_a") - F.col(f"{target}_b")
    return pairs.select(group, F.col(f"{candidate}_a").alias("a"), F.col(f"{candidate}_b").alias("b"), *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in features], (gap > 0).cast("double").alias("label"), F.abs(gap).alias("weight"))


def fit_pairwise(pairs: DataFrame, features: list[str]) -> list[float]:
    """ML11: the weights learned from the pairs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="x").transform(pairs)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, regParam=1e-3).fit(ready)
    return model.coefficients.toArray().tolist()


def history(new: Column, guess: Column, new_length: Column, guess_length: Column) -> Column:
    """ML12: Jaccard similarity of two hash sets and the length ratio; (-1, 0) where there was no guess."""
    both = F.size(F.array_intersect(new, guess))
    either = F.size(F.array_union(new, guess))
    jaccard = F.when(guess.isNull(), -1.0).when(either > 0, both / F.when(either > 0, either)).otherwise(0.0)
    return F.struct(jaccard.alias("jaccard"), F.when(guess.isNull() | (guess_length == 0), 0.0).otherwise(new_length / F.when(guess_length > 0, guess_length)).alias("ratio"))


def calibration_support(points: DataFrame, support: DataFrame, key: str, within: float = 0.05) -> DataFrame:
    """AG34: (key, p) and (group, p) -> (key, groups whose p is within the distance).

    An equi-join on cells as wide as the distance, each point meeting its own and both neighbour cells.
    """
    cell = lambda p: F.floor(p / within)
    spread = points.withColumn("__cell", F.explode(F.array(cell(F.col("p")) - 1, cell(F.col("p")), cell(F.col("p")) + 1)))
    held = support.select(F.col("group").alias("__group"), F.col("p").alias("__p"), cell(F.col("p")).alias("__cell")).distinct()
    near = spread.join(held, "__cell").filter(F.abs(F.col("p") - F.col("__p")) <= within).groupBy(key).agg(F.count_distinct("__group").alias("n_groups"))
    return points.select(key).distinct().join(near, key, "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


def external_holdouts(rows: DataFrame, year: str, country: str, source: str, last_years: int, countries: list[str], sources: list[str]) -> DataFrame:
    """EX3: flags of the rows outside of training by time, place and origin; unknown values are not held out."""
    rank = F.dense_rank().over(W.orderBy(F.col(year).desc()))
    late = rows.select(year).filter(F.col(year).isNotNull()).distinct().withColumn("__r", rank).filter(F.col("__r") <= last_years).select(year, F.lit(True).alias("holdout_time"))
    out = rows.join(F.broadcast(late), year, "left")
    no = F.lit(False)
    return out.withColumn("holdout_time", F.coalesce("holdout_time", no)).withColumn("holdout_country", F.coalesce(F.col(country).isin(*countries), no)).withColumn("holdout_source", F.coalesce(F.col(source).isin(*sources), no))


def cs_events(cs: Column) -> Column:
    """AG33: struct of the events of a difference string: matching, substituted, inserted and deleted bases; other tokens raise."""
    pattern = r"(:[0-9]+|=[A-Za-z]+|\*[a-z][a-z]|\+[a-z]+|-[a-z]+)"
    tokens = F.regexp_extract_all(cs, F.lit(pattern), F.lit(1))
    total = lambda sign, size: F.aggregate(F.filter(tokens, lambda t: F.substring(t, 1, 1) == sign), F.lit(0), lambda a, t: a + size(t))
    rest = lambda t: F.length(t) - 1
    whole = F.assert_true(F.array_join(tokens, "") == cs, "an unsupported token").isNull()
    matched = total(":", lambda t: F.substring(t, 2, 20).cast("int")) + total("=", rest)
    return F.when(whole, F.struct(matched.alias("matched"), total("*", lambda t: F.lit(1)).alias("substituted"), total("+", rest).alias("inserted"), total("-", rest).alias("deleted")))


def cs_decode(alignments: DataFrame, key: str) -> DataFrame:
    """AG33: (key, target, query, qs, qe, strand, ts, te, cs) -> recall, precision and f1 per key, over bases A, C, G and T.

    A base counts where alignments only match it; one touched by any edit does not. A group is the alignments of one
    candidate to one target, whose sequences bound the state.
    """

    packed = alignments.groupBy(key).agg(F.first("target").alias("target"), F.first("query").alias("query"), F.collect_list(F.struct("qs", "qe", "strand", "ts", "te", "cs")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_scores(*(b.column(c)[i].as_py() for c in ("target", "query", "parts"))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([m[i] for m in made], pa.float64()) for i in range(3))], [key, "recall", "precision", "f1"])

    kind = dict(alignments.dtypes)[key]
    bounded_batches(alignments.sparkSession)
    return packed.select(key, "target", "query", "parts").mapInArrow(run, f"{key} {kind}, recall double, precision double, f1 double")


_KNOWN = np.isin(np.arange(256), list(b"ACGT"))


def _scores(target: str, query: str, parts: list[dict]) -> tuple[float, float, float]:
    """Recall, precision and F1 of one candidate's alignments."""
    marks = {"t": np.zeros(len(target), np.uint8), "q": np.zeros(len(query), np.uint8)}
    for r in parts:
        if r["cs"] is None:
            continue
        t, q = int(r["ts"]), 0
        for sign, n in _tokens(r["cs"]):
            flag = 1 if sign in ":=" else 2
            if sign != "+":
                marks["t"][t : t + n] |= flag
                t += n
            if sign != "-":
                lo, hi = (int(r["qs"]) + q, int(r["qs"]) + q + n) if r["strand"] == "+" else (int(r["qe"]) - q - n, int(r["qe"]) - q)
                marks["q"][lo:hi] |= flag
                q += n
        if t != int(r["te"]) or q != int(r["qe"]) - int(r["qs"]):
            raise ValueError("the difference string does not end where the alignment does")
    known = {k: _KNOWN[np.frombuffer(s.encode(), np.uint8)] for k, s in (("t", target), ("q", query))}
    exact = {k: int(((marks[k] == 1) & known[k]).sum()) for k in "tq"}
    n = int(known["t"].sum())
    recall, precision = exact["t"] / n if n else 0.0, exact["q"] / len(query) if query else 0.0
    return recall, precision, 2 * recall * precision / (recall + precision) if recall + precision else 0.0


def _tokens(cs: str) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(cs):
        end = at + 1
        while end < len(cs) and cs[end] not in ":=*+-":
            end += 1
        sign, body = cs[at], cs[at + 1 : end]
        if sign not in ":=*+-" or not body:
            raise ValueError(f"an unsupported token at {at}")
        yield sign, int(body) if sign == ":" else 1 if sign == "*" else len(body)
        at = end


def overrides(genomes: DataFrame, natural: DataFrame, markers: DataFrame, hits: DataFrame) -> DataFrame:
    """JN10: (genome, drug, kind, markers) of calls that rules decide: natural resistance of a species, else strong markers found.

    genomes (genome, species), natural (species, drug), markers (species, drug, pattern), hits (genome, symbol, type,
    method, subtype). Only hits of type AMR count, and none that is tagged as mistranslated, as such a gene is likely broken. Rules meet hits by an
    equi-join on species; the pattern is tried on those rows only. markers are distinct and sorted.
    """
    born = genomes.join(F.broadcast(natural) if natural.count() <= MOST_RULES else natural, "species").select("genome", "drug", F.lit("natural_resistance").alias("kind"), F.array().cast("array<string>").alias("markers")).distinct()
    usable = hits.filter((F.col("type") == "AMR") & (mic.hit_tag(F.col("method"), F.col("subtype")) != "MISTRANSLATION")).select("genome", "symbol").distinct().join(genomes, "genome")
    met = usable.join(F.broadcast(markers) if markers.count() <= MOST_RULES else markers, "species").filter(F.rlike("symbol", F.col("pattern")))
    found = met.groupBy("genome", "drug").agg(F.array_sort(F.collect_set("symbol")).alias("markers")).select("genome", "drug", F.lit("strong_marker").alias("kind"), "markers")
    return born.unionByName(found.join(born.select("genome", "drug"), ["genome", "drug"], "left_anti"))


#: Rules are a dimension of the domain; so many are sent to every task, more are joined by a shuffle.
MOST_RULES = 100_000
