"""Candidate placements of a partial circular sequence on donors: probe chains, anchored ends, rescue by expected length.

Places are numbers on a circle of n bases, so all differences are taken modulo n. Hits are rows; what is compared pairwise
is bounded by rank (twelve anchors an end) or found by an equi-join on bins of the circle. Groups of up to PACKED hits are
one row with an array of them, so they are shuffled once; larger groups stay rows throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.operators.relational import interval_coverage, top_per_group
from susceptra.storage import let, materialise

ANCHORS, RESCUE_ANCHORS, PER_DONOR, MOST_OPTIONS = 12, 2, 3, 20
#: Hits of a (query, donor, strand) that are held in one row at most.
PACKED = 64
GROUP = ["query", "donor", "strand"]
FACTS = ["n", "length", "percent", "containment", "expected", "max_clip", "reach"]
QUALITY = ["covered", "weighted", "full_size", "full_identity"]
#: Names of ML9's numbers in order.
FEATURES = ("share", "containment", "coverage", "identity", "full_share", "full_identity", "left_identity", "right_identity", "left_clip", "right_clip", "left_share", "right_share", "missing_ratio", "size_ratio", "options", "log_length", "support")


def band_join_on_circle(points: DataFrame, others: DataFrame, keys: list[str], at: str, other_at: str, size: str, within: str) -> DataFrame:
    """JN16: pairs of points and others of equal keys at a circular distance of `within` or less, where size and within are columns of both sides, alike for equal keys.

    The circle is cut into bins at least `within` wide, numbered round; a point meets its
    own and both neighbouring bins, the first being the last one's neighbour, so every pair is met in exactly one bin.
    """
    bins = F.greatest(F.floor(F.col(size) / F.greatest(F.col(within), F.lit(1))), F.lit(1)).cast("long")
    bin_of = lambda x: F.least(F.floor(F.pmod(F.col(x), F.col(size)) * bins / F.col(size)), bins - 1).cast("long")
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(bin_of(at) + k, bins)))
    spread = points.withColumn("bin__", F.explode(near))
    held = others.withColumn("bin__", bin_of(other_at)).drop(size, within)
    gap = F.pmod(F.col(other_at) - F.col(at), F.col(size))
    return spread.join(held, [*keys, "bin__"]).drop("bin__").filter(F.least(gap, F.col(size) - gap) <= F.col(within))


def probe_placements(hits: DataFrame, references: DataFrame, queries: DataFrame, probes: int, width: int, missing_fraction: float = 0.35, decimals: int | None = 12) -> DataFrame:
    """ML13: one placement for each (query, donor), the best supported.

    hits (query, probe, ref, strand, qlen, qs, qe, ts, te, matches, block), references (ref, donor, n), all whole circles,
    queries (query, length). Of a probe's hits that cover half of it the best by identity times coverage counts (ties: the
    smallest start). First and last probe must be placed with little clipped; between them they must span the observed
    length, and what is left of the circle must be near what is missing. Ties of references go to the smallest, then to
    strand +. Scores are compared at so many decimals, as the last digit of a mean is that of the order in which it was
    summed; with None as they are, summed in the order of probes, which is one that SQL may take.
    """
    size = F.col("qe") - F.col("qs")
    j = hits.join(references, "ref").withColumn("identity", F.col("matches") / F.greatest(F.lit(1), F.col("block"))).withColumn("coverage", size / F.col("qlen")).filter("coverage >= 0.5")
    back = F.col("strand") == "-"
    start = F.when(back, F.col("n") - F.col("te")).otherwise(F.col("ts"))
    end = F.when(back, F.col("n") - F.col("ts")).otherwise(F.col("te"))
    clipped = F.col("qlen") - size
    hit = F.struct("identity", "coverage", (start - F.col("qs")).alias("start"), (end + F.col("qlen") - F.col("qe")).alias("end"), clipped.alias("clip"))
    keys = ["query", "ref", "donor", "n", "strand"]
    by_probe = j.groupBy(*keys, "probe").agg(F.max_by(hit, F.struct(F.col("identity") * F.col("coverage"), -start, -end)).alias("h"))
    at = lambda p: F.max(F.when(F.col("probe") == p, F.col("h")))
    in_order = F.array_sort(F.collect_list(F.struct("probe", "h.identity", "h.coverage")))  # one hit a probe
    mean = lambda c: F.try_divide(F.aggregate(in_order, F.lit(0.0), lambda total, h: total + F.coalesce(h[c], F.lit(0.0))), F.count(f"h.{c}"))
    chains = by_probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("placed"), mean("identity").alias("mean_identity"), F.min("h.identity").alias("least_identity"), mean("coverage").alias("mean_coverage"), at(0).alias("a"), at(probes - 1).alias("b"))
    both = W.partitionBy("query", "ref")  # two strands
    chains = chains.withColumn("strands", F.sum("placed").over(both)).join(queries, "query")
    n, length = F.col("n"), F.col("length")
    span, missing = F.pmod(F.col("b.end") - F.col("a.start"), n), F.pmod(F.col("a.start") - F.col("b.end"), n)
    expected = length * missing_fraction / (1 - missing_fraction)
    chains = chains.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.clip") <= 0.1 * width) & (F.col("b.clip") <= 0.1 * width))
    chains = chains.filter(span.between(0.5 * length, 1.5 * length) & missing.between(0.25 * expected, 2.5 * expected))
    found = chains.select(
        "query", "donor", "ref", "strand", F.col("a.start").alias("start"), F.col("b.end").alias("end"), missing.alias("missing"), (F.col("placed") / probes).alias("placed_share"), "mean_identity", "least_identity", "mean_coverage",
        F.col("a.identity").alias("first_identity"), F.col("b.identity").alias("last_identity"), F.col("a.coverage").alias("first_coverage"), F.col("b.coverage").alias("last_coverage"), (F.col("placed") / F.col("strands")).alias("strand_share"),
        (span / length).alias("span_ratio"), (missing / expected).alias("missing_ratio"), F.log10("length").alias("log_length"), ((F.col("a.clip") + F.col("b.clip")) / (2 * width)).alias("clip_share"))
    found = found.withColumn("score", F.col("placed_share") * F.col("mean_identity") * F.col("mean_coverage"))
    best = F.struct("score" if decimals is None else F.round("score", decimals), -F.col("ref"), F.when(F.col("strand") == "+", 1).otherwise(0))
    return found.groupBy("query", "donor").agg(*[F.max_by(c, best).alias(c) for c in found.columns if c not in ("query", "donor")])


def anchored(hits: DataFrame, panel: DataFrame, queries: DataFrame, rescue: bool = True, least_clip: int = 1000, most_clip: int = 25_000, drift: int = 25_000) -> DataFrame:
    """ML9, ML10, JN16: (query, donor, strand, method, start, end, missing, the numbers of FEATURES, score), best first by rank.

    hits (query, donor, strand, part, qs, qe, ts, te, identity), part being left, right or full, on the donor's strand;
    panel (query, donor, n, containment); queries (query, length, percent). Ends are anchored by partial hits near the
    observed ends, twelve each; a pair that spans the observed length gives an option, whose coverage is that of the hits
    in step with it. Three options a donor and strand stay. With rescue, two anchors of either end are also tried with the
    missing length that the given share implies. Equal scores are in the order of start and end.
    """
    group, length, n = GROUP, F.col("length"), F.col("n")
    expected = length * (100 - F.col("percent")) / F.col("percent")
    facts = panel.join(queries, "query").withColumn("expected", expected).withColumn("max_clip", F.least(F.lit(most_clip), F.greatest(F.lit(least_clip), F.col("expected") * 0.20))).withColumn("reach", F.greatest(F.lit(drift), 0.15 * length)).select("query", "donor", *FACTS)
    hits = materialise(hits.select(*group, "part", "qs", "qe", "ts", "te", "identity"), "hits")
    crowded = materialise(hits.groupBy(*group).agg(F.count(F.lit(1)).alias("hits__")).filter(F.col("hits__") > PACKED).select(*group), "crowded-groups")
    if crowded.isEmpty():
        options, anchors = _packed(hits, facts)
    else:
        parts = zip(_packed(hits.join(crowded, group, "left_anti"), facts), _unpacked(hits.join(crowded, group, "left_semi"), facts), strict=True)
        options, anchors = (one.unionByName(two) for one, two in parts)
    a_size, b_size = F.col("a.qe") - F.col("a.qs"), F.col("b.qe") - F.col("b.qs")
    options = options.select(*group, F.lit("anchored").alias("method"), "start", "end", "missing", *_features(
        F.col("a.identity"), F.col("b.identity"), F.col("a.qs") / F.greatest(F.lit(1.0), F.col("expected")), (length - F.col("b.qe")) / F.greatest(F.lit(1.0), F.col("expected")), a_size / length, b_size / length,
        F.least(a_size, b_size) / F.greatest(F.lit(1), F.least(length, F.lit(150_000)))))
    options = options.withColumn("score", 0.4 * F.col("containment") + 0.4 * F.col("coverage") + 0.2 * F.col("identity") - 0.08 * F.abs(F.log("missing_ratio")) - 0.1 * (F.col("left_clip") + F.col("right_clip")))
    numbers = [c for c in options.columns if c not in (*group, "start", "end")]
    tie = F.struct("score", "support", "left_clip", "right_clip")
    options = options.groupBy(*group, "start", "end").agg(*[F.max_by(c, tie).alias(c) for c in numbers])
    count = F.least(F.count(F.lit(1)).over(W.partitionBy(*group)), F.lit(MOST_OPTIONS)) / MOST_OPTIONS
    found = top_per_group(options.withColumn("options", count), group, PER_DONOR, F.col("score").desc(), F.col("start"), F.col("end")).drop("rank")
    if not rescue:
        return _ranked(found)
    counted = options.groupBy(*group).agg((F.least(F.count(F.lit(1)), F.lit(MOST_OPTIONS)) / MOST_OPTIONS).alias("n_options"))
    guessed = F.bround("expected").cast("long")
    tried = []
    right_gap, size = length - F.col("qe"), F.col("qe") - F.col("qs")
    for name in ("right", "left"):
        t = anchors.filter(F.col("side") == name).withColumn("missing", guessed).filter(F.col("missing") < n).join(counted, group, "left")
        is_left = name == "left"
        end = F.pmod(F.pmod(F.col("ts") - F.col("qs"), n) - F.col("missing"), n) if is_left else F.pmod(F.col("te") + length - F.col("qe"), n)
        start = F.pmod(F.col("ts") - F.col("qs"), n) if is_left else F.pmod(F.pmod(F.col("te") + length - F.col("qe"), n) + F.col("missing"), n)
        own, zero, one = lambda here, x: x if here else F.lit(0.0), F.lit(0.0), F.lit(1.0)
        t = t.withColumn("anchor_identity", F.col("identity")).select(*group, F.lit(f"length_{name}").alias("method"), start.alias("start"), end.alias("end"), "missing", *_features(
            own(is_left, F.col("anchor_identity")), own(not is_left, F.col("anchor_identity")), F.col("qs") / F.col("expected") if is_left else one, one if is_left else right_gap / F.col("expected"), own(is_left, size / length), own(not is_left, size / length), zero), F.coalesce("n_options", zero).alias("options"))
        tried.append(t.withColumn("score", 0.4 * F.col("containment") + 0.4 * F.col("coverage") + 0.2 * F.col("identity") - 0.1 * (F.col("left_clip") + F.col("right_clip"))))
    return _ranked(found.unionByName(tried[0]).unionByName(tried[1]))


def _placed(pairs: DataFrame) -> DataFrame:
    """Pairs of anchors a and b plus the start, end, span and missing that they imply, where those fit the lengths."""
    n, length, expected = F.col("n"), F.col("length"), F.col("expected")
    start, end = F.pmod(F.col("a.ts") - F.col("a.qs"), n), F.pmod(F.col("b.te") + length - F.col("b.qe"), n)
    placed = pairs.withColumn("start", start).withColumn("end", end).withColumn("span", F.pmod(F.col("end") - F.col("start"), n)).withColumn("missing", F.pmod(F.col("start") - F.col("end"), n))
    return placed.filter((F.col("missing") > 0) & F.col("span").between(0.5 * length, 1.5 * length) & F.col("missing").between(0.05 * expected, 4 * expected))


def _packed(hits: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(options with QUALITY, anchors for the rescue with side, rank and the group's QUALITY), each group's hits being one array."""
    hit = F.struct("part", "qs", "qe", "ts", "te", "identity")
    held = hits.join(facts, ["query", "donor"]).groupBy(*GROUP, *FACTS).agg(F.collect_list(hit).alias("hits"))

    def side(gap) -> Column:
        near = F.filter("hits", lambda h: (h.part != "full") & (gap(h) <= F.col("max_clip")))
        keyed = F.transform(near, lambda h: F.struct(gap(h).alias("gap"), h.identity.isNull(), -h.identity, (h.qs - h.qe).alias("size"), h.ts, h.te, h.dropFields("part").alias("hit")))
        return F.transform(F.slice(F.array_sort(keyed), 1, ANCHORS), lambda k: k.hit)

    held = held.withColumn("left", side(lambda h: h.qs)).withColumn("right", side(lambda h: F.col("length") - h.qe)).withColumn("every", _array_quality(F.col("hits")))
    few = lambda s: F.transform(F.slice(s, 1, RESCUE_ANCHORS), lambda h, i: h.withField("side", F.lit(s)).withField("rank", i + 1))
    held = materialise(held.withColumn("anchors", F.concat(few("left"), few("right"))), "groups")
    pairs = held.select(*GROUP, *FACTS, "hits", "right", F.explode("left").alias("a")).select(*GROUP, *FACTS, "hits", "a", F.explode("right").alias("b"))

    def in_step(h) -> Column:
        relative = F.pmod(h.ts - F.col("start"), F.col("n"))
        return (relative <= F.col("span") + F.col("max_clip")) & (F.abs(relative - h.qs) <= F.col("reach"))

    options = _placed(pairs).withColumn("quality", _array_quality(F.filter("hits", in_step)))
    anchors = held.select(*GROUP, *FACTS, "every", F.explode("anchors").alias("h")).select(*GROUP, *FACTS, "every.*", "h.*")
    return options.select(*GROUP, *FACTS, "a", "b", "start", "end", "missing", "quality.*"), anchors


def _array_quality(hits: Column) -> Column:
    """_quality of an array of hits, as a struct."""

    def of(h: Column) -> Column:
        points = F.array_sort(F.array_distinct(F.flatten(F.transform(h, lambda x: F.array(x.qs, x.qe)))))
        cuts = let(points, lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda q, i: F.struct(F.get(p, i).alias("p"), q.alias("q"))))
        inside = F.transform(cuts, lambda c: F.struct((c.q - c.p).alias("size"), F.transform(F.filter(h, lambda x: (x.qs <= c.p) & (x.qe >= c.q)), lambda x: x.identity).alias("w")))
        add = lambda value: F.aggregate(inside, F.lit(0.0), lambda acc, c: acc + F.when(F.size(c.w) > 0, F.coalesce(value(c).cast("double"), F.lit(0.0))).otherwise(0.0))
        longest = F.array_max(F.transform(F.filter(h, lambda x: x.part == "full"), lambda x: F.struct((x.qe - x.qs).alias("size"), x.identity.alias("identity"))))
        zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        return F.struct(add(lambda c: c.size).alias("covered"), add(lambda c: c.size * F.array_max(c.w)).alias("weighted"), zero(longest["size"]).alias("full_size"), zero(longest["identity"]).alias("full_identity"))

    return let(hits, of)


def _unpacked(hits: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What _packed returns, for groups of any size: hits stay rows, and meet by joins."""
    group = GROUP
    j = hits.join(facts, ["query", "donor"])
    size = F.col("qe") - F.col("qs")
    partial = j.filter("part <> 'full'")
    last = [F.col("identity").desc(), size.desc(), F.col("ts"), F.col("te")]
    side = lambda gap, k: top_per_group(partial.filter(gap <= F.col("max_clip")), group, k, gap, *last)
    left, right = side(F.col("qs"), ANCHORS), side(F.col("length") - F.col("qe"), ANCHORS)
    hit = F.struct("qs", "qe", "ts", "te", "identity")
    pairs = _placed(left.select(*group, *FACTS, hit.alias("a")).join(right.select(*group, hit.alias("b")), group))
    # hits in step: what is coherent depends on start and end alone, and is found once for each
    ends = pairs.select(*group, "n", "reach", "max_clip", "start", "end", "span").distinct()
    phased = j.select(*group, "n", "reach", "part", "qs", "qe", "ts", "identity").withColumn("phase", F.pmod(F.col("ts") - F.col("qs"), F.col("n")))
    met = band_join_on_circle(ends, phased, group, "start", "phase", "n", "reach")
    relative = F.pmod(F.col("ts") - F.col("start"), F.col("n"))
    met = met.filter((relative <= F.col("span") + F.col("max_clip")) & (F.abs(relative - F.col("qs")) <= F.col("reach")))
    options = pairs.join(_quality(met, [*group, "start", "end"]), [*group, "start", "end"], "left").fillna(0.0, QUALITY)
    every = _quality(j.select(*group, "part", "qs", "qe", "identity"), group)
    few = lambda t, name: t.filter(F.col("rank") <= RESCUE_ANCHORS).withColumn("side", F.lit(name))
    anchors = few(left, "left").unionByName(few(right, "right")).join(every, group, "left")
    anchors = anchors.select(*group, *FACTS, *QUALITY, "side", "rank", "qs", "qe", "ts", "te", "identity")
    return options.select(*group, *FACTS, "a", "b", "start", "end", "missing", *QUALITY), anchors


def _quality(hits: DataFrame, keys: list[str]) -> DataFrame:
    """AG30 per key: covered bases, the identity summed over them (the best hit's), and size and identity of the longest full hit."""
    packed = hits.withColumn("key__", F.struct(*keys))
    union = interval_coverage(packed.select("key__", "qs", "qe", "identity"), "key__", "qs", "qe", "identity")
    longest = F.max(F.when(F.col("part") == "full", F.struct(F.col("qe") - F.col("qs"), "identity")))
    full = packed.groupBy("key__").agg(longest.alias("f"))
    return full.join(union, "key__", "left").select(*[F.col(f"key__.{k}").alias(k) for k in keys], F.coalesce(F.col("covered").cast("double"), F.lit(0.0)).alias("covered"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"), F.coalesce(F.col("f")["col1"].cast("double"), F.lit(0.0)).alias("full_size"), F.coalesce(F.col("f")["identity"], F.lit(0.0)).alias("full_identity"))


def _features(left_identity: Column, right_identity: Column, left_clip: Column, right_clip: Column, left_share: Column, right_share: Column, support: Column) -> list[Column]:
    """FEATURES but for options, in order; the rest comes from the row."""
    length, expected = F.col("length"), F.col("expected")
    values = {
        "share": F.col("percent") / 100, "containment": F.col("containment"), "coverage": F.col("covered") / length, "identity": F.col("weighted") / F.greatest(F.lit(1.0), F.col("covered")), "full_share": F.col("full_size") / length,
        "full_identity": F.col("full_identity"), "left_identity": left_identity, "right_identity": right_identity, "left_clip": left_clip, "right_clip": right_clip, "left_share": left_share, "right_share": right_share,
        "missing_ratio": F.col("missing") / expected, "size_ratio": F.col("n") / (length + expected), "log_length": F.log10(length), "support": F.least(F.lit(1.0), support),
    }
    return [values[f].cast("double").alias(f) for f in FEATURES if f != "options"]


def _ranked(found: DataFrame) -> DataFrame:
    """Of equal placements (donor, strand, end, missing) the best stays, as they are one sequence; then a rank in each query."""
    same = W.partitionBy("query", "donor", "strand", "end", "missing").orderBy(F.col("score").desc(), "method", "start")
    one = found.withColumn("copy__", F.row_number().over(same)).filter("copy__ = 1").drop("copy__")
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "donor", "strand", "start", "end", "method")
    return one.withColumn("rank", F.row_number().over(best))
