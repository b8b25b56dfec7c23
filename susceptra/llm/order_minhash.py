"""Order MinHash document fingerprints, with DataFrame functions only.

Words are hashed to k-mers, k-mers are numbered by occurrence (the n-th copy of a k-mer is an element of its own), one
hash of (k-mer, number) deals the elements into BUCKETS classes by its top bits, each class keeps its TAKE smallest
elements, puts them back into text order and hashes the tuple. Two texts agree in a class only if the same elements are
smallest and stand in the same order, which makes the likeness follow edit distance rather than set overlap.

An element is one long, hash << 24 | position, so both sorts run on primitive arrays. Positions hold 16.7 million words;
a longer text wraps its positions, which keeps results deterministic but not its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.llm.text import WORD
from susceptra.storage import let

K, TAKE, BUCKET_BITS = 2, 2, 5
BUCKETS = 1 << BUCKET_BITS
POSITION_BITS = 24
#: Classes without an element hash to this.
EMPTY = "00000000"


def _pack(hashed: Column, position: Column) -> Column:
    return F.shiftleft(hashed, POSITION_BITS).bitwiseOR(position.cast("long").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))


def _hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POSITION_BITS)


def fingerprint(text: Column) -> Column:
    """BUCKETS words of 8 hex digits, joined. Null counts as empty; a text of fewer than K words is one k-mer; equal texts are equal."""

    def kmers(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))))
        return F.transform(starts, lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i))

    def copies_before(h: Column, j: Column, own: Column) -> Column:
        """How many equal hashes stand right before place j of a sorted array: steps of halving length back to the run's start."""
        back = F.array(*[F.lit(1 << t) for t in range(POSITION_BITS - 1, -1, -1)])
        return j - F.aggregate(back, j, lambda at, step: F.when(F.get(h, at - step) == own, at - step).otherwise(at))

    def numbered(s: Column) -> Column:
        """The n-th element of a run of equal k-mers: a second hash of k-mer and n. Only repeats search for their run's start."""
        return let(
            F.transform(s, _hash_of),
            lambda h: F.transform(
                s,
                lambda x, j: _pack(
                    F.xxhash64(_hash_of(x), F.when(F.get(h, j - 1) == F.get(h, j), copies_before(h, j, F.get(h, j))).otherwise(0)),
                    x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)),
                ),
            ),
        )

    def bucket(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BUCKET_BITS)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, j: (j < TAKE) | (bucket(F.get(s, j - TAKE)) != bucket(x)))

    def sketch(few: Column) -> Column:
        def one(b: Column) -> Column:
            mine = F.filter(few, lambda x: bucket(x) == b)
            ordered = F.array_sort(F.transform(mine, lambda x: F.struct(x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("p"), _hash_of(x).alias("h"))))
            return let(ordered, lambda o: F.when(F.size(o) == 0, F.lit(EMPTY)).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.transform(o, lambda e: e["h"])))), 16, "0"), 1, 8)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: one(b.cast("long"))), "")

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return let(words, lambda w: let(F.sort_array(kmers(w)), lambda s: let(F.sort_array(numbered(s)), lambda t: let(smallest(t), sketch))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal classes among those that are not empty in both; 1 for two empty fingerprints."""
    blocks = F.sequence(F.lit(0), F.lit(BUCKETS - 1))

    def block(s: Column, i: Column) -> Column:
        return F.substr(s, i * 8 + 1, F.lit(8))

    used = F.size(F.filter(blocks, lambda i: (block(a, i) != EMPTY) | (block(b, i) != EMPTY)))
    same = F.size(F.filter(blocks, lambda i: (block(a, i) == block(b, i)) & (block(a, i) != EMPTY)))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, text) -> plus fingerprint, and next_text and next_fingerprint of the row after it in descending key order, the first one after the last.

    One shuffle of the texts: keys are cut into ranges at existing keys (an approximate percentile summary), and the row
    at each cut also travels to the range before it. Ties in key rank by text, null keys come last; a single row follows itself.
    """
    spark = docs.sparkSession
    ranges = min(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    at = [i / ranges for i in range(1, ranges)]
    found = base.select("key").agg(F.max("key").alias("top"), F.percentile_approx("key", at, 10 * ranges).alias("cuts")).first()
    cuts = sorted(set(found.cuts or []) - {found.top}, reverse=True)
    bounds = F.array(*[F.lit(int(-c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # range r holds keys from cuts[r - 1] down to just above cuts[r]: the number of cuts at or above the key
    low = F.lit(len(cuts)).cast("int")
    if cuts:
        low = F.when(F.col("key").isNull(), low).otherwise(_at_or_above(bounds, F.col("key"), len(cuts)))
    placed = base.withColumn("r", low).withColumn("halo", F.lit(0))
    is_cut = F.array_contains(bounds, -F.col("key")) if cuts else F.lit(False)
    targets = F.when(F.col("key") == F.lit(found.top), F.array(F.struct(F.col("r"), F.lit(0).alias("halo")), F.struct(F.lit(len(cuts)).alias("r"), F.lit(2).alias("halo"))))
    targets = targets.when(is_cut, F.array(F.struct(F.col("r"), F.lit(0).alias("halo")), F.struct((F.col("r") - 1).alias("r"), F.lit(1).alias("halo"))))
    targets = targets.otherwise(F.array(F.struct(F.col("r"), F.lit(0).alias("halo"))))
    marked = placed.withColumn("fingerprint", fingerprint(F.col("text")))
    spread = marked.select("key", "text", "fingerprint", F.explode(targets).alias("t")).select("key", "text", "fingerprint", "t.r", "t.halo")
    order = W.partitionBy("r").orderBy("halo", F.col("key").desc_nulls_last(), F.col("text").desc())
    row = F.struct(F.col("text").alias("text"), F.col("fingerprint").alias("fingerprint"))
    first = F.first(row).over(order.rowsBetween(W.unboundedPreceding, 0))
    joined = spread.withColumn("after", F.coalesce(F.lead(row).over(order), first)).filter("halo = 0")
    return joined.select(F.col("key").alias(key), F.col("text").alias(text), "fingerprint", F.col("after.text").alias("next_text"), F.col("after.fingerprint").alias("next_fingerprint"))


def _at_or_above(bounds: Column, key: Column, n: int) -> Column:
    """How many cuts (given negated, ascending) are >= key: a binary search as nested lookups, log2(n) steps a row."""
    steps = F.array(*[F.lit(1 << t) for t in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= -key, at + step).otherwise(at))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (F.length(text) - half)), F.substring(following, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text), of its edited text, and their likeness to it and to the next document's.

    Null text counts as empty, repeated rows are kept, null ids come last in the order, other columns are ignored, and no
    rows give no rows. Each text is fingerprinted once before the shuffle and its edited form once after.
    """
    rows = with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited_text")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))).drop("next_fingerprint")
