"""Fuzzy line dedup by MinHash.

Lines of MIN_CHARS code points or more are identified by a 64-bit hash; those that make fewer than two shingles are left
alone. Equal lines need no band. A line's signature holds ROWS * BANDS minima, each over the hashes of all its shingles of
CHECK code points times one odd number; a band is the hash of ROWS of them. Lines of similarity s share a band with
probability 1 - (1 - s^5)^12: 0.991 at 0.8, more above. One bit of each minimum makes the sketch, in which lines of
similarity 0.8 differ at one place in ten: pairs that differ at more than MAX_DIFFER of the 60 are no candidates (a chance
of some 2e-5 at 0.8).

In a band every line is compared with the band's smallest and largest line. What these links join is one component
already; bands that still hold several are open, and their lines are compared across components until none is left: all
pairs in bands of SMALL lines or fewer; the lines of larger ones are banded anew by FINE minima, where lines of similarity
0.8 miss each other with a chance of 4e-7, and compared across components there. Candidates are verified by the exact
Jaccard similarity of the sets of all shingles of the whole lines. Verified links and equal lines form components by
distributed union-find; the first line of each component in (doc_id, row key, line number) order stays, all others go.

Signatures and verification run in Arrow batches; all that moves between lines is DataFrame operations. Written with
DataFrame functions only, the operator took 772 CPU seconds a GB, about twice what it may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from susceptra.operators.components import connected_components
from susceptra.storage import bounded_batches, free_name, let, materialise

CHECK, SIMILARITY = 5, 0.8
MIN_CHARS = CHECK + 1
ROWS, BANDS = 5, 12
#: Of the sketch's ROWS * BANDS bits.
MAX_DIFFER = 17
#: Open bands of up to this many lines are compared pair by pair; (rows, bands) for the lines of larger ones.
SMALL, FINE = 512, (8, 80)
#: Code points hashed at once, and line ids a task remembers so that it signs repeated lines once.
BLOCK, REMEMBERED = 1 << 16, 200_000
#: Up to this many short rows (a key of 8 bytes, at most with a place) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """n odd numbers of 32 bits."""
    with np.errstate(over="ignore"):
        return (_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _minima(lines: list[str], factors: np.ndarray) -> np.ndarray:
    """(line, factor): the smallest product over the hashes of each line's shingles. Lines have CHECK code points or more."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - CHECK + 1
    hashes = points[:n].copy()
    for k in range(1, CHECK):
        hashes = hashes * np.uint64(0x100000001B3) + points[k : n + k]
    ends = np.cumsum([len(x) for x in lines])
    inside = np.ones(n, bool)
    for k in range(1, CHECK):
        inside[ends[:-1] - k] = False
    values = (_mixed(hashes)[inside] >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], ends[:-1] - (CHECK - 1) * np.arange(1, len(lines))])
    out, products = np.empty((len(lines), len(factors)), np.uint32), np.empty_like(values)
    for k, factor in enumerate(factors):
        np.multiply(values, factor, out=products)
        out[:, k] = np.minimum.reduceat(products, starts)
    return out


def signatures(lines: list[str], rows: int = ROWS, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """((line, band) hashes, sketches), as 64-bit numbers, of lines of CHECK code points or more."""
    factors, made, first, held = _factors(rows * bands), [], 0, 0
    with np.errstate(over="ignore"):
        for i, line in enumerate(lines):
            held += len(line)
            if held >= BLOCK or i == len(lines) - 1:
                made.append(_minima(lines[first : i + 1], factors))
                first, held = i + 1, 0
        minima = np.concatenate(made) if made else np.empty((0, rows * bands), np.uint32)
        keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(rows << 32), (len(minima), 1))
        for k in range(rows):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, k::rows].astype(np.uint64))
        bits = _mixed(minima[:, :60].astype(np.uint64)) & np.uint64(1)
        sketch = (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
    return keys.view(np.int64), sketch.view(np.int64)


def _lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of values as lists, null where no row is present."""
    ends = np.cumsum(present * values.shape[1] if len(values) else present * 0)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~present, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.int64()))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Rows equal in id and text are one document to this operator: they are judged alike."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, row, line_no, line_id, sketch, bands) of lines of MIN_CHARS or more; numbers count all lines from 0.

    Where a task meets a line again, bands are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            owner, numbers, ids, fresh, new = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, line in enumerate(text.split("\n") if text else ()):
                    if len(line) < MIN_CHARS:
                        continue
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    owner.append(i)
                    numbers.append(k)
                    ids.append(h)
                    fresh.append(h not in seen)
                    if fresh[-1]:
                        seen.add(h)
                        new.append(line)
            if len(seen) > REMEMBERED:
                seen.clear()
            bands, sketch = signatures(new)
            present = np.array(fresh, bool)
            sketches = np.zeros(len(ids), np.int64)
            sketches[present] = sketch
            at = pa.array(owner, pa.int64())
            columns = [b.column("doc_id").take(at), b.column("row").take(at), pa.array(numbers, pa.int32())]
            columns += [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sketches), _lists(bands, present)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "line_no", "line_id", "sketch", "bands"])

    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", row_key().alias("row"), "text")
    schema = keyed.select("doc_id", "row").schema.add("line_no", "integer").add("line_id", "long").add("sketch", "long")
    return keyed.mapInArrow(run, schema.add("bands", T.ArrayType(T.LongType())))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (line_id, line) for lines of MIN_CHARS or more."""
    split = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return split.filter(F.length("line") >= MIN_CHARS).select(F.xxhash64("line").alias("line_id"), "line")


def _shared(banded: DataFrame) -> DataFrame:
    """Distinct (band, line_id, sketch) of the bands that hold more than one line.

    Nearly all bands hold one. They are found by the extremes of 32 bits of the line ids, which are combined before the
    shuffle, so a line that fills the corpus is one row per task; two lines of a band are missed where all those bits agree.
    """
    bits = F.shiftright("line_id", 32).cast("int")
    many = banded.groupBy("band").agg(F.min(bits).alias("low"), F.max(bits).alias("high"))
    many = materialise(many.filter("low < high").select("band"), "shared-bands")
    return materialise(_join_keys(banded, many, "band", "left_semi").distinct(), "bands")


def _alike(a: str, b: str) -> Column:
    """Whether two sketches differ at few enough places."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DIFFER


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line) of the wanted lines, read from the texts again."""
    found = _join_keys(lines_of(docs), materialise(wanted, "wanted"), "line_id", "left_semi")
    return materialise(found.groupBy("line_id").agg(F.first("line").alias("line")), "line-texts")


def shingles(line: str) -> set[str]:
    return {line[i : i + CHECK] for i in range(len(line) - CHECK + 1)}


def similar(one: set[str], two: set[str]) -> bool:
    """Whether their Jaccard similarity is SIMILARITY or more; lines without a shingle are like no other."""
    both = len(one & two)
    return both > 0 and both >= SIMILARITY * (len(one) + len(two) - both)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of line ids whose lines are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            keep = []
            for one, two in zip(b.column("line_a"), b.column("line_b"), strict=True):
                x, y = one.as_py(), two.as_py()
                if y != last:
                    last, held = y, shingles(y)
                keep.append(similar(shingles(x), held))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs, "candidates")
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct())
    for k in "ab":
        pairs = pairs.join(texts.select(F.col("line_id").alias(k), F.col("line").alias(f"line_{k}")), k)
    return materialise(pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long"), "verified")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_ends(found: DataFrame) -> DataFrame:
    """Distinct candidates (a, b): every line of a band with the band's smallest and largest."""
    line = F.struct("line_id", "sketch")
    ends = materialise(found.groupBy("band").agg(F.array(F.min(line), F.max(line)).alias("ends")), "band-ends")
    met = _join_keys(found, ends, "band", "inner").select("line_id", "sketch", F.explode("ends").alias("end"))
    met = met.select("line_id", "sketch", F.col("end.line_id").alias("other"), F.col("end.sketch").alias("like"))
    return met.filter((F.col("line_id") != F.col("other")) & _alike("sketch", "like")).select(*_ordered("line_id", "other")).distinct()


def _across(rows: DataFrame, key: str) -> DataFrame:
    """Distinct candidates (a, b) of the lines that share a key and are of different components."""
    one, two = (rows.select(key, *[F.col(c).alias(f"{c}_{k}") for c in ("line_id", "component", "sketch")]) for k in "ab")
    met = (F.col("line_id_a") < F.col("line_id_b")) & (F.col("component_a") != F.col("component_b")) & _alike("sketch_a", "sketch_b")
    return one.join(two, key).filter(met).select(F.col("line_id_a").alias("a"), F.col("line_id_b").alias("b")).distinct()


def _open(placed: DataFrame) -> DataFrame:
    """(band, line_id, component, sketch) plus n of the bands that hold several components, n counting their lines."""
    still = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    still = materialise(still.filter("low < high").select("band", "n"), "open-bands")
    return _join_keys(placed, still, "band", "inner")


def _finer(docs: DataFrame, crowded: DataFrame) -> DataFrame:
    """(line_id, component, sketch) of crowded bands -> the same by finer bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands, _ = signatures(b.column("line").to_pylist(), *FINE)
            made = [b.column(c) for c in ("line_id", "component", "sketch")]
            yield pa.RecordBatch.from_arrays([*made, _lists(bands, np.ones(b.num_rows, bool))], ["line_id", "component", "sketch", "bands"])

    texts = _texts(docs, crowded.select("line_id"))
    signed = crowded.join(texts, "line_id").select("line_id", "component", "sketch", "line")
    signed = materialise(signed.mapInArrow(run, "line_id long, component long, sketch long, bands array<long>"), "fine-bands")
    return signed.select(F.explode("bands").alias("band"), "line_id", "component", "sketch")


def line_components(docs: DataFrame, banded: DataFrame) -> DataFrame:
    """(line_id, component) of lines with a similar line, from rows (band, line_id, sketch); docs are read for their texts."""
    found = _shared(banded)
    first = materialise(connected_components(_verified(docs, _with_ends(found))).withColumnRenamed("node", "line_id"), "first-components")
    # bands of three lines or fewer were compared in full
    sized = found.groupBy("band").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 3").select("band")
    left = _join_keys(found, materialise(sized, "long-bands"), "band", "left_semi")
    left = _join_keys(left, first, "line_id", "left").withColumn("component", F.coalesce("component", "line_id"))
    left = materialise(_open(materialise(left.select("band", "line_id", "component", "sketch"), "placed")), "open")
    more = _across(left.filter(F.col("n") <= SMALL), "band")
    crowded = materialise(left.filter(F.col("n") > SMALL).select("line_id", "component", "sketch").distinct(), "crowded")
    if not crowded.isEmpty():
        more = more.unionByName(_across(materialise(_open(_finer(docs, crowded)), "fine-open"), "band")).distinct()
    again = _verified(docs, more)
    if again.isEmpty():
        return first
    # only components are joined now
    known = first.select("line_id", "component")
    for k in "ab":
        again = _join_keys(again.withColumnRenamed(k, "line_id"), known, "line_id", "left")
        again = again.withColumn(k, F.coalesce("component", "line_id")).drop("line_id", "component")
    second = materialise(connected_components(again).select(F.col("node").alias("component"), F.col("component").alias("joined")), "joined-components")
    alone = second.join(known.select(F.col("line_id").alias("component")), "component", "left_anti")
    alone = alone.select(F.col("component").alias("line_id"), F.col("joined").alias("component"))
    moved = _join_keys(known, second, "component", "left").select("line_id", F.coalesce("joined", "component").alias("component"))
    return materialise(moved.unionByName(alone), "line-components")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, row, line_no) of every line that goes: all but the first of each component."""
    places = materialise(signed_lines(docs), "lines")
    banded = places.filter("bands is not null").select(F.explode("bands").alias("band"), "line_id", "sketch")
    joined = line_components(docs, banded)
    placed = _join_keys(places.select("doc_id", "row", "line_no", "line_id"), joined, "line_id", "left")
    placed = placed.select("doc_id", "row", "line_no", F.coalesce("component", "line_id").alias("component"))
    many = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    repeated = materialise(_join_keys(placed, materialise(many, "repeated-components"), "component", "left_semi"), "repeated-lines")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line_no")
    heads = materialise(repeated.groupBy("component").agg(F.min(place).alias("head")), "first-lines")
    return _join_keys(repeated, heads, "component", "inner").filter(place != F.col("head")).select("doc_id", "row", "line_no")


def _join_keys(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """A join with a materialised table of one short row per key: broadcast up to BROADCAST_KEYS rows, by a shuffle beyond."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_KEYS else right, key, how)


def _without_repeats(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with text rewritten plus the numbers of the lines taken out, null where none were, and that column's name."""
    row, gone_name = free_name(docs, "__row"), free_name(docs, "__gone")
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated_lines(slim).groupBy("row").agg(F.collect_set("line_no").alias(gone_name)).withColumnRenamed("row", row)
    gone = materialise(gone, "gone")
    lines, rows = gone.agg(F.coalesce(F.sum(F.size(gone_name)), F.lit(0)), F.count(F.lit(1))).first()
    small = lines <= 4 * BROADCAST_KEYS and rows <= BROADCAST_KEYS
    marked = docs.withColumn(row, row_key()).join(F.broadcast(gone) if small else gone, row, "left")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone_name))
    kept = let(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    return marked.withColumn("text", F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(kept)).drop(row), gone_name


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of text; all rows and columns stay.

    A document may be left with empty text; n_chars, where docs has it, is counted anew. Null texts stay null. Rows equal
    in doc_id and text are judged as one document, so all of them keep the same lines. Other columns stay as they are,
    whatever their names. No rows give no rows.
    """
    out, gone = _without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_removed, and kept_chars and kept_sha256 of the text that dedup_lines leaves (null: empty)."""
    after, gone = _without_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kept = F.coalesce("text", F.lit(""))
    return after.select("doc_id", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
