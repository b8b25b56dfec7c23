"""URL filters: longest-match rules, then exact blocklist membership by a cascade of Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.llm.text import ascii_lower
from susceptra.storage import materialise

#: (verdict, host, path); the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that are blocked with all their subdomains where no rule speaks.
BLOCKLIST = ("ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org")
#: A synthetic blocklist for tables without one: beside BLOCKLIST, every host or parent whose md5 starts so.
LISTED_MD5 = "0"
BITS_PER_KEY, HASHES, MAX_FILTER_BYTES = 6, 4, 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no '://'."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls. A rule fits its host and subdomains where the path starts with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> Column:
    """The host and its parents of two labels or more; a host of one label stands for itself; none for the empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    own = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(own)


class Cascade:
    """Levels of bits. Odd and even levels encode listed and unlisted keys in turn; a key's first miss decides."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    @staticmethod
    def positions(h1: np.ndarray, h2: np.ndarray, size: int, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = h1 ^ (h2 * np.uint64(2 * seed + 1))
            return (mixed[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * (h2 | np.uint64(1))[:, None]) % np.uint64(size)

    def passed(self, h1: np.ndarray, h2: np.ndarray, upto: int | None = None) -> np.ndarray:
        """How many levels, from the first on, each key passes."""
        depth, alive = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
        for size, seed, data in self.levels[:upto]:
            bits = np.frombuffer(data, np.uint8)
            at = self.positions(h1[alive], h2[alive], size, seed)
            ok = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
            index = np.flatnonzero(alive)
            depth[index[ok]] += 1
            alive[index[~ok]] = False
        return depth

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe the cascade was built over."""
        return self.passed(h1, h2) % 2 == 1


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.concat(F.lit("#"), F.col("key"))))


def _level(keys: DataFrame, n: int, seed: int) -> tuple[int, int, bytes]:
    """One filter: positions are marked by executors, blocks of 32 kB of bits are merged, and the whole is at most MAX_FILTER_BYTES."""
    size = max(64, -(-n * BITS_PER_KEY // 8) * 8)
    if size // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"a level of {size // 8} bytes is over the bound: split the keys by hash and build a cascade for each part")
    block = 1 << 18

    def mark(batches):
        """A task marks its own copy of the filter, whose size is bounded, and sends each touched block once."""
        data, touched = np.zeros(-(-size // block) * (block // 8), np.uint8), set()
        for pdf in batches:
            at = Cascade.positions(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), size, seed).ravel()
            np.bitwise_or.at(data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            touched |= set(np.unique(at // np.uint64(block)).tolist())
        for b in sorted(touched):
            yield pd.DataFrame({"block": [int(b)], "bits": [data[b * (block // 8) : (b + 1) * (block // 8)].tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block // 8, np.uint8)
        for x in pdf.bits:
            bits |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "bits": [bits.tobytes()]})

    blocks = keys.select("h1", "h2").mapInPandas(mark, "block long, bits binary").groupBy("block").applyInPandas(merge, "block long, bits binary").collect()
    data = np.zeros(-(-size // block) * (block // 8), np.uint8)
    for r in blocks:
        data[r.block * (block // 8) : (r.block + 1) * (block // 8)] = np.frombuffer(r.bits, np.uint8)
    return size, seed, data[: -(-size // 8)].tobytes()


def build_cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 40) -> Cascade:
    """universe (key) and listed (key), strings -> Cascade exact over both; levels shrink by the false-positive rate of some 6 %.

    Level 0 encodes the listed keys, level 1 the other keys that pass it, level 2 the listed keys that pass level 1, and so
    on until none are left. Only filters come to the driver; keys stay on executors. No listed keys: nothing is contained.
    """
    yes = materialise(_hashed(listed.filter("key is not null").distinct()), "listed")
    no = materialise(_hashed(universe.filter("key is not null").distinct().join(listed, "key", "left_anti")), "unlisted")
    cascade = Cascade([])
    sides = [yes, no]
    for level in range(max_levels):
        side = sides[level % 2]
        if level:
            def survive(batches, now=cascade, need=level):
                for pdf in batches:
                    yield pdf[now.passed(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64)) == need]

            side = sides[level % 2] = materialise(side.mapInPandas(survive, side.schema), "survivors")
        n = side.count()
        if not n:
            return cascade
        cascade = Cascade([*cascade.levels, _level(side, n, level)])
    raise RuntimeError("the cascade did not settle: are keys both listed and unlisted with equal hashes?")


def judge(pages: DataFrame, rules=RULES, blocklist=BLOCKLIST, listed_md5: str | None = LISTED_MD5, listed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages plus host, path, rule and verdict (allow or block).

    Where no rule fits, a url is blocked if its host or a parent is listed: in blocklist, by its md5, or in the table
    listed (key), which may be of any size. Null urls and urls without '://' have an empty
    host, no rule and verdict allow. Repeated rows and other columns are kept; columns named like the results are replaced.
    No rows give no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    pages = pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"}])
    parsed = pages.withColumn("host", host).withColumn("path", path)
    universe = parsed.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    universe = materialise(universe.distinct(), "universe")
    keys = spark.createDataFrame([(h,) for h in blocklist], "key string")
    if listed_md5 is not None:
        keys = keys.unionByName(universe.filter(F.startswith(F.md5("key"), F.lit(listed_md5))))
    if listed is not None:
        keys = keys.unionByName(listed.select("key"))
    cascade = build_cascade(universe, materialise(keys, "blocklist"))

    @F.pandas_udf("boolean")
    def found_in(h1: pd.Series, h2: pd.Series) -> pd.Series:
        counts = h1.map(len).to_numpy()
        if not counts.sum():
            return pd.Series(np.zeros(len(h1), bool))
        found = cascade.contains(np.concatenate(h1.to_list()).astype(np.int64).view(np.uint64), np.concatenate(h2.to_list()).astype(np.int64).view(np.uint64))
        owner = np.repeat(np.arange(len(h1)), counts)
        return pd.Series(np.bincount(owner, found, len(h1)) > 0)

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keys = suffixes(F.col("host"))
    hit = found_in(F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.concat(F.lit("#"), k))))
    return parsed.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))))
