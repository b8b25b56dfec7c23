"""Materialising intermediate results where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        path = f"file://{tempfile.gettempdir()}/susceptra-checkpoints"
        spark.conf.set("susceptra.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/susceptra/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task's share where shares are counted in rows.
SHARE = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys into shares of some SHARE rows.

    Adaptive execution sizes tasks by compressed bytes, which says little of what rows take that are sorted, or multiply,
    after the shuffle. This number of tasks grows with the rows, and what groups or joins by these keys needs no other shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARE)), *keys)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows at once to Python workers: whole texts are long, and a batch is held in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body: inside a lambda a plain column would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_join(left: DataFrame, dim: DataFrame, left_key: str, dim_key: str, salt: Column, max_rows: int = 20_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Left join on a null-safe key to a dimension with unique keys.

    The dimension (already materialised) is counted first: up to max_rows rows and max_bytes of keys it is broadcast;
    beyond that both sides are salted 32 ways, so that a hot key is dealt over 32 tasks.
    """
    size = dim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.col(dim_key).cast("string"))), F.lit(0)).alias("b")).first()
    if size.n <= max_rows and size.b <= max_bytes:
        return left.join(F.broadcast(dim), left[left_key].eqNullSafe(dim[dim_key]), "left").drop(dim[dim_key])
    salted = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    dealt = left.withColumn("__deal", F.pmod(salt, F.lit(32)).cast("int"))
    return dealt.join(salted, dealt[left_key].eqNullSafe(salted[dim_key]) & (dealt["__deal"] == salted["__salt"]), "left").drop(salted[dim_key]).drop("__deal", "__salt")


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted column name, or one like it that df does not have."""
    name = wanted
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
