"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellplan-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/stage-{uuid.uuid4().hex}"


def fewer_files(df: DataFrame, each: int = 1) -> DataFrame:
    """df in about ``each`` partitions a core of the cluster: small stages would write more files than are worth opening."""
    spark = df.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(each * max(spark.sparkContext.defaultParallelism, wide // 32))


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: worked out once, and kept if executors are lost."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    fewer_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges no longer change, which takes
    a logarithmic number of rounds whatever the diameter. A node with very many edges is safe: its minimum is taken by
    partial aggregation and AQE splits the join on it. Each round is written to the shared checkpoint folder and the one
    before it deleted. Edges with a null end or with equal ends are left out; repeated edges count once.
    """
    spark = edges.sparkSession
    folder = _folder(spark)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()

    def keep(df: DataFrame, k: int) -> DataFrame:
        fewer_files(df).write.parquet(f"{folder}/{k}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{k}")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = keep(pairs, 0)
    before, k = None, 0
    while (state := mark(now)) != before and state[0]:
        before = state
        # Large star: each node's greater neighbours turn to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node and its lesser neighbours turn to the least of them. All edges now point downwards.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        k += 1
        now = keep(small, k)
        _delete(spark, f"{folder}/{k - 1}")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
