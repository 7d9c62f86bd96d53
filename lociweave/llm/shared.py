"""What the operators share: the folder for intermediate tables, Arrow batch sizes and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A machine-local one is made only where the setting is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"lociweave-{os.getuid()}")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(to)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame, label: str, row_group: int | None = None) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, so that a lost executor costs no recomputation; and its path. row_group: bytes, for rows that are themselves large.

    Nothing needs the shuffle files behind it any more; Spark deletes them once the driver has collected what refers to them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for rows that are themselves large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


SHARES = 1000
BITS = 1 << 26  # of a set of keys that is broadcast: 8 MB, however many keys there are


def likely_among(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key (bigint) is not in asked: those whose key's bit is set among BITS. What is left over goes in
    an exact join; this one only spares it rows, and moves none."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1
    sets = asked.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    met = rows.withColumn("_at", place).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(sets), "_bucket")
    at = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def split_join(rows: DataFrame, classes: DataFrame, key: str, copies: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined by `key` to classes, which has a row for each key and in `copies` how many rows have it, so that no key's rows
    meet in one task: a key with more than a SHARES-th of all rows is split into parts of that size by a hash of the columns `spread`.

    Fewer than 2 * SHARES keys can be that frequent, so that their table is broadcast. Null keys join nothing.
    """
    share = max(1, (classes.agg(F.sum(copies)).first()[0] or 0) // SHARES)
    parts = F.ceil(F.col(copies) / share).cast("int")
    frequent = F.broadcast(classes.where(F.col(copies) > share).select(key, parts.alias("_parts")))
    dealt = rows.join(frequent, key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    each = classes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(copies) > share, parts).otherwise(1) - 1))).drop(copies)
    return dealt.join(each, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that links reach.

    Alternating large-star and small-star steps: each id's links are re-hung on its smallest neighbour until only stars
    around smallest ids remain. Links never multiply, the group-bys combine map-side, and a hub's rows meet in joins
    that adaptive execution can split. Each round is cut to the shared folder.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    mark, path = None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now, done = cut(small.where("u <> v").distinct(), label)
        if path:
            drop_path(spark, path)
        path = done
        row = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if (row[0], row[1]) == mark or not row[0]:
            break
        mark = (row[0], row[1])
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def spanning_forest(pairs_a, pairs_b):
    """Of the links given as two arrays of ids, those that join parts not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept
