"""Cross-sample contamination: expectation-maximisation over blocks of informative sites in genomic order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config
from lociweave.operators.intervals import ensure

C = config.CONTAMINATION


def estimate(observations: DataFrame, order: list[str], sample: str, batch: str, own: str, other_reads: str, depth: str, error: str, block: int = C["block"], c0: float = C["c0"]) -> DataFrame:
    """(sample, contamination) from a row for each informative site and hom-major sample: reads of the major allele's class (own), of
    others, and their error rate.

    Parameters are frozen within a block of sites and refreshed after it; it ends once no sample has moved for some blocks. Blocks are
    inherently one after the other, so the driver loops over blocks, but sums within a block are distributed and what comes back
    is a row for each sample. Samples of small batches get null.
    """
    spark = observations.sparkSession
    sites = observations.select(*order).distinct()
    # the block of each site by its rank: a range partitioning gives ranks without one task that sorts all
    numbered = sites.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] // block)).toDF([*order, "block"])
    rows = observations.join(numbered, order).persist()
    members = rows.select(sample, batch).distinct().groupBy(batch).agg(F.collect_set(sample).alias("s"), F.count("*").alias("n"))
    known = {s: r["n"] >= C["min_batch"] for r in members.collect() for s in r["s"]}
    c, stable, done = dict.fromkeys(known, c0), 0, dict.fromkeys(known, (0.0, 0.0))
    blocks = rows.agg(F.max("block")).first()[0]
    for b in range((blocks if blocks is not None else -1) + 1):
        now = spark.createDataFrame([(s, x) for s, x in c.items()], f"_s {observations.schema[sample].dataType.simpleString()}, c double")
        met = rows.where(F.col("block") == b).join(F.broadcast(now), F.col(sample) == F.col("_s"))
        foreign = F.col("c") / ((1 - F.col("c")) * F.col(error) + F.col("c"))
        sums = met.groupBy(sample).agg(F.sum(F.round(foreign * F.col(other_reads) * float(1 << 30)).cast("long")).alias("x"), F.sum(depth).alias("n")).collect()
        moved = 0.0
        for r in sums:
            x, n = done[r[sample]]
            done[r[sample]] = (x + r["x"] / float(1 << 30), n + r["n"])
            x, n = done[r[sample]]
            new = x / n if n else c0
            moved, c[r[sample]] = max(moved, abs(new - c[r[sample]])), new
        stable = stable + 1 if moved < C["tolerance"] else 0
        if stable >= C["stable_blocks"]:
            break
    rows.unpersist()
    return spark.createDataFrame([(s, x if known[s] else None) for s, x in sorted(c.items(), key=lambda p: str(p[0]))], f"{sample} {observations.schema[sample].dataType.simpleString()}, contamination double")


def assign_batches(samples: DataFrame, batches: DataFrame, sample: str, batch: str) -> DataFrame:
    """samples with their batch, or the default one; a sample named twice is an error."""
    n = F.count("*").over(Window.partitionBy(sample))
    checked = ensure(batches, n > 1, F.lit("a sample is in two batches"))
    return samples.join(checked, sample, "left").withColumn(batch, F.coalesce(batch, F.lit(config.DEFAULT_BATCH)))
