"""Pileups: the fold of reads into allele statistics, coverage windows and tiles, and what a single sample shows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import stats

SITE = ["sample", "chrom_id", "pos"]


def fold(reads: DataFrame, keys: list[str], bq: str = "bq", fwd: str = "fwd", start: str = "read_start", pos: str = "pos", mapq: str = "mapq") -> DataFrame:
    """The seven statistics of each group. All are additive, so that Spark combines them map-side; log errors are summed as
    whole qualities, so that no order of summation shows."""
    return reads.groupBy(*keys).agg(
        F.count("*").alias("num_obs"),
        (F.sum(F.col(bq).cast("long")) * (-math.log(10) / 10)).alias("q_sum"),
        F.sum(F.col(fwd).cast("long")).alias("fwd"),
        F.sum((F.col(pos) - F.col(start) <= 1).cast("long")).alias("placed_left"),
        F.sum((F.col(pos) == F.col(start)).cast("long")).alias("placed_start"),
        F.sum(F.col(mapq).cast("long")).alias("mapq_sum"),
        F.sum((F.col(mapq) * F.col(mapq)).cast("long")).alias("mapq_sum_sq"),
    )


def sliding_coverage(positions: DataFrame, keys: list[str], pos: str, depth: str, is_gc: str, half: int = config.GC_WINDOW // 2) -> DataFrame:
    """positions with the mean depth and the GC fraction of the covered places within half a window."""
    around = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-half, half)
    return positions.withColumn("windowed_coverage", F.avg(depth).over(around)).withColumn("windowed_gc", F.avg(F.col(is_gc).cast("double")).over(around))


def coverage_histogram(positions: DataFrame, keys: list[str], contig: str, pos: str, depth: str, is_gc: str, window: int = config.GC_WINDOW, gc_bins: int = config.GC_BINS, width: float = config.DEPTH_BIN_WIDTH, bins: int = config.DEPTH_BINS) -> DataFrame:
    """(keys, gc_bin, depth_bin, tiles): tumbling tiles by their GC fraction and mean depth; the last depth bin holds the overflow."""
    tile = F.floor((F.col(pos) - 1) / window)
    tiles = positions.groupBy(*keys, contig, tile.alias("tile")).agg(F.avg(F.col(is_gc).cast("double")).alias("gc"), (F.sum(depth) / F.count("*")).alias("mean"))
    gc_bin = F.least(F.floor(F.col("gc") * gc_bins), F.lit(gc_bins - 1)).cast("int")
    depth_bin = F.least(F.floor(F.col("mean") / width), F.lit(bins)).cast("int")
    return tiles.groupBy(*keys, gc_bin.alias("gc_bin"), depth_bin.alias("depth_bin")).agg(F.count("*").alias("tiles"))


def genotype_class(ref_n: Column, ref_fwd: Column, alt_n: Column, alt_fwd: Column, q_sum: Column, min_depth: int = config.HET_MIN_DEPTH, floor: float = config.HET_ERROR_RATE, margin: float = math.log(10), z: float = config.STRAND_Z) -> Column:
    """hom_ref, het, hom_alt or ambiguous by likelihood ratios; null below the least depth."""
    n = ref_n + alt_n
    e = stats.clamp(F.exp(q_sum / n), floor, config.MAX_SITE_ERROR_RATE)
    hom_ref = alt_n * F.log(e) + ref_n * F.log(1 - e)
    het = n * math.log(0.5)
    hom_alt = alt_n * F.log(1 - e) + ref_n * F.log(e)
    biased = F.coalesce(F.abs(stats.strand_z(ref_n, ref_fwd, alt_n, alt_fwd)) > z, F.lit(False))
    variant = F.greatest(hom_alt, het) - hom_ref > margin
    kind = F.when(~variant, "hom_ref").when(het - hom_alt > margin, F.when(biased, "ambiguous").otherwise("het")).when(het - hom_alt < -margin, "hom_alt").otherwise("ambiguous")
    return F.when(n >= min_depth, kind)


def diversity(samples: DataFrame, het: str = "n_het", hom_alt: str = "n_hom_alt", callable_: str = "callable_positions") -> DataFrame:
    """One row: copies that differ from the reference for each callable copy, or the default with too few copies to tell."""
    copies = F.sum(F.col(het) + 2 * F.col(hom_alt))
    return samples.agg(F.when(copies < config.MIN_COPIES_FOR_DIVERSITY, config.DIVERSITY).otherwise(copies / (2 * F.sum(callable_))).alias("theta"))


def weighted_lower_median(values: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median, weight): the first value where the running weight reaches half, rounded up. Values are bins, so windows are small."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    binned = values.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = binned.withColumn("_run", F.sum("_w").over(order)).withColumn("_total", F.sum("_w").over(Window.partitionBy(*keys)))
    return run.where(F.col("_run") >= F.ceil(F.col("_total") / 2)).groupBy(*keys).agg(F.min(value).alias("median"), F.first("_total").alias("weight"))


def fit_coverage(histogram, gc_bins: int = config.GC_BINS, width: float = config.DEPTH_BIN_WIDTH, bins: int = config.DEPTH_BINS):
    """The single-copy depth, GC curve and spread of one sample's histogram (pandas: gc_bin, depth_bin, tiles), or None where it can't be told."""
    import numpy as np

    counts = np.zeros((gc_bins, bins + 1))
    np.add.at(counts, (histogram["gc_bin"].to_numpy(), histogram["depth_bin"].to_numpy()), histogram["tiles"].to_numpy())
    total = counts.sum()
    marginal = counts.sum(axis=0)
    if not total or marginal[-1] > config.MAX_OVERFLOW * total:
        return None
    inner = marginal[:-1]
    peak = len(inner) - 1 - int(np.argmax(inner[::-1]))  # of equal bins the last
    if peak == 0:
        return None
    left, mid, right = inner[peak - 1], inner[peak], inner[min(peak + 1, len(inner) - 1)]
    curve = left - 2 * mid + right
    shift = float(np.clip(0.5 * (left - right) / curve, -0.5, 0.5)) if curve else 0.0
    mode = (peak + 0.5 + shift) * width
    median = (int(np.searchsorted(np.cumsum(marginal), -(-total // 2))) + 0.5) * width
    if not 0.5 <= mode / median <= 1.5:
        return None
    depth = (np.arange(bins) + 0.5) * width / mode
    band = (depth > config.SINGLE_COPY[0]) & (depth < config.SINGLE_COPY[1])
    anchors = {}
    for g in range(gc_bins):
        own = counts[g, :-1] * band
        if own.sum() >= config.MIN_BIN_COUNT:
            anchors[g] = depth[int(np.searchsorted(np.cumsum(own), -(-own.sum() // 2)))]
    if not anchors:
        return None
    at = sorted(anchors)
    gc = np.interp(np.arange(gc_bins), at, [anchors[g] for g in at])
    half = config.SMOOTH_WINDOW // 2
    gc = np.array([np.median(gc[max(0, g - half) : g + half + 1]) for g in range(gc_bins)])
    relative, weight = [], []
    for g in range(gc_bins):
        relative.append(depth / gc[g])
        weight.append(counts[g, :-1])
    relative, weight = np.concatenate(relative), np.concatenate(weight)
    keep = (relative > config.SINGLE_COPY[0]) & (relative < config.SINGLE_COPY[1]) & (weight > 0)
    if not keep.any():
        return None

    def lower_median(x, w):
        order = np.argsort(x, kind="stable")
        return x[order][int(np.searchsorted(np.cumsum(w[order]), -(-w.sum() // 2)))]

    centre = lower_median(relative[keep], weight[keep])
    sigma = 1.4826 * lower_median(np.abs(relative[keep] - centre), weight[keep])
    return {"mode": mode, "gc_curve": gc.tolist(), "sigma0": max(float(sigma), 1e-3)}


def coverage_models(histograms: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, mode, gc_curve, sigma0), a row for each sample whose model could be fitted."""
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        model = fit_coverage(own)
        return pd.DataFrame([{"sample": str(own[sample].iloc[0]), **model}] if model else [], columns=["sample", "mode", "gc_curve", "sigma0"])

    # a sample's histogram has a bounded number of cells, whatever its depth
    return histograms.groupBy(sample).applyInPandas(run, "sample string, mode double, gc_curve array<double>, sigma0 double")
