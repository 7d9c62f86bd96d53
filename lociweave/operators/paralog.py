"""Hidden paralogs: a likelihood ratio for each locus, the share of paralogs by EM, and a cut at a false-discovery rate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config


def normal_log(x: np.ndarray, mean, sd) -> np.ndarray:
    return -0.5 * ((x - mean) / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)


def read_log(alt: np.ndarray, ref: np.ndarray, vaf: float) -> np.ndarray:
    return alt * math.log(vaf) + ref * math.log1p(-vaf)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def locus_ratio(alt, ref, copies, f, sigma) -> float:
    """Log ratio of a hidden paralog to a plain variant; arrays hold a value for each sample. NaN without usable samples."""
    alt, ref, copies, f, sigma = (np.asarray(x, dtype=float) for x in (alt, ref, copies, f, sigma))
    use = np.isfinite(copies) & np.isfinite(sigma) & (alt + ref > 0)
    if not use.any():
        return math.nan
    alt, ref, copies, f, sigma = (x[use] for x in (alt, ref, np.clip(copies, 0, config.MAX_COPY_NUMBER), f, sigma))
    n, e = len(alt), config.PARALOG_ERROR
    reads = np.stack([read_log(alt, ref, v) for v in (e, 0.5, 1 - e)], axis=1)
    grid = np.linspace(1 / (2 * n), 1 - 1 / (2 * n), config.FREQUENCY_POINTS) if n > 1 else np.array([0.5])
    weight = -np.log(grid * (1 - grid))
    weight -= log_sum(weight, 0)
    p, q = grid[:, None], 1 - grid[:, None]
    priors = np.log(np.maximum(np.stack([q * q + f * p * q, 2 * p * q * (1 - f), p * p + f * p * q], axis=2), config.PROBABILITY_FLOOR))
    h1 = log_sum(weight + log_sum(priors + reads[None], 2).sum(axis=1), 0) + normal_log(copies, 1.0, sigma).sum()

    low, high, points = config.CARRIER_FREQUENCIES
    freqs = np.linspace(low, high, points)
    plain = reads[:, 0] + normal_log(copies, 1.0, sigma)
    none = (1 - freqs[:, None]) ** 2 + f[None] * freqs[:, None] * (1 - freqs[:, None])
    none = np.clip(none, config.PROBABILITY_FLOOR, 1 - 1e-12)
    parts = []
    for t in config.CARRIER_COPIES:
        cover = normal_log(copies, t / 2, sigma * math.sqrt(t / 2))
        for m in sorted({m for m in (1, t // 2) if 1 <= m <= t - 2}):
            carrier = cover + read_log(alt, ref, m / t)
            parts.append(np.logaddexp(np.log(none) + plain, np.log1p(-none) + carrier).sum(axis=1))
    h2 = np.concatenate(parts)
    return float(log_sum(h2, 0) - math.log(len(h2)) - h1)


def locus_ratios(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lr) from rows with alt, ref, copies, f and sigma for each sample of a locus."""
    packed = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sample", "alt", "ref", "copies", "f", "sigma"))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            lr = [locus_ratio(*([x[c] for x in rows] for c in ("alt", "ref", "copies", "f", "sigma"))) for rows in df["rows"]]
            yield df[keys].assign(lr=lr)

    return packed.mapInPandas(run, ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys) + ", lr double")


def histogram(loci: DataFrame, lr: str) -> DataFrame:
    """(bin, n): ratios in uniform bins with clamped ends; those that are not finite are not counted."""
    low, high, bins = config.LR_HISTOGRAM
    at = F.least(F.greatest(F.floor((F.col(lr) - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1)).cast("int")
    finite = F.col(lr).isNotNull() & ~F.isnan(lr) & (F.abs(lr) != float("inf"))
    return loci.where(finite).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def paralog_share(counts: np.ndarray) -> float:
    """The share of paralogs by EM over the histogram (a few thousand numbers, on the driver); the fallback without loci."""
    low, high, bins = config.LR_HISTOGRAM
    if not counts.sum():
        return config.PARALOG_PRIOR
    lr = low + (np.arange(bins) + 0.5) * (high - low) / bins
    pi, tolerance, most = config.PARALOG_EM
    for _ in range(most):
        z = lr + math.log(pi) - math.log1p(-pi)
        new = float(np.clip((counts / (1 + np.exp(-z))).sum() / counts.sum(), 1e-12, 1 - 1e-12))
        if abs(new - pi) < tolerance:
            return new
        pi = new
    return pi


def fdr_curve(hist: DataFrame, pi: float) -> DataFrame:
    """(bin, n, posterior, q): q is the mean of 1 - posterior over the bins from here up. The histogram is of bounded size, so its
    window runs over a few thousand rows whatever the cohort."""
    low, high, bins = config.LR_HISTOGRAM
    mid = low + (F.col("bin") + 0.5) * ((high - low) / bins)
    post = 1.0 / (1.0 + F.exp(-(mid + math.log(pi) - math.log1p(-pi))))
    # a constant key: at most as many rows as there are bins
    tail = Window.partitionBy(F.lit(0)).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    with_post = hist.withColumn("posterior", post)
    return with_post.withColumn("q", F.sum(F.col("n") * (1.0 - F.col("posterior"))).over(tail) / F.sum("n").over(tail))


def fdr_cut(curve: DataFrame, target: float = config.PARALOG_FDR) -> DataFrame:
    """One row: the lowest ratio whose bin keeps the rate, null if none does."""
    low, high, bins = config.LR_HISTOGRAM
    return curve.where(F.col("q") <= target).agg((low + F.min("bin") * ((high - low) / bins)).alias("threshold"))
