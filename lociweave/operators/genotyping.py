"""Genotypes: likelihoods, expectation-maximisation per locus, site quality, pruning, emission filters, VCF lines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import stats
from lociweave.functions.genotypes import genotype_order, genotype_table, log_coefficient


def likelihoods(alleles: DataFrame, keys: list[str], allele: str = "allele", n_alleles: str = "n_alleles", num_obs: str = "num_obs", q_sum: str = "q_sum", ploidy: int = config.PLOIDY, most: int = config.MAX_ALLELES) -> DataFrame:
    """(keys, genotype, log_likelihood) from a row for each allele of each sample: reads of other alleles count as errors, those of the
    genotype's own as multinomial draws. The genotype table is small by construction (ploidy and alleles are bounded) and broadcast.
    """
    table = genotype_table(alleles.sparkSession, ploidy, most).withColumnsRenamed({"n_alleles": "_k", "allele": "_a"})
    met = alleles.join(F.broadcast(table), (F.col(n_alleles) == F.col("_k")) & (F.col(allele) == F.col("_a")))
    n, share = F.col(num_obs), F.col("copies") / ploidy
    inside = F.col("copies") > 0
    return met.groupBy(*keys, "genotype").agg(
        (
            F.sum(F.when(inside, 0.0).otherwise(F.col(q_sum)))
            + stats.ln_factorial(F.sum(F.when(inside, n).otherwise(0)))
            + F.sum(F.when(inside, stats.xlogy(n, share) - stats.ln_factorial(n)).otherwise(0.0))
        ).alias("log_likelihood")
    )


def best_genotypes(posteriors: DataFrame, keys: list[str], genotype: str, log_weight: str) -> DataFrame:
    """(keys, genotype, gq): the most probable genotype, the first of equals, and how sure it is."""
    own = Window.partitionBy(*keys)
    top = F.max(log_weight).over(own)
    p = F.exp(F.col(log_weight) - top)
    ranked = posteriors.withColumn("_p", p / F.sum(p).over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.col(log_weight).desc(), genotype)))
    return ranked.where("_n = 1").select(*keys, F.col(genotype).alias("genotype"), stats.phred(1.0 - F.col("_p"), config.MAX_GQ).alias("gq"))


def log_priors(counts: np.ndarray, coefficients: np.ndarray, alpha: np.ndarray, f: float) -> np.ndarray:
    """Dirichlet-multinomial log priors of genotypes (rows of allele counts), mixed with inbreeding f for homozygotes. alpha: [..., alleles]."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    base = coefficients + (lg(alpha[..., None, :] + counts) - lg(alpha)[..., None, :]).sum(axis=-1)
    # the constant that all genotypes share matters where priors are mixed
    total, ploidy = alpha.sum(axis=-1), counts[0].sum()
    base = base + (lg(total) - lg(total + ploidy))[..., None]
    if f <= 0:
        return base
    hom = (counts > 0).sum(axis=1) == 1
    own = np.log(np.maximum(alpha / total[..., None], config.PROBABILITY_FLOOR)) @ (counts > 0).T
    with np.errstate(divide="ignore"):
        return np.where(hom, np.logaddexp(np.log1p(-f) + base, math.log(f) + own), np.log1p(-f) + base)


def em_locus(ll: np.ndarray, pseudo: np.ndarray, ploidy: int = config.PLOIDY, f: float = 0.0, theta: float = config.DIVERSITY, iterations: int = config.EM_ITERATIONS, tolerance: float = config.EM_TOLERANCE) -> dict:
    """EM over one locus. ll: [samples, genotypes]; pseudo: a count for each allele, by its class.

    Cohorts start from a flat prior, then use each sample's leave-one-out prior; a single sample uses the prior alone.
    """
    n, k = len(ll), len(pseudo)
    order = genotype_order(ploidy, k)
    counts = np.array([[g.count(a) for a in range(k)] for g in order], dtype=float)
    coefficients = np.array([log_coefficient(g) for g in order])
    alpha = np.array([1.0, *[max(theta / max(1, k - 1), config.MIN_ALT_CONCENTRATION)] * (k - 1)])
    expected, p_hat, converged, delta = np.zeros((n, k)), pseudo / pseudo.sum(), False, np.inf

    def posterior(prior: np.ndarray) -> np.ndarray:
        z = ll + prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    it = 0
    for it in range(1, iterations + 1):  # noqa: B007
        if n > 1:
            prior = np.zeros_like(ll) if it == 1 else log_priors(counts, coefficients, alpha + np.maximum(expected.sum(axis=0) - expected, 0.0), f)
        else:
            prior = log_priors(counts, coefficients, alpha, f)[None, :]
        post = posterior(prior)
        now = post @ counts
        new = (now.sum(axis=0) + pseudo) / (now.sum() + pseudo.sum())
        delta = np.abs(now.sum(axis=0) - expected.sum(axis=0)).max() / (ploidy * n) if n > 1 else np.abs(new - p_hat).max()
        expected, p_hat = now, new
        if delta < tolerance and not (n > 1 and it == 1):
            converged = True
            break
    prior = log_priors(counts, coefficients, alpha + np.maximum(expected.sum(axis=0) - expected, 0.0), f) if n > 1 else log_priors(counts, coefficients, alpha, f)[None, :]
    post = posterior(prior)
    best = post.argmax(axis=1)
    wrong = np.maximum(1 - post.max(axis=1), config.PROBABILITY_FLOOR)
    return {"frequencies": p_hat, "posteriors": post, "best": best, "gq": np.clip(-10 * np.log10(wrong), 0, config.MAX_GQ), "qual": site_quality(ll, counts, pseudo, ploidy), "iterations": it, "converged": converged}


def site_quality(ll: np.ndarray, counts: np.ndarray, pseudo: np.ndarray, ploidy: int) -> float:
    """Phred of the probability that no copy is non-reference: genotypes collapse to their number of such copies, samples are
    convolved, and a beta-binomial prior by the pseudocounts weighs each total."""
    copies = (ploidy - counts[:, 0]).astype(int)
    # within a class of copies the genotypes share the weight of their expected frequencies
    weights = np.log(np.maximum(pseudo / pseudo.sum(), config.PROBABILITY_FLOOR))
    alt = weights.copy()
    alt[1:] -= np.logaddexp.reduce(weights[1:]) if len(weights) > 1 else 0.0
    alt[0] = 0.0
    prior = counts @ alt + np.array([math.lgamma(c + 1) - sum(math.lgamma(x + 1) for x in row[1:]) for c, row in zip(copies, counts, strict=True)])
    dist = np.array([0.0])
    for row in ll:
        z = row + prior
        one = np.array([np.logaddexp.reduce(z[copies == c]) if (copies == c).any() else -np.inf for c in range(ploidy + 1)])
        # each copy number's share of orderings
        one = one + np.array([math.lgamma(ploidy + 1) - math.lgamma(c + 1) - math.lgamma(ploidy - c + 1) for c in range(ploidy + 1)])
        grid = np.full(len(dist) + ploidy, -np.inf)
        for c in range(ploidy + 1):
            grid[c : c + len(dist)] = np.logaddexp(grid[c : c + len(dist)], dist + one[c])
        dist = grid
    total = len(dist) - 1
    a, b = pseudo[1:].sum(), pseudo[0]
    lg = math.lgamma
    # the number of orderings is already in the convolution, so the prior is one ordering's
    beta = np.array([lg(c + a) + lg(total - c + b) - lg(total + a + b) + lg(a + b) - lg(a) - lg(b) for c in range(total + 1)])
    z = dist + beta
    p0 = math.exp(z[0] - np.logaddexp.reduce(z))
    return float(min(config.MAX_QUAL, -10 * math.log10(max(p0, config.PROBABILITY_FLOOR))))


EM_OUT = "samples array<string>, genotypes array<int>, gq array<double>, frequencies array<double>, posteriors array<array<double>>, qual double, iterations int, converged boolean"


def call_loci(likelihood_rows: DataFrame, keys: list[str], sample: str, classes: str, f: float = 0.0, theta: float = config.DIVERSITY, ploidy: int = config.PLOIDY) -> DataFrame:
    """A row for each locus. likelihood_rows: (keys, sample, classes: array<string> of allele classes, lls: array<double> by genotype).

    A locus's samples come together once, as one array; loci stay spread over the cluster.
    """
    packed = likelihood_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).cast("string").alias("s"), F.col("lls")))).alias("rows"), F.first(classes).alias("classes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for rows, kinds in zip(df["rows"], df["classes"], strict=True):
                pseudo = np.array([config.PSEUDOCOUNTS[c] for c in kinds])
                r = em_locus(np.array([list(x["lls"]) for x in rows]), pseudo, ploidy, f, theta)
                out.append(([x["s"] for x in rows], r["best"].tolist(), r["gq"].tolist(), r["frequencies"].tolist(), r["posteriors"].tolist(), r["qual"], r["iterations"], r["converged"]))
            names = [c.split()[0] for c in EM_OUT.split(", ")]
            yield pd.concat([df[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = ", ".join(f"{k} {likelihood_rows.schema[k].dataType.simpleString()}" for k in keys)
    return packed.mapInPandas(run, f"{schema}, {EM_OUT}")


def prune_unused(frequencies: list[float], posteriors: list[list[float]], best: list[int], ploidy: int = config.PLOIDY) -> tuple[list[int], list[float], list[list[float]], list[int]]:
    """With three alleles or more, those that no best genotype holds go; frequencies and posteriors are renormalised."""
    k = len(frequencies)
    order = genotype_order(ploidy, k)
    kept = sorted({0} | {a for g in best for a in order[g]})
    if k < 3 or len(kept) == k:
        return list(range(k)), frequencies, posteriors, best
    new = genotype_order(ploidy, len(kept))
    at = {g: i for i, g in enumerate(order)}
    columns = [at[tuple(kept[a] for a in g)] for g in new]
    total = sum(frequencies[a] for a in kept)
    rows = []
    for row in posteriors:
        part = [row[c] for c in columns]
        s = sum(part)
        rows.append([x / s for x in part] if s > 0 else part)
    return kept, [frequencies[a] / total for a in kept], rows, [int(np.argmax(r)) for r in rows]


def gate(loci: DataFrame, genotypes: str, qual: str, balance_lrs: str, min_qual: float = config.MIN_QUAL, min_lr: float = config.AB_MIN_LOG_LR) -> DataFrame:
    """loci with drop_reason: hom_ref, low_qual, allele_balance, in this order, or null. balance_lrs: a ratio for each het carrier, null for others."""
    carriers = F.filter(F.arrays_zip(F.col(genotypes).alias("g"), F.col(balance_lrs).alias("lr")), lambda x: x["g"] != 0)
    unbalanced = (F.size(carriers) > 0) & F.forall(carriers, lambda x: F.coalesce(x["lr"] < min_lr, F.lit(False)))
    reason = F.when(~F.exists(genotypes, lambda g: g != 0), "hom_ref").when(F.col(qual) < min_qual, "low_qual").when(unbalanced, "allele_balance")
    return loci.withColumn("drop_reason", reason)


def refine_quality(qual: Column, n_ref: Column, fwd_ref: Column, left_ref: Column, n_alt: Column, fwd_alt: Column, left_alt: Column, n_total: Column, expected: Column) -> Column:
    """Site quality less penalties for too few ALT reads and for strand or placement bias, floored at 0."""
    p = stats.clamp(expected / n_total, 1e-6, 0.999)
    balance = F.when((p < 0.9) & (n_alt < p * n_total), stats.phred(stats.binomial_tail(n_alt, n_total, p), 3000.0)).otherwise(0.0)

    def share(x: Column) -> Column:
        return F.when(n_ref > 0, stats.clamp(x / n_ref, 0.01, 0.99)).otherwise(0.5)

    bias = F.greatest(stats.phred(stats.binomial_tail(fwd_alt, n_alt, share(fwd_ref)), 3000.0), stats.phred(stats.binomial_tail(left_alt, n_alt, share(left_ref)), 3000.0))
    refined = F.greatest(F.lit(0.0), qual - balance - bias * stats.bias_ramp(n_alt.cast("double")))
    return F.when((n_alt < 1) | (n_total < 1), qual).otherwise(refined)


def genotype_text(genotype: Column, ploidy: int = 2, most: int = config.MAX_ALLELES) -> Column:
    """A genotype's number as unphased alleles, through a literal array."""
    return F.get(F.array(*[F.lit("/".join(map(str, g))) for g in genotype_order(ploidy, most)]), genotype)
