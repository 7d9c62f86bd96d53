"""Microsatellites: tallies, rungs and clear peaks, candidate alleles, stutter fits, genotypes, emission."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config


def tally(reads: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, seq, reads): how often each tract sequence was seen."""
    return reads.where(F.col(seq).isNotNull()).groupBy(*keys, seq).agg(F.count("*").alias("reads"))


def outcome(spans_left: Column, spans_right: Column, low_quality: Column, truncated: Column, widened: Column) -> Column:
    """What becomes of a read at a locus, the first that applies."""
    return F.when(~(spans_left & spans_right), "border_off_end").when(truncated, "window_truncated").when(low_quality, "low_quality").when(widened, "widened_sequence").otherwise("sequence")


def rungs(tallies: DataFrame, keys: list[str], seq: str, reads: str, period: Column) -> DataFrame:
    """(keys, units, reads, sequences): support of each length in whole units."""
    units = F.floor(F.length(seq) / period).cast("int")
    return tallies.groupBy(*keys, units.alias("units")).agg(F.sum(reads).alias("reads"), F.count_distinct(seq).alias("sequences"))


def clear_peaks(ladder: DataFrame, keys: list[str], units: str = "units", reads: str = "reads", prominence: int = config.RUNG_PROMINENCE) -> DataFrame:
    """Rungs whose support tops both neighbours' by more than the prominence; a length not seen counts as 0."""
    by = Window.partitionBy(*keys).orderBy(units)
    below = F.coalesce(F.sum(reads).over(by.rangeBetween(-1, -1)), F.lit(0))
    above = F.coalesce(F.sum(reads).over(by.rangeBetween(1, 1)), F.lit(0))
    return ladder.withColumn("_b", below).withColumn("_a", above).where((F.col(reads) > F.col("_b") + prominence) & (F.col(reads) > F.col("_a") + prominence)).drop("_a", "_b")


def recurrent(peaks: DataFrame, locus: list[str], sample: str, units: str = "units", least: int = 2) -> DataFrame:
    """(locus, units, samples): lengths that are clear peaks in enough samples."""
    return peaks.groupBy(*locus, units).agg(F.count_distinct(sample).alias("samples")).where(F.col("samples") >= least)


def candidates(tallies: DataFrame, locus: list[str], seq: str, reads: str, sample: str, least_reads: int = 8, least_samples: int = 3, least_share: float = 0.10) -> DataFrame:
    """(locus, seq, role): for each length the sequence with most reads, the smallest of equals, and its frequent siblings."""
    per = tallies.groupBy(*locus, seq).agg(F.sum(reads).alias("reads"), F.count_distinct(sample).alias("samples")).withColumn("_len", F.length(seq))
    own = Window.partitionBy(*locus, "_len")
    ranked = per.withColumn("_rank", F.row_number().over(own.orderBy(F.col("reads").desc(), seq))).withColumn("_all", F.sum("reads").over(own))
    role = F.when(F.col("_rank") == 1, "representative").when((F.col("reads") >= least_reads) & (F.col("samples") >= least_samples) & (F.col("reads") >= least_share * F.col("_all")), "sibling")
    return ranked.withColumn("role", role).where("role IS NOT NULL").select(*locus, seq, "reads", "samples", "role")


def modal_units(ladder: DataFrame, locus: list[str], units: str = "units", reads: str = "reads") -> DataFrame:
    """(locus, modal): the length with most reads, the shortest of equals."""
    per = ladder.groupBy(*locus, units).agg(F.sum(reads).alias("_n"))
    return per.groupBy(*locus).agg((-F.max(F.struct("_n", (-F.col(units)).alias("u")))["u"]).alias("modal"))


def weighted_line(points: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(keys, slope, intercept) of the weighted least-squares line; null where x does not vary."""
    w, xx, yy = F.col(weight).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    sums = points.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * xx).alias("wx"), F.sum(w * yy).alias("wy"), F.sum(w * xx * xx).alias("wxx"), F.sum(w * xx * yy).alias("wxy"))
    spread = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    slope = F.when(spread > 0, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / spread)
    return sums.withColumn("slope", slope).withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).select(*keys, "slope", "intercept")


def geometric_decay(mean: Column) -> Column:
    """The decay of a geometric law on 1, 2, ... with that mean."""
    return F.when(mean >= 1, (mean - 1) / mean).otherwise(0.0)


def frequency_prior(units: Column, modal: Column, p: Column) -> Column:
    return F.greatest(F.pow(p, F.abs(units - modal).cast("double")), F.lit(1e-12))


def stutter_log(slip: np.ndarray, up: float, down: float, decay: float) -> np.ndarray:
    """Log probability of a slip by whole units: none, or up or down by a geometric magnitude."""
    size = np.abs(slip)
    p = np.where(slip == 0, 1 - up - down, np.where(slip > 0, up, down) * (1 - decay) * decay ** np.maximum(size - 1, 0))
    return np.log(np.maximum(np.where(size <= 10, p, 0), 1e-12))


def genotype_em(lengths: np.ndarray, reads: np.ndarray, alleles: np.ndarray, f: float = 0.0, up: float = 0.02, down: float = 0.05, decay: float = 0.3, mixture: float = 0.01, iterations: int = 50, tolerance: float = 1e-6) -> dict:
    """Diploid EM over one locus. lengths: the units that reads show; reads: [samples, lengths]; alleles: candidate units."""
    k, d = len(alleles), len(lengths)
    s = np.exp(stutter_log(lengths[:, None] - alleles[None, :], up, down, decay))
    pairs = [(i, j) for j in range(k) for i in range(j + 1)]
    given = np.stack([(1 - mixture) * (s[:, i] + s[:, j]) / 2 + mixture / d for i, j in pairs], axis=1)
    ll = reads @ np.log(given)
    hom = np.array([i == j for i, j in pairs])
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    pi = np.full(k, 1 / k)
    post, it = np.zeros_like(ll), 0
    for it in range(1, iterations + 1):  # noqa: B007
        prior = np.where(hom, f * pi[a] + (1 - f) * pi[a] ** 2, (1 - f) * 2 * pi[a] * pi[b])
        z = ll + np.log(np.maximum(prior, config.PROBABILITY_FLOOR))
        post = np.exp(z - z.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        counts = np.zeros(k)
        np.add.at(counts, a, post.sum(axis=0))
        np.add.at(counts, b, post.sum(axis=0))
        new = counts / counts.sum()
        moved, pi = np.abs(new - pi).max(), new
        if moved < tolerance:
            break
    best = post.argmax(axis=1)
    gq = np.clip(np.round(-10 * np.log10(np.maximum(1 - post.max(axis=1), 1e-10))), 0, 99).astype(int)
    return {"first": alleles[a[best]], "second": alleles[b[best]], "gq": gq, "frequencies": pi, "iterations": it}


def call(ladder: DataFrame, locus: list[str], sample: str, units: str = "units", reads: str = "reads", most_alleles: int = 6) -> DataFrame:
    """(locus, sample, first, second, gq) from the cohort's ladder. Candidates are a locus's best supported lengths."""
    packed = ladder.groupBy(*locus).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(units).alias("u"), F.col(reads).alias("n")))).alias("rows"))
    kind = ladder.schema[sample].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for at, rows in enumerate(df["rows"]):
                samples = sorted({x["s"] for x in rows})
                lengths = np.array(sorted({x["u"] for x in rows}))
                grid = np.zeros((len(samples), len(lengths)))
                for x in rows:
                    grid[samples.index(x["s"]), int(np.searchsorted(lengths, x["u"]))] += x["n"]
                support = grid.sum(axis=0)
                alleles = np.sort(lengths[np.argsort(-support, kind="stable")[:most_alleles]])
                r = genotype_em(lengths, grid, alleles)
                own = [df[c].iloc[at] for c in locus]
                out += [(*own, s, int(x), int(y), int(q)) for s, x, y, q in zip(samples, r["first"], r["second"], r["gq"], strict=True)]
            yield pd.DataFrame(out, columns=[*locus, sample, "first", "second", "gq"])

    schema = ", ".join(f"{c} {ladder.schema[c].dataType.simpleString()}" for c in locus)
    return packed.mapInPandas(run, f"{schema}, {sample} {kind}, first int, second int, gq int")


def emit(variable_ll: Column, mono_ll: Column, n_alt: Column, n: Column, qual: Column, model: str = "heuristic", margin: float = 0.0, min_qual: float = 20.0) -> Column:
    """Whether a locus is emitted, by one of three models."""
    if model == "bic":
        return 2 * (variable_ll - mono_ll) > n_alt * F.log(F.greatest(n, F.lit(2)).cast("double")) + 2 * margin
    if model == "freebayes":
        return qual >= min_qual
    return n_alt > 0


def fate(catalog: DataFrame, calls: DataFrame, locus: list[str], reason: str) -> DataFrame:
    """catalog with why each locus was or was not emitted; loci without a call had no evidence."""
    return catalog.join(calls, locus, "left").withColumn("fate", F.coalesce(F.col(reason), F.lit("no_evidence")))


def stutter_decay(shift_mean: float) -> float:
    """g0's decay for a mean absolute shift K: (sqrt(1 + K^2) - 1) / K."""
    return (math.sqrt(1 + shift_mean**2) - 1) / shift_mean if shift_mean > 0 else 0.0


def nearest_parent(units: Column, parents: Column) -> Column:
    """(place, slip): the called allele, of an array of lengths in units, nearest to a read's length, the first of equals, and how far off it is; null without any."""
    best = F.array_min(F.transform(parents, lambda p, i: F.struct(F.abs(p - units).alias("off"), i.alias("place"), (units - p).alias("slip"))))
    return F.when(F.size(parents) > 0, F.struct(best["place"].alias("place"), best["slip"].alias("slip")))


def corroboration(calls: DataFrame, keys: list[str], first: str, second: str, first_support: str, second_support: str, balance: float = config.CORROBORATION_BALANCE) -> DataFrame:
    """(keys, allele, carriers): samples that carry an allele cleanly, homozygous or as a het whose weaker allele has that share of the support."""
    weak, total = F.least(first_support, second_support), F.col(first_support) + F.col(second_support)
    hom = F.col(first) == F.col(second)
    clean = F.when(hom, F.array(first)).when((total <= 0) | (weak >= balance * total), F.array(first, second))
    return calls.where(clean.isNotNull()).select(*keys, F.explode(clean).alias("allele")).groupBy(*keys, "allele").agg(F.count("*").alias("carriers"))


def site_quality(calls: DataFrame, keys: list[str], hom_modal: str, posterior_hom: str, posterior: str, most: float = config.SSR_QUAL_CAP) -> DataFrame:
    """(keys, qual): the Phred-scaled probability that every sample is homozygous for the modal allele, from 0 to most. No-calls are not rows."""
    mono = F.when(F.col(hom_modal), F.col(posterior_hom)).otherwise(1.0 - F.col(posterior))
    total = F.sum(F.log10(F.greatest(F.least(mono, F.lit(1.0)), F.lit(1e-6))))
    return calls.groupBy(*keys).agg(F.greatest(F.least(-10.0 * total, F.lit(most)), F.lit(0.0)).alias("qual"))


def shrunk_inbreeding(loci: DataFrame, sample: str, p_hom: str, expected_hom: str, strength: float = config.F_SHRINK, most: float = config.MAX_INBREEDING) -> DataFrame:
    """(sample, f): the mean excess of homozygosity over what a locus' frequencies expect, drawn towards the cohort's mean, the more so the
    fewer loci a sample has. Loci without variation say nothing."""
    excess = (F.col(p_hom) - F.col(expected_hom)) / (1.0 - F.col(expected_hom))
    per = loci.where(F.col(expected_hom) < 1 - 1e-9).groupBy(sample).agg(F.avg(excess).alias("_raw"), F.count("*").alias("_n"))
    cohort = per.agg(F.avg("_raw"))
    drawn = (F.col("_n") * F.col("_raw") + strength * F.col("_cohort")) / (F.col("_n") + strength)
    return per.withColumn("_cohort", cohort.scalar()).select(sample, F.greatest(F.least(drawn, F.lit(most)), F.lit(0.0)).alias("f"))


def burn_in(loci: DataFrame, order: list[str], evidence: str, most: int = config.BURN_IN_LOCI) -> DataFrame:
    """The first loci in catalog order that have evidence, to fit parameters on."""
    return loci.where(F.col(evidence) > 0).orderBy(*order).limit(most)


def segment_reason(period: Column, copies: Column, purity: Column, floors: list[int], min_purity: float = config.MIN_PURITY, periods: tuple[int, int] = (1, 6)) -> Column:
    """Why a repeat is no microsatellite locus, the first reason that applies, or null. floors: the least whole copies of periods 1, 2 and on."""
    floor = F.get(F.array(*[F.lit(n) for n in floors]), period - 1)
    return F.when(~period.between(*periods), "period").when(copies < floor, "copies").when(purity < min_purity, "purity")


def rejected_bases(segments: DataFrame, reason: Column, length: Column) -> DataFrame:
    """(reason, segments, bases): what each reason for rejection costs; accepted segments are listed as such."""
    return segments.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("segments"), F.sum(length).alias("bases"))
