"""Statistics as Column expressions, all inside whole-stage code generation unless they fold over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociweave.config import MAX_INBREEDING, MAX_SLIP, PROBABILITY_FLOOR

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """ln Γ of a positive number."""

    def upper(z: Column) -> Column:
        s = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:]):
            s = s + c / (z + float(i))
        t = z + 6.5
        return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(t) - t + F.log(s)

    x = x.cast("double")
    return F.when(x < 0.5, upper(x + 1.0) - F.log(x)).otherwise(upper(x))


def ln_factorial(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise(lgamma(n + 1))


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sum_exp(xs: Column) -> Column:
    """Of an array; its largest member is taken out first."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def softmax(xs: Column) -> Column:
    total = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - total))


def argmax(xs: Column) -> Column:
    """The place of the first largest member, from 0."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def phred(p_error: Column, most: float) -> Column:
    return clamp(-10.0 * F.log10(F.greatest(p_error, F.lit(PROBABILITY_FLOOR))), 0.0, most)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    p = clamp(p, 1e-12, 1 - 1e-12)
    return F.log(p / (1 - p))


def linear_grid(n: int, low: float, high: float) -> list[float]:
    return [(low + high) / 2] if n <= 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def hwe_log_priors(p: Column, f: Column) -> tuple[Column, Column, Column]:
    """Logs of hom-REF, het and hom-ALT by ALT frequency p and inbreeding f."""
    q = 1.0 - p
    return tuple(F.log(F.greatest(x, F.lit(PROBABILITY_FLOOR))) for x in (q * q + f * p * q, 2.0 * p * q * (1.0 - f), p * p + f * p * q))


def dirichlet_multinomial(copies: list[Column], alphas: list[Column], log_coefficient: Column) -> Column:
    """The log weight of a genotype with these copies of each allele, up to a constant that all genotypes share."""
    total = log_coefficient
    for k, a in zip(copies, alphas, strict=True):
        total = total + F.when(k == 0, F.lit(0.0)).otherwise(lgamma(a + k) - lgamma(a))
    return total


def beta_binomial_log(k: Column, n: Column, p: Column, strength: float) -> Column:
    """Log probability of k of n, the binomial coefficient left out."""
    a, b = p * strength, (1.0 - p) * strength
    return lgamma(k + a) + lgamma(n - k + b) - lgamma(n + strength) + lgamma(F.lit(strength)) - lgamma(a) - lgamma(b)


def allele_balance_lr(k: Column, n: Column, expected: Column, strength: float) -> Column:
    """How much worse the expected share explains k of n than the share seen; 0 without reads."""
    p0, free = clamp(expected, 1e-6, 1 - 1e-6), clamp(k / n, 1e-6, 1 - 1e-6)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), beta_binomial_log(k, n, p0, strength) - beta_binomial_log(k, n, free, strength)))


def welch_t(n1: Column, s1: Column, ss1: Column, n2: Column, s2: Column, ss2: Column) -> Column:
    """Of two groups given by count, sum and sum of squares; null with under two of either or where only the means differ."""

    def variance(n: Column, s: Column, ss: Column) -> Column:
        return F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1))

    se2 = variance(n1, s1, ss1) / n1 + variance(n2, s2, ss2) / n2
    diff = s1 / n1 - s2 / n2
    t = F.when(se2 > 0, diff / F.sqrt(se2)).when(F.abs(diff) < 2.220446049250313e-16, F.lit(0.0))
    return F.when((n1 >= 2) & (n2 >= 2), t)


def strand_z(ref_n: Column, ref_fwd: Column, alt_n: Column, alt_fwd: Column) -> Column:
    """Two-proportion z; null where a margin is under two or nothing varies."""
    fwd, n = ref_fwd + alt_fwd, ref_n + alt_n
    p = fwd / n
    variance = p * (1.0 - p) * (1.0 / alt_n + 1.0 / ref_n)
    enough = (ref_n >= 2) & (alt_n >= 2) & (fwd >= 2) & (n - fwd >= 2)
    return F.when(enough & (variance > 0), (alt_fwd / alt_n - ref_fwd / ref_n) / F.sqrt(variance))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """Two-sided probability of outcomes no likelier than k of n (Sterne), by exact summation."""

    def log_pmf(x: Column) -> Column:
        return ln_factorial(n) - ln_factorial(x) - ln_factorial(n - x) + xlogy(x, p) + xlogy(n - x, 1.0 - p)

    seen = log_pmf(k)
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), F.lit(0.0), lambda acc, x: acc + F.when(log_pmf(x) <= seen + 1e-7, F.exp(log_pmf(x))).otherwise(0.0))
    return F.when(n < 1, F.lit(1.0)).otherwise(clamp(total, 1e-300, 1.0))


def bias_ramp(n_alt: Column) -> Column:
    """No weight at three ALT reads or fewer, full weight from seven."""
    return clamp((n_alt - 3.0) / 4.0, 0.0, 1.0)


def inbreeding(het: Column, hom_alt: Column) -> Column:
    """F from carriers' genotypes; null without carriers."""
    copies = 2 * hom_alt + het
    return F.when(copies > 0, clamp((2 * hom_alt - het) / copies, 0.0, MAX_INBREEDING))


def fixed_point(x: Column) -> Column:
    """A number that sums to the same total in any order: scaled by 2^40 to a whole decimal."""
    return F.round(x * float(1 << 40)).cast("decimal(38,0)")


def ordered_sum(x: Column) -> Column:
    """The sum of doubles, the same for any partitioning."""
    return F.sum(fixed_point(x)).cast("double") / float(1 << 40)


def contamination_mixture(reads: list[Column], q_sums: list[Column], copies: list[int], contamination: Column, foreign: list[Column]) -> Column:
    """The log likelihood of a genotype with these copies of each allele, where a share of the reads comes from others who show
    each allele with the probability `foreign`. q_sums: natural logs of error rates, summed over an allele's reads."""
    ploidy, others = sum(copies), max(1, len(copies) - 1)
    total = F.lit(0.0)
    for n, q, k, f in zip(reads, q_sums, copies, foreign, strict=True):
        error = clamp(F.exp(q / F.greatest(n, F.lit(1))), 1e-12, 0.5)
        own = (k / ploidy) * (1.0 - error) + ((ploidy - k) / ploidy) * error / others
        total = total + F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(F.greatest((1.0 - contamination) * own + contamination * f, F.lit(PROBABILITY_FLOOR))))
    return total


def interpolated(curve: Column, share: Column) -> Column:
    """The value of a curve, an array of bins over 0 to 1, between the two bin centres nearest to a share, and that of the end bins beyond theirs."""
    x = clamp(share, 0.0, 1.0) * F.size(curve) - 0.5
    low = F.floor(x).cast("int")
    between = F.get(curve, low) * (1.0 - (x - low)) + F.get(curve, low + 1) * (x - low)
    return F.when(x <= 0, F.get(curve, F.lit(0))).when(x >= F.size(curve) - 1, F.element_at(curve, -1)).otherwise(between)


def relative_copies(depth: Column, gc: Column, scale: Column, curve: Column) -> Column:
    """Depth as a multiple of what one copy has at that share of G and C."""
    return depth / (scale * interpolated(curve, gc))


def stutter_probability(difference: Column, period: Column, equal: float, in_frame: tuple[float, float, float], out_of_frame: tuple[float, float, float]) -> Column:
    """How likely a read shows a repeat that many bases longer. The triples: any expansion, any contraction, and the success probability
    by which larger changes get rarer, in units if the change is in whole units, else in bases without one for each unit."""

    def tail(steps: Column, up: float, down: float, geometric: float) -> Column:
        size = F.abs(steps)
        return F.when(size > MAX_SLIP, 0.0).otherwise(F.when(steps < 0, down).otherwise(up) * geometric * F.pow(F.lit(1.0 - geometric), size - 1))

    units = (difference / period).cast("long")  # towards zero
    whole = F.when(units == 0, F.lit(equal)).otherwise(tail(units, *in_frame))
    return F.when(difference % period == 0, whole).otherwise(tail(difference - units, *out_of_frame))


def emission_log(same: Column, quality: Column) -> Column:
    """The log probability of a read's base given the reference's, by its Phred quality; of an inserted base (same is null) that of any base."""
    error = F.pow(F.lit(10.0), -quality / 10.0)
    floor = F.lit(2.2250738585072014e-308)
    return F.when(same, F.log(F.greatest(1.0 - error, floor))).when(~same, F.log(F.greatest(error / 3.0, floor))).otherwise(math.log(0.25))
