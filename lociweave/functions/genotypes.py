"""Genotypes in VCF order, as plain tables that are small by construction: ploidy and alleles are bounded."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession


def genotype_order(ploidy: int, n_alleles: int) -> list[tuple[int, ...]]:
    """Tuples that do not decrease, ordered by their reverse; the first is hom-REF."""
    return sorted(itertools.combinations_with_replacement(range(n_alleles), ploidy), key=lambda g: g[::-1])


def log_coefficient(genotype: tuple[int, ...]) -> float:
    return math.lgamma(len(genotype) + 1) - sum(math.lgamma(genotype.count(a) + 1) for a in set(genotype))


def genotype_table(spark: SparkSession, ploidy: int, most_alleles: int) -> DataFrame:
    """(n_alleles, genotype, allele, copies, log_coefficient), a row for each allele, copies of 0 included."""
    rows = [(n, i, a, g.count(a), log_coefficient(g)) for n in range(1, most_alleles + 1) for i, g in enumerate(genotype_order(ploidy, n)) for a in range(n)]
    return spark.createDataFrame(rows, "n_alleles int, genotype int, allele int, copies int, log_coefficient double")
