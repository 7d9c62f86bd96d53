"""Cohort loci: merging samples by position, keep masks, alleles across samples, compounds, contamination sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config


def merge_positions(sites: DataFrame, keys: list[str], sample: str, is_ref: Column, num_obs: str, span: str) -> DataFrame:
    """A row for each position: samples, depth, widest reference span, most non-reference reads of any sample.

    Per-sample sums come first, so the second group-by sees a row for each sample; both combine map-side.
    """
    per = sites.groupBy(*keys, sample).agg(F.sum(F.when(~is_ref, F.col(num_obs)).otherwise(0)).alias("nonref"), F.sum(num_obs).alias("depth"), F.max(span).alias("span"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.sum("depth").alias("depth"), F.max("span").alias("max_span"), F.max("nonref").alias("max_nonref"))


def keep_groups(positions: DataFrame, group: list[str], max_nonref: str = "max_nonref", min_alt_obs: int = config.MIN_ALT_OBS) -> DataFrame:
    """Positions of groups whose per-position maxima add up to enough non-reference reads."""
    return positions.withColumn("_sum", F.sum(max_nonref).over(Window.partitionBy(*group))).where(F.col("_sum") >= max(min_alt_obs, 1)).drop("_sum")


def top_alleles(alleles: DataFrame, keys: list[str], count: str, protected: Column, first_seen: list[str], most: int = config.MAX_ALLELES) -> DataFrame:
    """alleles with kept: protected ones, then those with the highest counts, first seen first, up to `most`."""
    order = Window.partitionBy(*keys).orderBy(F.when(protected, 0).otherwise(1), F.col(count).desc(), *first_seen)
    return alleles.withColumn("allele_rank", F.row_number().over(order)).withColumn("kept", protected | (F.col("allele_rank") <= most))


def compounds(observations: DataFrame, sample: str, chain: str, position: str, allele: str) -> DataFrame:
    """(constituents, chains, samples): non-reference alleles at two or more positions that the same read chain carries."""
    one = observations.select(sample, chain, F.concat_ws(":", F.col(position).cast("string"), F.col(allele)).alias("_c"), F.col(position).alias("_p")).distinct()
    per = one.groupBy(sample, chain).agg(F.array_sort(F.collect_set(F.struct("_p", "_c"))).alias("_cs")).where(F.size("_cs") >= 2)
    named = per.select(sample, F.array_join(F.transform("_cs", lambda x: x["_c"]), "|").alias("constituents"))
    return named.groupBy("constituents").agg(F.count("*").alias("chains"), F.count_distinct(sample).alias("samples"))


def informative_sites(sites: DataFrame, keys: list[str], allele: str, num_obs: str, min_count: int = config.CONTAMINATION["min_minor"], min_fraction: float = config.CONTAMINATION["min_minor_fraction"]) -> DataFrame:
    """Positions whose second allele across samples is frequent enough: keys, alleles, depth, minor."""
    per = sites.groupBy(*keys, allele).agg(F.sum(num_obs).alias("_n"))
    own = Window.partitionBy(*keys)
    ranked = per.withColumn("_rank", F.row_number().over(own.orderBy(F.col("_n").desc(), allele)))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("alleles"), F.sum("_n").alias("depth"), F.max(F.when(F.col("_rank") == 2, F.col("_n"))).alias("minor"))
    return out.where((F.col("minor") >= min_count) & (F.col("minor") >= min_fraction * F.col("depth")))


def hom_major(sites: DataFrame, keys: list[str], allele: str, num_obs: str, min_depth: int = config.CONTAMINATION["min_depth"], min_major: float = config.CONTAMINATION["min_major"]) -> DataFrame:
    """(keys, major, depth) where one allele is nearly all of a sample's reads; of equal ones the last."""
    per = sites.groupBy(*keys).agg(F.max(F.struct(num_obs, allele)).alias("_m"), F.sum(num_obs).alias("depth"))
    return per.where((F.col("depth") >= min_depth) & (F.col(f"_m.{num_obs}") >= min_major * F.col("depth"))).select(*keys, F.col(f"_m.{allele}").alias("major"), "depth")


def variant_positions(sites: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """(keys, has_variant): whether any sample shows more than one allele. A row of sites is a sample's allele."""
    per = sites.groupBy(*keys, sample).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg((F.max("_n") > 1).alias("has_variant"))


SUPPORT = ("fwd", "placed_left", "placed_start", "mapq_sum", "mapq_sum_sq")


def compound_support(observations: DataFrame, sites: DataFrame, sample: str, chain: str, position: str, allele: str) -> DataFrame:
    """(constituents, sample, num_obs, q_sum and the rest): what a sample's anchoring chains are worth as reads of a compound allele.

    Chains count as reads; q_sum is their number by the least mean quality of a constituent; the other sums are the constituents' sums
    by the share of their reads that the chains are. sites: (sample, position, allele) with num_obs, q_sum and the other sums.
    """
    one = observations.select(sample, chain, F.col(position).alias("_p"), F.col(allele).alias("_a")).distinct()
    per = one.groupBy(sample, chain).agg(F.array_sort(F.collect_set(F.struct("_p", "_a"))).alias("_cs")).where(F.size("_cs") >= 2)
    counted = per.groupBy(sample, "_cs").agg(F.count("*").alias("_inter"))
    parts = counted.select(sample, "_cs", "_inter", F.explode("_cs").alias("_c")).select(sample, "_cs", "_inter", F.col("_c._p").alias(position), F.col("_c._a").alias(allele))
    met = parts.join(sites.select(sample, position, allele, "num_obs", "q_sum", *SUPPORT), [sample, position, allele])
    scaled = [F.round(F.sum(c) * F.first("_inter") / F.sum("num_obs")).cast("long").alias(c) for c in SUPPORT]
    out = met.groupBy(sample, "_cs").agg(F.first("_inter").alias("num_obs"), (F.first("_inter") * F.min(F.col("q_sum") / F.col("num_obs"))).alias("q_sum"), *scaled)
    names = F.array_join(F.transform("_cs", lambda x: F.concat_ws(":", x["_p"].cast("string"), x["_a"])), "|")
    return out.select(names.alias("constituents"), sample, "num_obs", "q_sum", *SUPPORT)


def broken_chains(support: DataFrame, samples: DataFrame, sample: str) -> DataFrame:
    """(constituents, sample): the samples, data or not, in which no chain anchors the compound. samples: one array of all, in one row."""
    have = support.groupBy("constituents").agg(F.collect_set(sample).alias("_have")).withColumn("_all", samples.scalar())
    return have.select("constituents", F.explode(F.array_except("_all", "_have")).alias(sample))
