"""Queries over the test tables, one for each operator or group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import sequence, stats
from lociweave.operators import cohort, contamination, genotyping, intervals, paralog, pileup, scan, ssr
from lociweave.operators import reads as R
from lociweave.plans import bindings as B
from lociweave.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SITE = ["sample", "chrom_id", "pos"]
PLACE = ["chrom_id", "pos"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FLAGGED = "CASE WHEN l_tax = 0.08 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 17 = 0 THEN 2048 ELSE 0 END + CASE WHEN l_suppkey % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN l_orderkey % 29 = 0 THEN 4 ELSE 0 END + CASE WHEN l_quantity = 50 THEN 512 ELSE 0 END"


@query("""SELECT CASE WHEN l_tax = 0.08 THEN 'duplicate' WHEN 5 * l_linenumber < 20 THEN 'low_mapq' WHEN l_partkey % 17 = 0 THEN 'supplementary' WHEN l_suppkey % 13 = 0 THEN 'secondary'
 WHEN l_orderkey % 29 = 0 THEN 'unmapped' WHEN l_quantity = 50 THEN 'qc_fail' WHEN 20 + l_quantity < 30 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL""")
def read_filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    reads = B.table(spark, d, "lineitem").selectExpr(f"{FLAGGED} AS flag", "5 * l_linenumber AS mapq", "20 + l_quantity AS length")
    reason = F.coalesce(R.drop_reason(F.col("flag"), F.col("mapq"), F.col("length")), F.lit("kept"))
    return reads.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {B.SITES} SELECT sample, chrom_id, pos, base, num_obs, round(q_sum, 6) AS q_sum, fwd, placed_left, placed_start, mapq_sum, mapq_sum_sq FROM sites")
def pileup_fold(spark: SparkSession, d: str) -> DataFrame:
    return B.sites(spark, d).select(*SITE, "base", "num_obs", F.round("q_sum", 6).alias("q_sum"), "fwd", "placed_left", "placed_start", "mapq_sum", "mapq_sum_sq")


@query(f"""WITH {B.READS}, w AS (SELECT *, count(*) OVER f AS n, min(base) OVER f = max(base) OVER f AS agree, sum(bq) OVER f AS two,
 row_number() OVER (PARTITION BY sample, chrom_id, pos, chain_id ORDER BY read_start, read_id) AS k, row_number() OVER (PARTITION BY sample, chrom_id, pos, chain_id ORDER BY bq DESC, read_start, read_id) AS w
 FROM reads WINDOW f AS (PARTITION BY sample, chrom_id, pos, chain_id))
 SELECT read_id, base, round(CASE WHEN n <> 2 THEN bq WHEN agree THEN CASE WHEN k = 1 THEN least(two, 200) ELSE 0 END ELSE CASE WHEN w = 1 THEN 0.8 * bq ELSE 0 END END, 3)::DOUBLE AS resolved_bq FROM w""")
def mate_overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    got = R.resolve_mates(B.reads(spark, d), [*SITE, "chain_id"], "base", "bq", "read_start", None, "read_id")
    return got.select("read_id", "base", F.round("resolved_bq", 3).alias("resolved_bq"))


@query(f"""WITH {B.READS}, w AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom_id, pos ORDER BY read_start, read_id) AS n, max(CASE WHEN span = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom_id, pos) AS indel FROM reads)
 SELECT sample, chrom_id, pos, read_id FROM w WHERE n <= CASE WHEN indel = 1 THEN 5 ELSE 8 END""")
def depth_cap(spark: SparkSession, d: str) -> DataFrame:
    reads = B.reads(spark, d).withColumn("indel", F.col("span") == 4)
    return R.cap_depth(reads, SITE, ["read_start", "read_id"], "indel", 8, 5).select(*SITE, "read_id")


@query(f"""WITH {B.READS}, w AS (SELECT chain_id, read_id, pos, count(*) OVER f AS n, max(pos) OVER f - min(pos) OVER f AS apart, min(read_id) OVER f AS first FROM reads WINDOW f AS (PARTITION BY chain_id))
 SELECT read_id, CASE WHEN n = 2 AND apart <= 100 THEN first ELSE read_id END AS chain FROM w""")
def mate_chains(spark: SparkSession, d: str) -> DataFrame:
    reads = B.reads(spark, d).withColumnRenamed("chain_id", "qname")
    return R.link_mates(reads, "qname", "pos", "read_id", 100).select("read_id", F.col("chain_id").alias("chain"))


POSITIONS = f"""{B.SITES}, per AS (SELECT chrom_id, pos, sample, sum(CASE WHEN base <> ref THEN num_obs ELSE 0 END) AS nonref, sum(num_obs) AS depth, max(1 + (pos + chrom_id) % 3) AS span FROM sites GROUP BY ALL),
 positions AS (SELECT chrom_id, pos, count(*) AS n_samples, CAST(sum(depth) AS BIGINT) AS depth, max(span) AS max_span, CAST(max(nonref) AS BIGINT) AS max_nonref FROM per GROUP BY ALL)"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    s = B.sites(spark, d).withColumn("span", 1 + (F.col("pos") + F.col("chrom_id")) % 3)
    return cohort.merge_positions(s, PLACE, "sample", F.col("base") == F.col("ref"), "num_obs", "span")


@query(f"WITH {POSITIONS} SELECT * FROM positions")
def cohort_position_merge(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d)


@query(f"""WITH {POSITIONS}, o AS (SELECT *, pos // 10 AS win FROM positions), k AS (SELECT *, sum(max_nonref) OVER (PARTITION BY chrom_id, win) AS s FROM o) SELECT chrom_id, pos, max_nonref FROM k WHERE s >= 20""")
def keep_mask(spark: SparkSession, d: str) -> DataFrame:
    groups = positions(spark, d).withColumn("win", F.floor(F.col("pos") / 10))
    return cohort.keep_groups(groups, ["chrom_id", "win"], "max_nonref", 20).select(*PLACE, "max_nonref")


ISLANDS = B.SPANS + """, b AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end", span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spans),
 i AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end", span_id ROWS UNBOUNDED PRECEDING) AS island FROM b)"""


@query("WITH " + ISLANDS.format(gap=0) + """, v AS (SELECT contig, island, min(start) AS start, max("end") AS "end", count(*) AS members, max(CASE WHEN variant THEN 1 ELSE 0 END) AS has FROM i GROUP BY contig, island)
 SELECT contig, start, "end", members FROM v WHERE has = 1""")
def variant_islands(spark: SparkSession, d: str) -> DataFrame:
    groups = intervals.variant_groups(B.spans(spark, d), ["contig"], "start", "end", "variant", config.MAX_GROUP_SPAN)
    return groups.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")).drop("island")


@query("WITH " + ISLANDS.format(gap=1) + """ SELECT contig, min(start) AS start, max("end") AS "end", count(*) AS members FROM i GROUP BY contig, island""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union(B.spans(spark, d), ["contig"], "start", "end", 1)


@query("WITH " + ISLANDS.format(gap=60) + """ SELECT contig, min(start) AS start, max("end") AS "end", count(*) AS members FROM i GROUP BY contig, island""")
def gap_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union(B.spans(spark, d), ["contig"], "start", "end", 60)


@query("WITH " + ISLANDS.format(gap=20) + """, n AS (SELECT *, count(*) OVER (PARTITION BY contig, island) AS n FROM i) SELECT contig, start, "end", span_id FROM n WHERE n = 1""")
def bundle_drop(spark: SparkSession, d: str) -> DataFrame:
    return intervals.drop_bundles(B.spans(spark, d), ["contig"], "start", "end", 20).select("contig", "start", "end", "span_id")


@query(f"WITH {B.SPANS} SELECT a.contig, a.span_id AS a_id, b.span_id AS b_id FROM spans a JOIN spans b ON a.contig = b.contig AND a.variant AND NOT b.variant AND a.start <= b.\"end\" AND b.start <= a.\"end\"")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    a = s.where("variant").selectExpr("contig", "start AS a", "`end` AS b", "span_id AS a_id")
    c = s.where("NOT variant").selectExpr("contig", "start AS c", "`end` AS d", "span_id AS b_id")
    return intervals.overlap_join(a, c, ["contig"], ("a", "b"), ("c", "d"), 64).select("contig", "a_id", "b_id")


@query(f"WITH {B.SPANS} SELECT a.contig, a.start AS point, a.span_id FROM spans a WHERE a.variant AND NOT EXISTS (SELECT 1 FROM spans b WHERE NOT b.variant AND a.contig = b.contig AND a.start BETWEEN b.start AND b.\"end\")")
def interval_antijoin(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    points = s.where("variant").selectExpr("contig", "start AS point", "span_id")
    return intervals.outside(points, s.where("NOT variant").select("contig", "start", "end"), ["contig"], "point", ("start", "end"), 64)


@query(f"""WITH {B.SPANS}, p AS (SELECT contig, p FROM (SELECT DISTINCT contig FROM spans), range(1, 3001) r(p)), c AS (SELECT DISTINCT contig, unnest(range(start, "end" + 1)) AS p FROM spans),
 f AS (SELECT * FROM p ANTI JOIN c USING (contig, p)), g AS (SELECT contig, p, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS run FROM f) SELECT contig, min(p) AS start, max(p) AS "end" FROM g GROUP BY contig, run""")
def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    lengths = s.select("contig").distinct().withColumn("length", F.lit(3000).cast("long"))
    return intervals.complement(s, lengths, ["contig"], "start", "end", "length")


@query("WITH " + B.SPANS + """, x AS (SELECT *, max("end") OVER (PARTITION BY contig, variant ORDER BY start, "end", span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spans),
 y AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, variant ORDER BY start, "end", span_id ROWS UNBOUNDED PRECEDING) AS island FROM x),
 u AS (SELECT contig, variant, min(start) AS start, max("end") AS "end" FROM y GROUP BY contig, variant, island)
 SELECT a.contig, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM u a JOIN u b ON a.contig = b.contig AND a.variant AND NOT b.variant AND a.start <= b."end" AND b.start <= a."end" """)
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d)
    return intervals.intersect(s.where("variant"), s.where("NOT variant"), ["contig"], "start", "end", 64)


ALLELES = f"{B.SITES}, alleles AS (SELECT chrom_id, pos, ref, base, count(*) AS cohort_count, CAST(sum(num_obs) AS BIGINT) AS num_obs, min(sample) AS first_seen FROM sites GROUP BY ALL)"


def alleles(spark: SparkSession, d: str) -> DataFrame:
    return B.sites(spark, d).groupBy(*PLACE, "ref", "base").agg(F.count("*").alias("cohort_count"), F.sum("num_obs").alias("num_obs"), F.min("sample").alias("first_seen"))


@query(f"""WITH {ALLELES}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom_id, pos ORDER BY CASE WHEN base = ref THEN 0 ELSE 1 END, cohort_count DESC, first_seen, base) AS n FROM alleles)
 SELECT chrom_id, pos, CASE WHEN base = ref OR n <= 2 THEN base ELSE 'OTHER' END AS allele, CAST(sum(num_obs) AS BIGINT) AS num_obs, count(*) AS members FROM r GROUP BY ALL""")
def allele_topk_other_pool(spark: SparkSession, d: str) -> DataFrame:
    ranked = cohort.top_alleles(alleles(spark, d), PLACE, "cohort_count", F.col("base") == F.col("ref"), ["first_seen", "base"], 2)
    allele = F.when(F.col("kept"), F.col("base")).otherwise("OTHER")
    return ranked.groupBy(*PLACE, allele.alias("allele")).agg(F.sum("num_obs").alias("num_obs"), F.count("*").alias("members"))


@query(f"""WITH {B.READS}, o AS (SELECT DISTINCT sample, chain_id, chrom_id * 10000 + pos AS place, base FROM reads WHERE base <> ref),
 c AS (SELECT sample, chain_id, string_agg(place || ':' || base, '|' ORDER BY place, base) AS constituents, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 2)
 SELECT constituents, count(*) AS chains, count(DISTINCT sample) AS samples FROM c GROUP BY ALL""")
def compound_detect(spark: SparkSession, d: str) -> DataFrame:
    seen = B.reads(spark, d).where("base <> ref").withColumn("place", F.col("chrom_id") * 10000 + F.col("pos"))
    return cohort.compounds(seen, "sample", "chain_id", "place", "base")


def two_alleles(spark: SparkSession, d: str) -> DataFrame:
    b = B.biallelic(spark, d)
    ref = F.struct(F.lit(0).alias("allele"), F.col("ref_num_obs").alias("num_obs"), F.col("ref_q_sum").alias("q_sum"))
    alt = F.struct(F.lit(1).alias("allele"), F.col("alt_num_obs").alias("num_obs"), F.col("alt_q_sum").alias("q_sum"))
    return b.select(*SITE, F.lit(2).alias("n_alleles"), F.explode(F.array(ref, alt)).alias("a")).select(*SITE, "n_alleles", "a.*")


LIKELIHOODS = f"""{B.BIALLELIC}, ll AS (SELECT sample, chrom_id, pos, 0 AS genotype, alt_q_sum AS log_likelihood FROM bi
 UNION ALL SELECT sample, chrom_id, pos, 1, lgamma(ref_num_obs + alt_num_obs + 1) - lgamma(ref_num_obs + 1) - lgamma(alt_num_obs + 1) + (ref_num_obs + alt_num_obs) * ln(0.5) FROM bi
 UNION ALL SELECT sample, chrom_id, pos, 2, ref_q_sum FROM bi)"""


@query(f"WITH {LIKELIHOODS} SELECT sample, chrom_id, pos, genotype, round(log_likelihood, 5) AS log_likelihood FROM ll")
def genotype_likelihood(spark: SparkSession, d: str) -> DataFrame:
    ll = genotyping.likelihoods(two_alleles(spark, d), SITE, most=2)
    return ll.select(*SITE, "genotype", F.round("log_likelihood", 5).alias("log_likelihood"))


@query(f"""WITH {LIKELIHOODS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom_id, pos ORDER BY log_likelihood DESC, genotype) AS n, max(log_likelihood) OVER (PARTITION BY sample, chrom_id, pos) AS top FROM ll),
 p AS (SELECT *, exp(log_likelihood - top) / sum(exp(log_likelihood - top)) OVER (PARTITION BY sample, chrom_id, pos) AS p FROM r)
 SELECT sample, chrom_id, pos, genotype, CASE WHEN 1 - p < 1e-7 THEN 70 ELSE round(least(99, -10 * log10(1 - p)), 3) END::DOUBLE AS gq FROM p WHERE n = 1""")
def genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: reads to genotypes under a flat prior."""
    ll = genotyping.likelihoods(two_alleles(spark, d), SITE, most=2)
    best = genotyping.best_genotypes(ll, SITE, "genotype", "log_likelihood")
    # beyond 70 the last digits are those of the exponential's rounding
    return best.select(*SITE, "genotype", F.when(F.col("gq") > 70, 70.0).otherwise(F.round("gq", 3)).alias("gq"))


FREQ = f"{B.BIALLELIC}, fr AS (SELECT chrom_id, pos, sum(alt_num_obs) / sum(alt_num_obs + ref_num_obs) AS p FROM bi GROUP BY ALL)"


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return B.biallelic(spark, d).groupBy(*PLACE).agg((F.sum("alt_num_obs") / F.sum(F.col("alt_num_obs") + F.col("ref_num_obs"))).alias("p"))


@query(f"""WITH {FREQ} SELECT chrom_id, pos, round(ln(greatest((1-p)*(1-p) + 0.1*p*(1-p), 1e-300)), 8) AS hom_ref, round(ln(greatest(2*p*(1-p)*0.9, 1e-300)), 8) AS het, round(ln(greatest(p*p + 0.1*p*(1-p), 1e-300)), 8) AS hom_alt FROM fr""")
def hwe_prior(spark: SparkSession, d: str) -> DataFrame:
    priors = stats.hwe_log_priors(F.col("p"), F.lit(0.1))
    return frequencies(spark, d).select(*PLACE, *[F.round(x, 8).alias(n) for x, n in zip(priors, ("hom_ref", "het", "hom_alt"), strict=True)])


@query(f"""WITH {FREQ}, a AS (SELECT chrom_id, pos, 1.0 + 10 * (1 - p) AS r, 0.001 + 10 * p AS t FROM fr)
 SELECT chrom_id, pos, round(lgamma(r + 2) - lgamma(r), 6) AS hom_ref, round(ln(2.0) + lgamma(r + 1) - lgamma(r) + lgamma(t + 1) - lgamma(t), 6) AS het, round(lgamma(t + 2) - lgamma(t), 6) AS hom_alt FROM a""")
def dm_prior(spark: SparkSession, d: str) -> DataFrame:
    a = [1.0 + 10 * (1 - F.col("p")), 0.001 + 10 * F.col("p")]
    out = [stats.dirichlet_multinomial([F.lit(2 - g), F.lit(g)], a, F.log(F.lit(2.0)) if g == 1 else F.lit(0.0)) for g in range(3)]
    return frequencies(spark, d).select(*PLACE, *[F.round(x, 6).alias(n) for x, n in zip(out, ("hom_ref", "het", "hom_alt"), strict=True)])


def em_loci(spark: SparkSession, d: str) -> DataFrame:
    ll = genotyping.likelihoods(two_alleles(spark, d), SITE, most=2)
    rows = ll.groupBy(*SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("genotype", "log_likelihood"))), lambda x: x["log_likelihood"]).alias("lls"))
    return genotyping.call_loci(rows.withColumn("classes", F.array(F.lit("ref"), F.lit("snp"))), PLACE, "sample", "classes")


@query()
def genotype_em(spark: SparkSession, d: str) -> DataFrame:
    called = em_loci(spark, d)
    return called.select(*PLACE, F.round(F.get("frequencies", F.lit(1)), 6).alias("alt_frequency"), "iterations", "converged", F.explode(F.arrays_zip("samples", "genotypes", "gq")).alias("s")).select(*PLACE, "alt_frequency", "iterations", "converged", F.col("s.samples").alias("sample"), F.col("s.genotypes").alias("genotype"), F.round("s.gq", 4).alias("gq"))


@query()
def site_qual_exact_af(spark: SparkSession, d: str) -> DataFrame:
    return em_loci(spark, d).select(*PLACE, F.round("qual", 4).alias("qual"), F.size(F.filter("genotypes", lambda g: g > 0)).alias("carriers"))


@query()
def emission_gates(spark: SparkSession, d: str) -> DataFrame:
    b = B.biallelic(spark, d).select(*PLACE, F.col("sample").cast("string").alias("s"), stats.allele_balance_lr(F.col("alt_num_obs").cast("double"), (F.col("alt_num_obs") + F.col("ref_num_obs")).cast("double"), F.lit(0.5), config.AB_CONCENTRATION).alias("lr"))
    lrs = b.groupBy(*PLACE).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "lr"))), lambda x: x["lr"]).alias("lrs"))
    loci = em_loci(spark, d).join(lrs, PLACE)
    lr = F.zip_with("genotypes", "lrs", lambda g, x: F.when(g == 1, x))
    return genotyping.gate(loci.withColumn("lrs", lr), "genotypes", "qual", "lrs").groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("loci"))


@query(f"""WITH {B.BIALLELIC}, c AS (SELECT chrom_id, pos, sum(ref_num_obs) AS n1, sum(ref_mapq_sum) AS s1, sum(ref_mapq_sum_sq) AS q1, sum(alt_num_obs) AS n2, sum(alt_mapq_sum) AS s2, sum(alt_mapq_sum_sq) AS q2 FROM bi GROUP BY ALL),
 v AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN greatest(0, (q2 - s2 * s2 / n2) / (n2 - 1)) / n2 + greatest(0, (q1 - s1 * s1 / n1) / (n1 - 1)) / n1 END AS se2 FROM c)
 SELECT chrom_id, pos, round(CASE WHEN se2 > 0 THEN (s2 / n2 - s1 / n1) / sqrt(se2) WHEN se2 IS NOT NULL AND abs(s2 / n2 - s1 / n1) < 2e-16 THEN 0 END, 6)::DOUBLE AS t FROM v""")
def welch_mapq(spark: SparkSession, d: str) -> DataFrame:
    sums = B.biallelic(spark, d).groupBy(*PLACE).agg(*[F.sum(f"{s}_{c}").cast("double").alias(f"{s}_{c}") for s in ("alt", "ref") for c in ("num_obs", "mapq_sum", "mapq_sum_sq")])
    t = stats.welch_t(*[F.col(f"{s}_{c}") for s in ("alt", "ref") for c in ("num_obs", "mapq_sum", "mapq_sum_sq")])
    return sums.select(*PLACE, F.round(t, 6).alias("t"))


@query(f"""WITH {B.BIALLELIC}, c AS (SELECT chrom_id, pos, sum(ref_num_obs)::DOUBLE AS nr, sum(ref_fwd)::DOUBLE AS rf, sum(alt_num_obs)::DOUBLE AS na, sum(alt_fwd)::DOUBLE AS af FROM bi GROUP BY ALL),
 z AS (SELECT *, (rf + af) / (nr + na) AS p FROM c), v AS (SELECT *, CASE WHEN nr >= 2 AND na >= 2 THEN p * (1 - p) * (1 / na + 1 / nr) END AS var FROM z)
 SELECT chrom_id, pos, CASE WHEN rf + af >= 2 AND nr + na - rf - af >= 2 AND var > 0 THEN round((af / na - rf / nr) / sqrt(var), 6) END AS z FROM v""")
def strand_bias(spark: SparkSession, d: str) -> DataFrame:
    sums = B.biallelic(spark, d).groupBy(*PLACE).agg(*[F.sum(c).cast("double").alias(c) for c in ("ref_num_obs", "ref_fwd", "alt_num_obs", "alt_fwd")])
    return sums.select(*PLACE, F.round(stats.strand_z(F.col("ref_num_obs"), F.col("ref_fwd"), F.col("alt_num_obs"), F.col("alt_fwd")), 6).alias("z"))


BB = "(lgamma(k + {p} * 150) + lgamma(n - k + (1 - {p}) * 150) - lgamma(n + 150) + lgamma(150) - lgamma({p} * 150) - lgamma((1 - {p}) * 150))"


@query(f"""WITH {B.BIALLELIC}, c AS (SELECT sample, chrom_id, pos, alt_num_obs::DOUBLE AS k, (alt_num_obs + ref_num_obs)::DOUBLE AS n FROM bi), q AS (SELECT *, least(greatest(k / n, 1e-6), 1 - 1e-6) AS f FROM c)
 SELECT sample, chrom_id, pos, round(least(0, {BB.format(p="0.5")} - {BB.format(p="f")}), 5)::DOUBLE AS lr FROM q""")
def allele_balance_lr(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("alt_num_obs") + F.col("ref_num_obs")).cast("double")
    lr = stats.allele_balance_lr(F.col("alt_num_obs").cast("double"), n, F.lit(0.5), config.AB_CONCENTRATION)
    return B.biallelic(spark, d).select(*SITE, F.round(lr, 5).alias("lr"))


TAIL = "-10 * log10(greatest(least(list_sum(list_transform(range(0, {n} + 1), lambda i: CASE WHEN lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}) <= lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}) + 1e-7 THEN exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})) ELSE 0 END)), 1.0), 1e-300))"


@query(f"""WITH {B.BIALLELIC}, c AS (SELECT chrom_id, pos, {', '.join(f"CAST(sum({s}_{c}) AS BIGINT) AS {s[0]}{c[0]}" for s in ("ref", "alt") for c in ("num_obs", "fwd", "placed_left"))} FROM bi GROUP BY ALL),
 s AS (SELECT *, rn + an AS n, CASE WHEN rn > 0 THEN least(greatest(rf / rn, 0.01), 0.99) ELSE 0.5 END AS sf, CASE WHEN rn > 0 THEN least(greatest(rp / rn, 0.01), 0.99) ELSE 0.5 END AS sp, least(greatest((an - 3) / 4, 0), 1) AS ramp FROM c),
 t AS (SELECT *, CASE WHEN an < 0.5 * n THEN {TAIL.format(n="n", k="an", p="0.5")} ELSE 0 END AS balance, greatest({TAIL.format(n="an", k="af", p="sf")}, {TAIL.format(n="an", k="ap", p="sp")}) AS bias FROM s)
 SELECT chrom_id, pos, round(CASE WHEN an < 1 THEN 100 ELSE greatest(0, 100 - balance - bias * ramp) END, 4)::DOUBLE AS qual FROM t""")
def qual_refine_bias(spark: SparkSession, d: str) -> DataFrame:
    sums = B.biallelic(spark, d).groupBy(*PLACE).agg(*[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in ("ref", "alt") for c in ("num_obs", "fwd", "placed_left")])
    n = F.col("ref_num_obs") + F.col("alt_num_obs")
    refined = genotyping.refine_quality(F.lit(100.0), *[F.col(f"{s}_{c}") for s in ("ref", "alt") for c in ("num_obs", "fwd", "placed_left")], n, 0.5 * n)
    return sums.select(*PLACE, F.round(refined, 4).alias("qual"))


@query(f"""WITH {B.SITES}, per AS (SELECT chrom_id, pos, base, CAST(sum(num_obs) AS BIGINT) AS n FROM sites GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chrom_id, pos ORDER BY n DESC, base) AS k FROM per),
 s AS (SELECT chrom_id, pos, count(*) AS alleles, CAST(sum(n) AS BIGINT) AS depth, max(CASE WHEN k = 2 THEN n END) AS minor FROM r GROUP BY ALL) SELECT * FROM s WHERE minor >= 2 AND minor >= 0.005 * depth""")
def contamination_sites(spark: SparkSession, d: str) -> DataFrame:
    return cohort.informative_sites(B.sites(spark, d), PLACE, "base", "num_obs")


@query(f"""WITH {B.SITES}, m AS (SELECT sample, chrom_id, pos, max({{'n': num_obs, 'b': base}}) AS m, CAST(sum(num_obs) AS BIGINT) AS depth FROM sites GROUP BY ALL)
 SELECT sample, chrom_id, pos, m.b AS major, depth FROM m WHERE depth >= 5 AND m.n >= 0.8 * depth""")
def contamination_hom_major(spark: SparkSession, d: str) -> DataFrame:
    return cohort.hom_major(B.sites(spark, d), SITE, "base", "num_obs", 5, 0.8)


@query()
def contamination_em(spark: SparkSession, d: str) -> DataFrame:
    s = B.sites(spark, d)
    major = cohort.hom_major(s, SITE, "base", "num_obs", 5, 0.8)
    met = s.join(major, SITE).groupBy(*SITE, "depth").agg(F.sum(F.when(F.col("base") == F.col("major"), F.col("num_obs")).otherwise(0)).alias("own"), F.exp(F.sum("q_sum") / F.first("depth")).alias("error"))
    rows = met.withColumn("others", F.col("depth") - F.col("own")).withColumn("batch", F.lit(config.DEFAULT_BATCH))
    got = contamination.estimate(rows, PLACE, "sample", "batch", "own", "others", "depth", "error", block=200)
    return got.select("sample", F.round("contamination", 6).alias("contamination"))


DEPTHS = f"{B.READS}, depths AS (SELECT sample, chrom_id, pos, count(*) AS depth, max(CASE WHEN ref IN ('G', 'C') THEN 1 ELSE 0 END) AS gc FROM reads GROUP BY ALL)"


def depths(spark: SparkSession, d: str) -> DataFrame:
    return B.reads(spark, d).groupBy(*SITE).agg(F.count("*").alias("depth"), F.max(F.col("ref").isin("G", "C").cast("int")).alias("gc"))


@query(f"""WITH {DEPTHS}, t AS (SELECT sample, chrom_id, (pos - 1) // 20 AS tile, avg(gc) AS gc, sum(depth) / count(*) AS mean FROM depths GROUP BY ALL)
 SELECT sample, CAST(least(floor(gc * 50), 49) AS INT) AS gc_bin, CAST(least(floor(mean / 0.5), 2000) AS INT) AS depth_bin, count(*) AS tiles FROM t GROUP BY ALL""")
def coverage_gc_hist(spark: SparkSession, d: str) -> DataFrame:
    return pileup.coverage_histogram(depths(spark, d), ["sample"], "chrom_id", "pos", "depth", "gc", 20)


@query(f"""WITH {DEPTHS} SELECT sample, chrom_id, pos, round(avg(depth) OVER w, 8) AS coverage, round(avg(gc) OVER w, 8) AS gc FROM depths WINDOW w AS (PARTITION BY sample, chrom_id ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def sliding_coverage(spark: SparkSession, d: str) -> DataFrame:
    got = pileup.sliding_coverage(depths(spark, d), ["sample", "chrom_id"], "pos", "depth", "gc", 10)
    return got.select(*SITE, F.round("windowed_coverage", 8).alias("coverage"), F.round("windowed_gc", 8).alias("gc"))


@query("""WITH b AS (SELECT event_type, CAST(floor(value) AS INT) AS v, count(*) AS w FROM events GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY event_type) AS total FROM b)
 SELECT event_type, min(v) AS median, CAST(first(total) AS BIGINT) AS weight FROM r WHERE run >= ceil(total / 2) GROUP BY event_type""")
def weighted_median_gc(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select("event_type", F.floor("value").cast("int").alias("v"), F.lit(1).cast("long").alias("w"))
    return pileup.weighted_lower_median(e, ["event_type"], "v", "w")


@query("""WITH b AS (SELECT event_type, CAST(floor(value) AS INT) AS v FROM events), m AS (SELECT event_type, quantile_disc(v, 0.5) AS m FROM b GROUP BY 1), x AS (SELECT b.event_type, abs(v - m) AS dev FROM b JOIN m USING (event_type))
 SELECT event_type, round(1.4826 * quantile_disc(dev, 0.5), 6) AS sigma0 FROM x GROUP BY 1""")
def mad_sigma0(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select("event_type", F.floor("value").cast("int").alias("v"), F.lit(1).cast("long").alias("w"))
    medians = pileup.weighted_lower_median(e, ["event_type"], "v", "w").select("event_type", "median")
    off = e.join(medians, "event_type").select("event_type", F.abs(F.col("v") - F.col("median")).alias("dev"), "w")
    return pileup.weighted_lower_median(off, ["event_type"], "dev", "w").select("event_type", F.round(1.4826 * F.col("median"), 6).alias("sigma0"))


@query()
def coverage_model(spark: SparkSession, d: str) -> DataFrame:
    got = pileup.coverage_models(coverage_gc_hist(spark, d))
    return got.select("sample", F.round("mode", 6).alias("mode"), F.round("sigma0", 6).alias("sigma0"))


CLASSES = f"""{B.BIALLELIC}, l AS (SELECT sample, chrom_id, pos, ref_num_obs::DOUBLE AS r, ref_fwd::DOUBLE AS rf, alt_num_obs::DOUBLE AS a, alt_fwd::DOUBLE AS af, least(greatest(exp((ref_q_sum + alt_q_sum) / (ref_num_obs + alt_num_obs)), 0.02), 0.4) AS e FROM bi WHERE ref_num_obs + alt_num_obs >= 4),
 m AS (SELECT *, a * ln(e) + r * ln(1 - e) AS hr, (a + r) * ln(0.5) AS het, a * ln(1 - e) + r * ln(e) AS ha, (rf + af) / (a + r) AS p FROM l),
 b AS (SELECT *, CASE WHEN r >= 2 AND a >= 2 AND rf + af >= 2 AND a + r - rf - af >= 2 AND p > 0 AND p < 1 THEN abs((af / a - rf / r) / sqrt(p * (1 - p) * (1 / a + 1 / r))) > 3 ELSE FALSE END AS biased FROM m),
 classes AS (SELECT sample, chrom_id, pos, CASE WHEN NOT greatest(ha, het) - hr > ln(10.0) THEN 'hom_ref' WHEN het - ha > ln(10.0) THEN CASE WHEN biased THEN 'ambiguous' ELSE 'het' END WHEN het - ha < -ln(10.0) THEN 'hom_alt' ELSE 'ambiguous' END AS kind FROM b)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    kind = pileup.genotype_class(*[F.col(c).cast("double") for c in ("ref_num_obs", "ref_fwd", "alt_num_obs", "alt_fwd")], F.col("ref_q_sum") + F.col("alt_q_sum"))
    return B.biallelic(spark, d).select(*SITE, kind.alias("kind")).where("kind IS NOT NULL")


@query(f"WITH {CLASSES} SELECT sample, kind, count(*) AS sites FROM classes GROUP BY ALL")
def het_classify(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).groupBy("sample", "kind").agg(F.count("*").alias("sites"))


COUNTS = f"{CLASSES}, counts AS (SELECT sample, CAST(sum(CASE WHEN kind = 'het' THEN 1 ELSE 0 END) AS BIGINT) AS n_het, CAST(sum(CASE WHEN kind = 'hom_alt' THEN 1 ELSE 0 END) AS BIGINT) AS n_hom_alt, count(*) AS n FROM classes GROUP BY ALL)"


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).groupBy("sample").agg(F.count_if(F.col("kind") == "het").alias("n_het"), F.count_if(F.col("kind") == "hom_alt").alias("n_hom_alt"), F.count("*").alias("callable_positions"))


@query(f"WITH {COUNTS} SELECT round(CASE WHEN sum(n_het + 2 * n_hom_alt) < 30 THEN 0.001 ELSE sum(n_het + 2 * n_hom_alt) / (2 * sum(n)) END, 9)::DOUBLE AS theta FROM counts")
def diversity_theta(spark: SparkSession, d: str) -> DataFrame:
    return pileup.diversity(class_counts(spark, d)).select(F.round("theta", 9).alias("theta"))


@query(f"WITH {COUNTS} SELECT sample, CASE WHEN 2 * n_hom_alt + n_het > 0 THEN round(least(greatest((2 * n_hom_alt - n_het) / (2 * n_hom_alt + n_het), 0.0), 0.99), 9)::DOUBLE END AS f FROM counts")
def inbreeding_f(spark: SparkSession, d: str) -> DataFrame:
    return class_counts(spark, d).select("sample", F.round(stats.inbreeding(F.col("n_het"), F.col("n_hom_alt")), 9).alias("f"))


def ratios(spark: SparkSession, d: str) -> DataFrame:
    b = B.biallelic(spark, d)
    n = F.col("alt_num_obs") + F.col("ref_num_obs")
    mean = b.groupBy("sample").agg(F.avg(n).alias("mean"))
    rows = b.join(mean, "sample").select(*SITE, F.col("alt_num_obs").cast("double").alias("alt"), F.col("ref_num_obs").cast("double").alias("ref"), (n / F.col("mean")).alias("copies"), F.lit(0.05).alias("f"), F.lit(0.3).alias("sigma"))
    return paralog.locus_ratios(rows, PLACE)


@query()
def paralog_lr(spark: SparkSession, d: str) -> DataFrame:
    return ratios(spark, d).select(*PLACE, F.round("lr", 5).alias("lr"))


@query()
def paralog_filter(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    lr = ratios(spark, d).persist()
    hist = paralog.histogram(lr, "lr")
    counts = np.zeros(config.LR_HISTOGRAM[2])
    for r in hist.collect():  # at most as many rows as there are bins
        counts[r["bin"]] = r["n"]
    curve = paralog.fdr_curve(hist, paralog.paralog_share(counts))
    cut = paralog.fdr_cut(curve)
    return lr.join(F.broadcast(cut)).select(*PLACE, F.round("lr", 5).alias("lr"), F.coalesce(F.col("lr") >= F.col("threshold"), F.lit(False)).alias("dropped"))


@query("""WITH h AS (SELECT CAST(least(greatest(floor((l_quantity - 25 - l_discount * 100 + 100) * 10), 0), 1999) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
 p AS (SELECT *, 1 / (1 + exp(-(-100 + (bin + 0.5) * 0.1 + ln(0.03) - ln(0.97)))) AS post FROM h)
 SELECT bin, n, round(post, 8) AS posterior, round(sum(n * (1 - post)) OVER w / sum(n) OVER w, 8) AS q FROM p WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)""")
def paralog_fdr_cut(spark: SparkSession, d: str) -> DataFrame:
    lr = B.table(spark, d, "lineitem").select((F.col("l_quantity") - 25 - F.col("l_discount") * 100).alias("lr"))
    curve = paralog.fdr_curve(paralog.histogram(lr, "lr"), config.PARALOG_PRIOR)
    return curve.select("bin", "n", F.round("posterior", 8).alias("posterior"), F.round("q", 8).alias("q"))


@query(f"WITH {B.TRACTS} SELECT locus, sample, seq, count(*) AS reads FROM tracts GROUP BY ALL")
def ssr_tally(spark: SparkSession, d: str) -> DataFrame:
    return ssr.tally(B.tracts(spark, d), ["locus", "sample"], "seq")


RUNGS = f"{B.TRACTS}, t AS (SELECT locus, sample, seq, count(*) AS reads FROM tracts GROUP BY ALL), rungs AS (SELECT locus, sample, CAST(length(seq) // 2 AS INT) AS units, CAST(sum(reads) AS BIGINT) AS reads, count(DISTINCT seq) AS sequences FROM t GROUP BY ALL)"


def ladder(spark: SparkSession, d: str) -> DataFrame:
    return ssr.rungs(ssr_tally(spark, d), ["locus", "sample"], "seq", "reads", F.lit(2))


@query(f"WITH {RUNGS} SELECT * FROM rungs")
def ssr_rungs(spark: SparkSession, d: str) -> DataFrame:
    return ladder(spark, d)


@query(f"""WITH {RUNGS} SELECT r.* FROM rungs r LEFT JOIN rungs a ON r.locus = a.locus AND r.sample = a.sample AND a.units = r.units - 1 LEFT JOIN rungs b ON r.locus = b.locus AND r.sample = b.sample AND b.units = r.units + 1
 WHERE r.reads > coalesce(a.reads, 0) + 3 AND r.reads > coalesce(b.reads, 0) + 3""")
def ssr_clear_peaks(spark: SparkSession, d: str) -> DataFrame:
    return ssr.clear_peaks(ladder(spark, d), ["locus", "sample"])


@query(f"""WITH {RUNGS}, p AS (SELECT r.* FROM rungs r LEFT JOIN rungs a ON r.locus = a.locus AND r.sample = a.sample AND a.units = r.units - 1 LEFT JOIN rungs b ON r.locus = b.locus AND r.sample = b.sample AND b.units = r.units + 1
 WHERE r.reads > coalesce(a.reads, 0) + 1 AND r.reads > coalesce(b.reads, 0) + 1) SELECT locus, units, count(DISTINCT sample) AS samples FROM p GROUP BY ALL HAVING count(DISTINCT sample) >= 2""")
def ssr_recurrence(spark: SparkSession, d: str) -> DataFrame:
    return ssr.recurrent(ssr.clear_peaks(ladder(spark, d), ["locus", "sample"], prominence=1), ["locus"], "sample")


@query(f"""WITH {B.TRACTS}, p AS (SELECT locus, seq, count(*) AS reads, count(DISTINCT sample) AS samples FROM tracts GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY locus, length(seq) ORDER BY reads DESC, seq) AS n, sum(reads) OVER (PARTITION BY locus, length(seq)) AS total FROM p),
 k AS (SELECT *, CASE WHEN n = 1 THEN 'representative' WHEN reads >= 8 AND samples >= 3 AND reads >= 0.1 * total THEN 'sibling' END AS role FROM r) SELECT locus, seq, reads, samples, role FROM k WHERE role IS NOT NULL""")
def ssr_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ssr.candidates(ssr_tally(spark, d), ["locus"], "seq", "reads", "sample")


@query(f"""WITH {RUNGS}, u AS (SELECT locus, units, sum(reads) AS n FROM rungs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY n DESC, units) AS k FROM u) SELECT locus, units AS modal FROM r WHERE k = 1""")
def ssr_modal_length(spark: SparkSession, d: str) -> DataFrame:
    return ssr.modal_units(ladder(spark, d), ["locus"]).select("locus", F.col("modal").cast("int").alias("modal"))


@query(f"""WITH {RUNGS}, s AS (SELECT sample, sum(reads)::DOUBLE AS w, sum(reads * units)::DOUBLE AS wx, sum(reads * sequences)::DOUBLE AS wy, sum(reads * units * units)::DOUBLE AS wxx, sum(reads * units * sequences)::DOUBLE AS wxy FROM rungs GROUP BY ALL),
 l AS (SELECT *, CASE WHEN w * wxx - wx * wx > 0 THEN (w * wxy - wx * wy) / (w * wxx - wx * wx) END AS slope FROM s) SELECT sample, round(slope, 8) AS slope, round((wy - slope * wx) / w, 8) AS intercept FROM l""")
def stutter_wls_fit(spark: SparkSession, d: str) -> DataFrame:
    got = ssr.weighted_line(ladder(spark, d), ["sample"], "units", "sequences", "reads")
    return got.select("sample", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"))


@query()
def ssr_genotypes(spark: SparkSession, d: str) -> DataFrame:
    return ssr.call(ladder(spark, d), ["locus"], "sample")


@query(f"""WITH {B.TRACTS}, c AS (SELECT DISTINCT user_id % 150 AS locus FROM events), k AS (SELECT locus, count(*) AS n FROM tracts WHERE locus % 7 <> 0 GROUP BY ALL), f AS (SELECT locus, CASE WHEN n >= 20 THEN 'emitted' ELSE 'filtered' END AS reason FROM k)
 SELECT c.locus, coalesce(reason, 'no_evidence') AS fate FROM c LEFT JOIN f USING (locus)""")
def fate_report(spark: SparkSession, d: str) -> DataFrame:
    catalog = B.table(spark, d, "events").selectExpr("user_id % 150 AS locus").distinct()
    calls = B.tracts(spark, d).where("locus % 7 <> 0").groupBy("locus").agg(F.when(F.count("*") >= 20, "emitted").otherwise("filtered").alias("reason"))
    return ssr.fate(catalog, calls, ["locus"], "reason").select("locus", "fate")


@query(f"WITH {B.SEQS}, c AS (SELECT doc_id, seq AS s FROM seqs WHERE length(seq) > 0) SELECT doc_id, round(list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN s[i] = substr('CA', CAST(1 + (i - 1) % 2 AS INT), 1) THEN 1 ELSE 0 END)) / length(s), 8) AS purity FROM c")
def motif_purity(spark: SparkSession, d: str) -> DataFrame:
    s = B.seqs(spark, d).where(F.length("seq") > 0).select("doc_id", F.col("seq").alias("s"))
    return s.select("doc_id", F.round(sequence.purity(F.col("s"), F.lit("CA")), 8).alias("purity"))


@query(f"WITH {B.SEQS} SELECT doc_id, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 8) AS gc, CAST((length(seq) - length(replace(seq, 'CA', ''))) // 2 AS INT) AS motifs FROM seqs WHERE length(seq) > 0")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return B.seqs(spark, d).where(F.length("seq") > 0).select("doc_id", F.round(sequence.gc_fraction(F.col("seq")), 8).alias("gc"), sequence.motif_count(F.col("seq"), F.lit("CA")).alias("motifs"))


@query(f"""WITH {B.SEQS}, x AS (SELECT doc_id, seq, unnest(range(0, (length(seq) + 63) // 64)) AS win FROM seqs), w AS (SELECT doc_id, win, substr(seq, CAST(64 * win + 1 AS INT), 64) AS s FROM x WHERE length(seq) - 64 * win >= 4), t AS (SELECT doc_id, win, length(s) - 2 AS n, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, CAST(i AS INT), 3))) AS t FROM w),
 c AS (SELECT doc_id, win, n, t, count(*) AS c FROM t GROUP BY ALL) SELECT doc_id, CAST(win AS INT) AS win, round(10.0 * sum(c * (c - 1) / 2) / (n - 1), 6)::DOUBLE AS score FROM c GROUP BY doc_id, win, n""")
def triplet_dust_score(spark: SparkSession, d: str) -> DataFrame:
    s = B.seqs(spark, d).select("doc_id", F.posexplode(sequence.dust_windows(F.col("seq"), 64)).alias("win", "s")).where(F.length("s") >= 4)
    return s.select("doc_id", "win", F.round(sequence.dust_score(F.col("s")), 6).alias("score"))


@query()
def sdust_mask(spark: SparkSession, d: str) -> DataFrame:
    tiles = scan.tile(B.seqs(spark, d), "doc_id", "seq", 4096, config.DUST_WINDOW)
    spans = scan.scan(tiles, "doc_id", "bases", "dust", "offset")
    return intervals.union(spans.withColumn("end", F.col("end") - 1), ["doc_id"], "start", "end", 1).select("doc_id", "start", "end")


@query()
def tandem_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(B.seqs(spark, d), "doc_id", "seq", "tandem")


@query()
def typed_regions(spark: SparkSession, d: str) -> DataFrame:
    return scan.typed_regions(B.seqs(spark, d), "doc_id", "seq")


@query(f"""WITH {B.READS}, r AS (SELECT sample, chrom_id, pos, read_id, row_number() OVER (PARTITION BY sample, chrom_id, pos ORDER BY md5('1|' || sample || '|' || chrom_id || '|' || pos || '|' || read_id), read_id) AS n FROM reads) SELECT sample, chrom_id, pos, read_id FROM r WHERE n <= 3""")
def reservoir_topk_hash(spark: SparkSession, d: str) -> DataFrame:
    return R.reservoir(B.reads(spark, d), SITE, ["read_id"], 3).select(*SITE, "read_id")


@query(f"""WITH {B.SITES}, a AS (SELECT *, CASE WHEN base = ref THEN 0 ELSE 1 END AS k FROM sites), g AS (SELECT sample, chrom_id, pos, first(ref) AS ref, CAST(sum(num_obs) AS INT) AS depth,
 string_agg(CASE WHEN base = ref THEN repeat('.', CAST(fwd AS INT)) || repeat(',', CAST(num_obs - fwd AS INT)) ELSE repeat(base, CAST(fwd AS INT)) || repeat(lower(base), CAST(num_obs - fwd AS INT)) END, '' ORDER BY k, base) AS bases,
 string_agg(base || ':' || num_obs || ':' || fwd || ':' || placed_left || ':' || placed_start || ':' || printf('%.3f', q_sum), ',' ORDER BY k, base) AS detail, min(k) AS has_ref FROM a GROUP BY sample, chrom_id, pos)
 SELECT sample, chrom_id, pos, chrom_id || chr(9) || pos || chr(9) || ref || chr(9) || depth || chr(9) || bases || chr(9) || repeat('!', depth) || chr(9) || detail AS line FROM g WHERE has_ref = 0""")
def psp_text_dump(spark: SparkSession, d: str) -> DataFrame:
    s = B.sites(spark, d).withColumn("allele_idx", F.when(F.col("base") == F.col("ref"), 0).otherwise(F.ascii("base"))).withColumnRenamed("base", "seq")
    with_ref = s.join(s.where("allele_idx = 0").select(*SITE), SITE, "left_semi")
    return files.pileup_line(with_ref, SITE, "chrom_id", "pos")


VCF_DEPTH = "AC={ac};AN={an};DP={dp}"


@query(f"""WITH {LIKELIHOODS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom_id, pos ORDER BY log_likelihood DESC, genotype) AS n FROM ll), g AS (SELECT r.sample, r.chrom_id, r.pos, r.genotype, b.ref_num_obs AS rn, b.alt_num_obs AS an FROM r JOIN bi b USING (sample, chrom_id, pos) WHERE n = 1),
 l AS (SELECT chrom_id, pos, CAST(sum(genotype) AS BIGINT) AS ac, 2 * count(*) AS tot, CAST(sum(rn + an) AS BIGINT) AS dp, string_agg((['0/0','0/1','1/1'])[genotype + 1] || ':.:' || (rn + an) || ':' || rn || ',' || an, chr(9) ORDER BY sample) AS cells FROM g GROUP BY ALL)
 SELECT chrom_id, pos, 'chr' || chrom_id || chr(9) || pos || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<ALT>' || chr(9) || '0.00' || chr(9) || 'PASS' || chr(9) || 'AC=' || ac || ';AN=' || tot || ';DP=' || dp || chr(9) || 'GT:GQ:DP:AD' || chr(9) || cells AS line FROM l WHERE ac > 0""")
def vcf_lines(spark: SparkSession, d: str) -> DataFrame:
    ll = genotyping.likelihoods(two_alleles(spark, d), SITE, most=2)
    best = genotyping.best_genotypes(ll, SITE, "genotype", "log_likelihood").join(B.biallelic(spark, d).select(*SITE, "ref_num_obs", "alt_num_obs"), SITE)
    depth = F.col("ref_num_obs") + F.col("alt_num_obs")
    cell = F.concat(genotyping.genotype_text(F.col("genotype"), 2, 2), F.lit(":.:"), depth.cast("string"), F.lit(":"), F.col("ref_num_obs").cast("string"), F.lit(","), F.col("alt_num_obs").cast("string"))
    loci = best.groupBy(*PLACE).agg(F.sum("genotype").alias("ac"), (2 * F.count("*")).alias("an"), F.sum(depth).alias("dp"), F.transform(F.array_sort(F.collect_list(F.struct("sample", cell.alias("c")))), lambda x: x["c"]).alias("cells")).where("ac > 0")
    info = F.concat(F.lit("AC="), F.col("ac").cast("string"), F.lit(";AN="), F.col("an").cast("string"), F.lit(";DP="), F.col("dp").cast("string"))
    line = files.vcf_line(F.concat(F.lit("chr"), F.col("chrom_id").cast("string")), F.col("pos"), F.lit("N"), F.lit("<ALT>"), F.lit(0.0), F.lit(True), info, F.col("cells"))
    return loci.select(*PLACE, line.alias("line"))


@query("""WITH a AS (SELECT doc_id, length(text) AS n, md5(text) AS m FROM documents), b AS (SELECT doc_id, length(text) AS n, md5(CASE WHEN doc_id % 10 = 3 THEN text || 'x' ELSE text END) AS m FROM documents WHERE doc_id % 10 <> 7)
 SELECT a.doc_id, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n <> b.n THEN 'length' ELSE 'md5' END AS difference FROM a LEFT JOIN b USING (doc_id) WHERE b.n IS NULL OR a.n <> b.n OR a.m <> b.m""")
def md5_contig_agreement(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents")
    left = docs.select(F.col("doc_id").alias("contig"), F.length("text").alias("length"), F.md5("text").alias("md5"))
    right = docs.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("contig"), F.length("text").alias("length"), F.md5(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("md5"))
    return files.contig_differences(left, right).withColumnRenamed("contig", "doc_id")


@query("SELECT s.s_suppkey AS sample, coalesce(n.n_name, 'all_samples') AS batch FROM supplier s LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) n ON s.s_nationkey = n.n_nationkey")
def batch_assignment_left_join(spark: SparkSession, d: str) -> DataFrame:
    samples = B.table(spark, d, "supplier").selectExpr("s_suppkey AS sample", "s_nationkey")
    few = B.table(spark, d, "nation").where("n_regionkey < 3").selectExpr("n_nationkey AS s_nationkey", "n_name AS batch")
    batches = samples.join(F.broadcast(few), "s_nationkey").select("sample", "batch")
    return contamination.assign_batches(samples.select("sample"), batches, "sample", "batch")
