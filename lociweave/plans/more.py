"""More queries over the test tables: regions, compounds, read models and the records of the microsatellite commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import encoding, sequence, stats
from lociweave.operators import cohort, genotyping, intervals, pileup, ssr
from lociweave.operators import reads as R
from lociweave.plans import bindings as B
from lociweave.plans.queries import DEPTHS, ISLANDS, LIKELIHOODS, PLACE, SITE, depths, query, two_alleles


@query(f"WITH {B.SITES} SELECT chrom_id, pos, max(n) > 1 AS has_variant FROM (SELECT chrom_id, pos, sample, count(*) AS n FROM sites GROUP BY ALL) GROUP BY ALL")
def variant_positions(spark: SparkSession, d: str) -> DataFrame:
    return cohort.variant_positions(B.sites(spark, d), PLACE, "sample")


@query(f"""WITH {B.READS}, c AS (SELECT chain_id, count(*) FILTER (bq >= 16) AS compared, count(*) FILTER (bq >= 16 AND base <> ref) AS mismatches FROM reads GROUP BY ALL) SELECT *, mismatches > 0.1 * compared AS dropped FROM c""")
def mismatch_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.mismatching(B.reads(spark, d), ["chain_id"], "base", "ref", "bq", 16)


REGIONS = "regions AS (SELECT DISTINCT contig, unnest([{'lo': 500, 'hi': 900}, {'lo': 1500, 'hi': 1700}], recursive := true) FROM spans WHERE contig % 3 <> 0)"


def regions(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for a, b in ((500, 900), (1500, 1700))])
    return B.spans(spark, d).where("contig % 3 <> 0").select("contig").distinct().select("contig", F.explode(both).alias("r")).select("contig", "r.*")


@query(f'WITH {B.SPANS}, {REGIONS} SELECT s.contig, greatest(start, lo) AS start, least("end", hi) AS "end", span_id FROM spans s JOIN regions r ON s.contig = r.contig AND start <= hi AND "end" >= lo')
def region_restrict(spark: SparkSession, d: str) -> DataFrame:
    s = B.spans(spark, d).select("contig", "start", "end", "span_id")
    return intervals.restrict(s, regions(spark, d), ["contig"], ("start", "end"), ("lo", "hi"), 256)


@query(f"WITH {B.SPANS}, {REGIONS} SELECT s.contig, start, span_id FROM spans s SEMI JOIN regions r ON s.contig = r.contig AND start BETWEEN lo AND hi")
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    return intervals.inside(B.spans(spark, d).select("contig", "start", "span_id"), regions(spark, d), ["contig"], "start", ("lo", "hi"), 256)


@query(f'WITH {B.SPANS}, p AS (SELECT contig, unnest(range(start, "end" + 1)) AS pos FROM spans) SELECT contig, pos, count(*) AS depth FROM p GROUP BY ALL')
def depth_along_contigs(spark: SparkSession, d: str) -> DataFrame:
    runs = intervals.depth(B.spans(spark, d), ["contig"], "start", "end")
    return runs.select("contig", F.explode(F.sequence("start", "end")).alias("pos"), "depth")


@query("WITH " + ISLANDS.replace("FROM spans", "FROM spans WHERE start <= 1200", 1).format(gap=0) + """, g AS (SELECT contig, island, min(start) AS a, max("end") AS b FROM i GROUP BY contig, island), l AS (SELECT contig, arg_max(a, island) AS a, arg_max(b, island) AS b FROM g GROUP BY contig)
 SELECT contig, CASE WHEN b > 1200 THEN a ELSE 1201 END AS cut FROM l""")
def safe_cuts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.safe_cut(B.spans(spark, d), ["contig"], "start", "end", 1200)


OBSERVED = "o AS (SELECT DISTINCT sample, chain_id, chrom_id * 10000 + pos AS place, base FROM reads WHERE base <> ref), k AS (SELECT sample, chain_id, string_agg(place || ':' || base, '|' ORDER BY place, base) AS constituents, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 2)"


def support(spark: SparkSession, d: str) -> DataFrame:
    seen = B.reads(spark, d).where("base <> ref").withColumn("place", F.col("chrom_id") * 10000 + F.col("pos"))
    sites = B.sites(spark, d).withColumn("place", F.col("chrom_id") * 10000 + F.col("pos"))
    return cohort.compound_support(seen, sites, "sample", "chain_id", "place", "base")


@query(f"""WITH {B.SITES}, {OBSERVED}, i AS (SELECT sample, constituents, count(*) AS inter, any_value(chain_id) AS chain_id FROM k GROUP BY ALL), p AS (SELECT i.*, place, base FROM i JOIN o USING (sample, chain_id)),
 m AS (SELECT p.sample, constituents, inter, s.* EXCLUDE (sample, chrom_id, pos, ref, base) FROM p JOIN sites s ON s.sample = p.sample AND s.chrom_id * 10000 + s.pos = place AND s.base = p.base)
 SELECT constituents, sample, any_value(inter) AS num_obs, round(any_value(inter) * min(q_sum / num_obs), 6) AS q_sum, {', '.join(f"CAST(round(sum({c}) * any_value(inter) / sum(num_obs)) AS BIGINT) AS {c}" for c in cohort.SUPPORT)} FROM m GROUP BY constituents, sample""")
def compound_support(spark: SparkSession, d: str) -> DataFrame:
    return support(spark, d).withColumn("q_sum", F.round("q_sum", 6))


@query(f"WITH {B.READS}, {OBSERVED}, c AS (SELECT DISTINCT constituents FROM k), s AS (SELECT DISTINCT sample FROM reads) SELECT constituents, sample FROM c, s EXCEPT SELECT constituents, sample FROM k")
def compound_broken_chains(spark: SparkSession, d: str) -> DataFrame:
    samples = B.reads(spark, d).agg(F.collect_set("sample").alias("samples"))
    return cohort.broken_chains(support(spark, d), samples, "sample")


@query(f"""WITH {B.SITES}, a AS (SELECT chrom_id, pos, count(DISTINCT base) AS n FROM sites GROUP BY ALL) SELECT CASE WHEN n = 1 THEN 'monomorphic' WHEN n > 3 THEN 'too_many' ELSE 'scored' END AS outcome, n AS n_alleles, count(*) AS loci FROM a GROUP BY ALL""")
def allele_count_outcomes(spark: SparkSession, d: str) -> DataFrame:
    counts = B.sites(spark, d).groupBy(*PLACE).agg(F.count_distinct("base").alias("n_alleles"))
    outcome = F.when(F.col("n_alleles") == 1, "monomorphic").when(F.col("n_alleles") > 3, "too_many").otherwise("scored")
    return counts.groupBy(outcome.alias("outcome"), "n_alleles").agg(F.count("*").alias("loci"))


@query(f"""WITH {DEPTHS}, w AS (SELECT sample, chrom_id, pos, avg(depth) OVER w AS coverage, avg(gc) OVER w AS gc FROM depths WINDOW w AS (PARTITION BY sample, chrom_id ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
 anchors AS (SELECT DISTINCT chrom_id, pos FROM reads WHERE pos % 5 = 0), s AS (SELECT DISTINCT sample FROM reads)
 SELECT s.sample, a.chrom_id, a.pos, round(coverage, 8) AS coverage, round(w.gc, 8) AS gc FROM anchors a CROSS JOIN s LEFT JOIN w ON w.sample = s.sample AND w.chrom_id = a.chrom_id AND w.pos = a.pos""")
def window_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's windowed coverage and GC at the loci's anchors; null where it has none."""
    windows = pileup.sliding_coverage(depths(spark, d), ["sample", "chrom_id"], "pos", "depth", "gc", 10)
    samples = B.reads(spark, d).agg(F.collect_set("sample").alias("samples"))
    anchors = B.reads(spark, d).where("pos % 5 = 0").select(*PLACE).distinct().withColumn("all", samples.scalar()).select(*PLACE, F.explode("all").alias("sample"))
    return anchors.join(windows, SITE, "left").select(*SITE, F.round("windowed_coverage", 8).alias("coverage"), F.round("windowed_gc", 8).alias("gc"))


@query(f"""WITH {B.SITES}, {DEPTHS[len(B.READS) + 2:]}, w AS (SELECT sample, chrom_id, pos, avg(depth) OVER w AS coverage FROM depths WINDOW w AS (PARTITION BY sample, chrom_id ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING))
 SELECT sample, chrom_id, pos, base, num_obs, round(coverage, 8) AS coverage FROM sites JOIN w USING (sample, chrom_id, pos)""")
def sites_with_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = pileup.sliding_coverage(depths(spark, d), ["sample", "chrom_id"], "pos", "depth", "gc", 10)
    return B.sites(spark, d).join(windows.select(*SITE, F.round("windowed_coverage", 8).alias("coverage")), SITE).select(*SITE, "base", "num_obs", "coverage")


@query(f"""WITH {B.READS}, p AS (SELECT DISTINCT sample, chrom_id, pos FROM reads), b AS (SELECT *, CAST((row_number() OVER (PARTITION BY sample, chrom_id ORDER BY pos) - 1) // 64 AS INT) AS block FROM p)
 SELECT *, pos - lag(pos, 1, pos) OVER (PARTITION BY sample, chrom_id, block ORDER BY pos) AS step FROM b""")
def position_steps(spark: SparkSession, d: str) -> DataFrame:
    return R.position_steps(B.reads(spark, d).select(*SITE).distinct(), ["sample", "chrom_id"], "pos", 64)


def _mixture(copies: tuple[int, int]) -> str:
    parts = []
    for side, k, f in (("ref", copies[0], 0.9), ("alt", copies[1], 0.1)):
        e = f"least(greatest(exp({side}_q_sum / greatest({side}_num_obs, 1)), 1e-12), 0.5)"
        parts.append(f"CASE WHEN {side}_num_obs = 0 THEN 0 ELSE {side}_num_obs * ln(0.97 * ({k / 2} * (1 - {e}) + {(2 - k) / 2} * {e}) + 0.03 * {f}) END")
    return " + ".join(parts)


@query(f"""WITH {B.BIALLELIC} SELECT sample, chrom_id, pos, round({_mixture((2, 0))}, 6)::DOUBLE AS hom_ref, round({_mixture((1, 1))}, 6)::DOUBLE AS het, round({_mixture((0, 2))}, 6)::DOUBLE AS hom_alt FROM bi""")
def contamination_mixture(spark: SparkSession, d: str) -> DataFrame:
    n, q = ([F.col(f"{s}_{c}") for s in ("ref", "alt")] for c in ("num_obs", "q_sum"))
    out = {name: stats.contamination_mixture(n, q, copies, F.lit(0.03), [F.lit(0.9), F.lit(0.1)]) for name, copies in (("hom_ref", [2, 0]), ("het", [1, 1]), ("hom_alt", [0, 2]))}
    return B.biallelic(spark, d).select(*SITE, *[F.round(x, 6).alias(name) for name, x in out.items()])


CURVE = [0.7, 0.9, 1.0, 1.1, 0.8]


@query(f"""WITH {DEPTHS}, t AS (SELECT sample, chrom_id, (pos - 1) // 20 AS tile, avg(gc) AS gc, avg(depth) AS depth FROM depths GROUP BY ALL), x AS (SELECT *, gc * 5 - 0.5 AS x, {CURVE} AS c FROM t)
 SELECT sample, chrom_id, tile, round(depth / (4.0 * CASE WHEN x <= 0 THEN c[1] WHEN x >= 4 THEN c[5] ELSE c[CAST(floor(x) AS INT) + 1] * (1 - (x - floor(x))) + c[CAST(floor(x) AS INT) + 2] * (x - floor(x)) END), 8)::DOUBLE AS copies FROM x""")
def relative_copies(spark: SparkSession, d: str) -> DataFrame:
    tiles = depths(spark, d).groupBy("sample", "chrom_id", F.floor((F.col("pos") - 1) / 20).alias("tile")).agg(F.avg("gc").alias("gc"), F.avg("depth").alias("depth"))
    copies = stats.relative_copies(F.col("depth"), F.col("gc"), F.lit(4.0), F.array(*[F.lit(x) for x in CURVE]))
    return tiles.select("sample", "chrom_id", "tile", F.round(copies, 8).alias("copies"))


CALLS = f"""{LIKELIHOODS}, e AS (SELECT *, exp(log_likelihood - max(log_likelihood) OVER l) AS w FROM ll WINDOW l AS (PARTITION BY sample, chrom_id, pos)), f AS (SELECT *, w / sum(w) OVER l AS p, row_number() OVER (l ORDER BY log_likelihood DESC, genotype) AS r FROM e WINDOW l AS (PARTITION BY sample, chrom_id, pos)),
 calls AS (SELECT sample, chrom_id, pos, max(CASE WHEN r = 1 THEN genotype END) AS genotype, max(CASE WHEN r = 1 THEN p END) AS posterior, sum(CASE WHEN genotype <> 1 THEN p ELSE 0 END) AS hom FROM f GROUP BY ALL)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(site, genotype, posterior, hom) under a flat prior, with the reads of either allele."""
    ll = genotyping.likelihoods(two_alleles(spark, d), SITE, most=2)
    lls = ll.groupBy(*SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("genotype", "log_likelihood"))), lambda x: x["log_likelihood"]).alias("lls"))
    post = lls.withColumn("genotype", stats.argmax(F.col("lls"))).withColumn("p", stats.softmax(F.col("lls")))
    out = post.select(*SITE, "genotype", F.get("p", F.col("genotype")).alias("posterior"), (F.get("p", F.lit(0)) + F.get("p", F.lit(2))).alias("hom"))
    return out.join(B.biallelic(spark, d).select(*SITE, "ref_num_obs", "alt_num_obs"), SITE)


@query(f"""WITH {CALLS}, x AS (SELECT c.*, ref_num_obs AS r, alt_num_obs AS a FROM calls c JOIN bi USING (sample, chrom_id, pos)), y AS (SELECT chrom_id, pos, unnest(CASE WHEN genotype = 0 THEN [0] WHEN genotype = 2 THEN [1] WHEN r + a <= 0 OR least(r, a) >= 0.4 * (r + a) THEN [0, 1] ELSE [] END) AS allele FROM x)
 SELECT chrom_id, pos, allele, count(*) AS carriers FROM y GROUP BY ALL""")
def carrier_corroboration(spark: SparkSession, d: str) -> DataFrame:
    named = calls(spark, d).withColumn("first", F.when(F.col("genotype") == 2, 1).otherwise(0)).withColumn("second", F.when(F.col("genotype") == 0, 0).otherwise(1))
    return ssr.corroboration(named, PLACE, "first", "second", "ref_num_obs", "alt_num_obs")


@query(f"""WITH {CALLS}, m AS (SELECT chrom_id, pos, CASE WHEN genotype = 0 THEN hom ELSE 1 - posterior END AS p FROM calls) SELECT chrom_id, pos, round(greatest(least(-10 * sum(log10(greatest(least(p, 1.0), 1e-6))), 200.0), 0.0), 4)::DOUBLE AS qual FROM m GROUP BY ALL""")
def monomorphic_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d).withColumn("modal", F.col("genotype") == 0)
    return ssr.site_quality(rows, PLACE, "modal", "hom", "posterior").withColumn("qual", F.round("qual", 4))


@query(f"""WITH {CALLS}, p AS (SELECT chrom_id, pos, sum(genotype) / (2.0 * count(*)) AS p FROM calls GROUP BY ALL), x AS (SELECT c.sample, (hom - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) AS f FROM calls c JOIN p USING (chrom_id, pos) WHERE p * p + (1 - p) * (1 - p) < 1 - 1e-9),
 s AS (SELECT sample, avg(f) AS raw, count(*) AS n FROM x GROUP BY ALL) SELECT sample, round(greatest(least((n * raw + 5 * avg(raw) OVER ()) / (n + 5), {config.MAX_INBREEDING}), 0), 8)::DOUBLE AS f FROM s""")
def shrunk_inbreeding(spark: SparkSession, d: str) -> DataFrame:
    own = calls(spark, d)
    p = F.sum("genotype") / (2.0 * F.count("*"))
    expected = own.groupBy(*PLACE).agg((p * p + (1 - p) * (1 - p)).alias("expected"))
    return ssr.shrunk_inbreeding(own.join(expected, PLACE), "sample", "hom", "expected").withColumn("f", F.round("f", 8))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 0 ORDER BY o_orderdate, o_orderkey LIMIT 20000")
def burn_in_loci(spark: SparkSession, d: str) -> DataFrame:
    return ssr.burn_in(B.table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "o_orderdate")


FLOORS = "30,24,16,12,9,8"


@query("""WITH s AS (SELECT 1 + l_linenumber % 7 AS period, CAST(l_quantity AS INT) AS copies, 1 - 3 * l_discount AS purity FROM lineitem)
 SELECT CASE WHEN period > 6 THEN 'period' WHEN copies < [30, 24, 16, 12, 9, 8][period] THEN 'copies' WHEN purity < 0.8 THEN 'purity' ELSE 'accepted' END AS reason, count(*) AS segments, CAST(sum(period * copies) AS BIGINT) AS bases FROM s GROUP BY ALL""")
def segment_rejections(spark: SparkSession, d: str) -> DataFrame:
    s = B.table(spark, d, "lineitem").selectExpr("1 + l_linenumber % 7 AS period", "CAST(l_quantity AS INT) AS copies", "1 - 3 * l_discount AS purity")
    reason = ssr.segment_reason(F.col("period"), F.col("copies"), F.col("purity"), encoding.parse_floors(FLOORS), encoding.parse_share("0.8"))
    return ssr.rejected_bases(s, reason, (F.col("period") * F.col("copies")).cast("long"))


@query("""WITH r AS (SELECT event_id, CAST(3 + event_id % 11 AS INT) AS units, CASE WHEN event_id % 13 = 0 THEN [] ELSE [4, 6, 11] END AS p FROM events), m AS (SELECT *, list_min(list_transform(p, lambda x: abs(x - units))) AS off FROM r),
 w AS (SELECT *, list_position(list_transform(p, lambda x: abs(x - units)), off) AS k FROM m) SELECT event_id, CASE WHEN len(p) > 0 THEN CAST(k - 1 AS INT) END AS place, CASE WHEN len(p) > 0 THEN units - p[k] END AS slip FROM w""")
def nearest_parent(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").selectExpr("event_id", "CAST(3 + event_id % 11 AS INT) AS units", "CASE WHEN event_id % 13 = 0 THEN CAST(array() AS array<int>) ELSE array(4, 6, 11) END AS p")
    return e.withColumn("n", ssr.nearest_parent(F.col("units"), F.col("p"))).select("event_id", "n.place", "n.slip")


@query("""WITH r AS (SELECT event_id, event_id % 61 - 30 AS x, 1 + user_id % 6 AS t FROM events), s AS (SELECT *, CAST(trunc(x / t) AS BIGINT) AS u FROM r), k AS (SELECT *, x % t = 0 AS whole, CASE WHEN x % t = 0 THEN u ELSE x - u END AS steps FROM s)
 SELECT event_id, round(CASE WHEN whole AND u = 0 THEN 0.9 WHEN abs(steps) > 10 THEN 0 WHEN whole THEN CASE WHEN steps < 0 THEN 0.05 ELSE 0.03 END * 0.8 * pow(0.2, abs(steps) - 1) ELSE CASE WHEN steps < 0 THEN 0.01 ELSE 0.01 END * 0.6 * pow(0.4, abs(steps) - 1) END, 12)::DOUBLE AS p FROM k""")
def stutter_probability(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").selectExpr("event_id", "event_id % 61 - 30 AS x", "1 + user_id % 6 AS t")
    return e.select("event_id", F.round(stats.stutter_probability(F.col("x"), F.col("t"), 0.9, (0.03, 0.05, 0.8), (0.01, 0.01, 0.6)), 12).alias("p"))


@query("""WITH r AS (SELECT event_id, CAST(event_id % 42 AS INT) AS q, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS same FROM events)
 SELECT event_id, round(CASE WHEN same THEN ln(greatest(1 - pow(10.0, -q / 10), 2.2250738585072014e-308)) WHEN NOT same THEN ln(pow(10.0, -q / 10) / 3) ELSE ln(0.25) END, 9)::DOUBLE AS score FROM r""")
def emission_scores(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").selectExpr("event_id", "CAST(event_id % 42 AS INT) AS q", "CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS same")
    return e.select("event_id", F.round(stats.emission_log(F.col("same"), F.col("q")), 9).alias("score"))


@query(f"""WITH {B.SEQS}, c AS (SELECT doc_id, length(seq) AS n, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS b FROM seqs WHERE length(seq) >= 3), k AS (SELECT doc_id, i % 3 AS phase, b, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, phase, sum(n) - max(n) AS off FROM k GROUP BY ALL)
 SELECT s.doc_id, CAST(coalesce(sum(off), 0) AS INT) AS interruptions FROM seqs s LEFT JOIN t USING (doc_id) GROUP BY s.doc_id""")
def repeat_interruptions(spark: SparkSession, d: str) -> DataFrame:
    return B.seqs(spark, d).select("doc_id", F.coalesce(sequence.interruptions(F.col("seq"), F.lit(3)), F.lit(0)).alias("interruptions"))


TRIMMED = "t AS (SELECT event_id, ['', 'C', 'AT', 'GGG', 'CAT'][1 + event_id % 5] || repeat('CA', CAST(event_id % 4 AS INT)) || ['', 'A', 'TC', 'GTGTGTG'][1 + event_id % 4] || repeat('CA', CAST(event_id % 3 AS INT)) || ['', 'T'][1 + event_id % 2] AS s FROM events)"


@query(f"""WITH {TRIMMED}, x AS (SELECT event_id, s, length(s) AS n, CAST(least(6, length(s) // 2) AS INT) AS most FROM t), y AS (SELECT event_id, list_filter(range(0, most + 1), lambda i: i + 4 < n AND substr(s, CAST(i + 1 AS INT), 4) = 'CACA')[1] AS a, list_filter(range(n, n - most - 1, -1), lambda i: i >= 4 AND substr(s, CAST(i - 3 AS INT), 4) = 'CACA')[1] AS b FROM x)
 SELECT event_id, CASE WHEN a < b THEN CAST(a AS INT) END AS start, CASE WHEN a < b THEN CAST(b AS INT) END AS "end" FROM y""")
def whole_motifs(spark: SparkSession, d: str) -> DataFrame:
    pick = "element_at(array({}), CAST(1 + event_id % {} AS INT))"
    s = " || ".join([pick.format("'', 'C', 'AT', 'GGG', 'CAT'", 5), "repeat('CA', CAST(event_id % 4 AS INT))", pick.format("'', 'A', 'TC', 'GTGTGTG'", 4), "repeat('CA', CAST(event_id % 3 AS INT))", pick.format("'', 'T'", 2)])
    return B.table(spark, d, "events").selectExpr("event_id", f"{s} AS s").withColumn("w", sequence.whole_motifs(F.col("s"), F.lit("CA"))).select("event_id", "w.start", "w.end")


@query(f"WITH {B.SEQS} SELECT doc_id, md5(substr(seq, 1, CAST(doc_id % 5 AS INT)) || 'TT' || substr(seq, CAST(doc_id % 5 + doc_id % 3 + 1 AS INT))) AS md5 FROM seqs WHERE length(seq) >= 8")
def projected_alleles(spark: SparkSession, d: str) -> DataFrame:
    offset, span = ((F.col("doc_id") % n).cast("int") for n in (5, 3))
    return B.seqs(spark, d).where(F.length("seq") >= 8).select("doc_id", F.md5(sequence.projected(F.col("seq"), offset, span, F.lit("TT"))).alias("md5"))


@query(f"""WITH {B.TRACTS}, l AS (SELECT DISTINCT 'GATTA' || seq || 'TTAG' AS r, length(seq) AS n FROM tracts) SELECT r AS ref_seq, substr(r, 1, 5) AS "left", substr(r, 6, CAST(n AS INT)) AS tract, substr(r, CAST(6 + n AS INT)) AS "right", n % 2 = 0 AS perfect FROM l""")
def locus_parts(spark: SparkSession, d: str) -> DataFrame:
    loci = B.tracts(spark, d).select(F.concat(F.lit("GATTA"), "seq", F.lit("TTAG")).alias("ref_seq"), F.length("seq").alias("n")).distinct()
    parts = sequence.locus_parts(F.col("ref_seq"), F.lit(100), F.lit(105), F.lit(105) + F.col("n"), F.lit("CA"))
    return loci.select("ref_seq", parts.alias("p")).select("ref_seq", "p.*")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey - 7 * l_suppkey AS BIGINT) AS n FROM lineitem), z AS (SELECT *, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z FROM v), k AS (SELECT *, CAST(1 + list_sum(list_transform(range(1, 9), lambda i: CASE WHEN z >= (1::BIGINT << CAST(7 * i AS INT)) THEN 1 ELSE 0 END)) AS BIGINT) AS k FROM z)
 SELECT l_orderkey, l_linenumber, z AS zigzag, array_to_string(list_transform(range(0, k), lambda i: printf('%02x', CAST(((z >> CAST(7 * i AS INT)) & 127) + CASE WHEN i < k - 1 THEN 128 ELSE 0 END AS INT))), '') AS bytes, n AS back FROM k""")
def variable_length_integers(spark: SparkSession, d: str) -> DataFrame:
    v = B.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey - 7 * l_suppkey AS BIGINT) AS n").withColumn("zigzag", encoding.zigzag(F.col("n")))
    coded = v.withColumn("bytes", encoding.leb128(F.col("zigzag")))
    return coded.select("l_orderkey", "l_linenumber", "zigzag", "bytes", encoding.unzigzag(encoding.from_leb128(F.col("bytes"))).alias("back"))


@query("SELECT o_orderkey, strftime(DATE '1970-01-01' + CAST(o_orderkey % 40000 - 9000 AS INT), '%Y-%m-%dT00:00:00Z') AS at FROM orders")
def dates_of_days(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").select("o_orderkey", encoding.date_of(F.col("o_orderkey") % 40000 - 9000).alias("at"))
