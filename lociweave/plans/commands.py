"""The commands of a variant-calling run, from tables to tables, composed of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import stats
from lociweave.operators import cohort, contamination, genotyping, intervals, paralog, pileup, reads, scan, ssr
from lociweave.sources import files

SITE = ["sample", "chrom_id", "pos"]


def pileup_command(raw: DataFrame, reference: DataFrame) -> DataFrame:
    """Reads (sample, qname, flag, chrom_id, pos, mapq, cigar, seq, qual) to allele statistics of each sample and position.

    Filters, events, overlapping mates, depth caps, fold, coverage windows. reference: (chrom_id, pos, ref), a row for each base.
    """
    kept = raw.where(reads.drop_reason(F.col("flag"), F.col("mapq"), F.length("seq")).isNull() & ~reads.bad_cigar(F.col("cigar")))
    named = kept.withColumn("read_id", F.xxhash64("sample", "qname", "flag", "chrom_id", "pos")).withColumn("read_start", F.col("pos"))
    each = reads.events(named.withColumn("first", F.col("flag").bitwiseAND(64) != 0).withColumn("fwd", F.col("flag").bitwiseAND(16) == 0)).withColumnRenamed("ref_pos", "pos")
    # a read with an indel at a place shows the indel there, not the base that anchors it
    indels = F.max((F.col("kind") != "match").cast("int")).over(Window.partitionBy(*SITE, "read_id"))
    each = each.withColumn("_indels", indels).where("_indels = 0 OR kind <> 'match'").drop("_indels")
    resolved = reads.resolve_mates(each, [*SITE, "qname"], "bases", "bq", "read_start", "first", "read_id").where("resolved_bq > 0")
    capped = reads.cap_depth(resolved.withColumn("indel", F.col("kind") != "match"), SITE, ["read_start", "read_id"], "indel")
    allele = capped.join(reference, ["chrom_id", "pos"]).withColumn("seq", F.when(F.col("kind") == "insertion", F.concat("ref", "bases")).when(F.col("kind") == "deletion", F.concat(F.lit("<DEL"), F.col("span").cast("string"), F.lit(">"))).otherwise(F.col("bases")))
    return pileup.fold(allele, [*SITE, "ref", "seq"], bq="resolved_bq")


def variant_command(sites: DataFrame, mask: DataFrame | None = None, min_alt_obs: int = config.MIN_ALT_OBS, min_qual: float = config.MIN_QUAL) -> DataFrame:
    """Allele statistics (sample, chrom_id, pos, ref, seq and the seven) to called loci, with why a locus would be dropped.

    Low-complexity places out, groups with too few reads out, alleles capped and the rest pooled, likelihoods, EM, gates.
    """
    place = ["chrom_id", "pos"]
    if mask is not None:
        sites = intervals.outside(sites, mask, ["chrom_id"], "pos", ("start", "end"), 4096)
    merged = cohort.merge_positions(sites.withColumn("span", F.length("ref")), place, "sample", F.col("seq") == F.col("ref"), "num_obs", "span")
    groups = intervals.with_islands(merged.withColumn("end", F.col("pos") + F.col("max_span") - 1), ["chrom_id"], "pos", "end")
    kept = cohort.keep_groups(groups, ["chrom_id", "island"], "max_nonref", min_alt_obs).where("max_nonref > 0")
    here = sites.join(kept.select(*place), place, "left_semi")
    first = F.min(F.struct("sample", "seq"))
    per = here.groupBy(*place, "ref", "seq").agg(F.count("*").alias("cohort_count"), first.alias("first_seen"))
    ranked = cohort.top_alleles(per, place, "cohort_count", F.col("seq") == F.col("ref"), ["first_seen"]).where("kept")
    own = Window.partitionBy(*place)
    index = F.row_number().over(own.orderBy(F.when(F.col("seq") == F.col("ref"), 0).otherwise(1), "first_seen")) - 1
    alleles = ranked.withColumn("allele", index).withColumn("n_alleles", F.count("*").over(own)).select(*place, "seq", "allele", "n_alleles", allele_class(F.col("ref"), F.col("seq")).alias("class"))
    samples = here.select("sample", *place).distinct().join(alleles, place)
    filled = samples.join(here.select(*SITE, "seq", "num_obs", "q_sum"), [*SITE, "seq"], "left").fillna(0, ["num_obs", "q_sum"])
    pooled = here.join(alleles.select(*place, "seq"), [*place, "seq"], "left_anti").groupBy(*SITE).agg(F.sum("q_sum").alias("other"))
    ll = genotyping.likelihoods(filled, SITE).join(pooled, SITE, "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("other", F.lit(0.0)))
    rows = ll.groupBy(*SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("genotype", "log_likelihood"))), lambda x: x["log_likelihood"]).alias("lls"))
    kinds = alleles.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("allele", "class", "seq"))), lambda x: F.struct(x["class"].alias("class"), x["seq"].alias("seq"))).alias("alleles"))
    rows = rows.join(kinds, place).withColumn("classes", F.transform("alleles", lambda x: x["class"]))
    called = genotyping.call_loci(rows, place, "sample", "classes")
    reason = F.when(~F.exists("genotypes", lambda g: g != 0), "hom_ref").when(F.col("qual") < min_qual, "low_qual")
    return called.join(kinds, place).withColumn("drop_reason", reason).withColumn("filter", F.when(F.col("converged"), "PASS").otherwise("EMNoConv"))


def allele_class(ref: Column, seq: Column) -> Column:
    return F.when(seq == ref, "ref").when(F.length(seq) == F.length(ref), "snp").otherwise("indel")


def paralog_command(loci: DataFrame, keys: list[str]) -> DataFrame:
    """loci (keys, sample, alt, ref, copies, f, sigma) to (keys, lr, posterior, dropped) at the default false-discovery rate."""
    import numpy as np

    lr = paralog.locus_ratios(loci, keys)
    hist = paralog.histogram(lr, "lr")
    counts = np.zeros(config.LR_HISTOGRAM[2])
    for r in hist.collect():  # at most as many rows as there are bins
        counts[r["bin"]] = r["n"]
    pi = paralog.paralog_share(counts)
    cut = paralog.fdr_cut(paralog.fdr_curve(hist, pi)).first()["threshold"]
    dropped = F.lit(False) if cut is None else F.coalesce(F.col("lr") >= cut, F.lit(False))
    return lr.withColumn("posterior", stats.sigmoid(F.col("lr") + float(np.log(pi / (1 - pi))))).withColumn("dropped", dropped)


def contamination_command(sites: DataFrame, batches: DataFrame, allele: str = "seq") -> DataFrame:
    """(sample, contamination) from allele statistics, over informative sites in order."""
    place = ["chrom_id", "pos"]
    informative = cohort.informative_sites(sites, place, allele, "num_obs").select(*place)
    here = sites.join(informative, place, "left_semi")
    major = cohort.hom_major(here, SITE, allele, "num_obs")
    met = here.join(major, SITE).groupBy(*SITE, "depth").agg(F.sum(F.when(F.col(allele) == F.col("major"), F.col("num_obs")).otherwise(0)).alias("own"), F.exp(F.sum("q_sum") / F.first("depth")).alias("error"))
    rows = contamination.assign_batches(met.withColumn("others", F.col("depth") - F.col("own")), batches, "sample", "batch")
    return contamination.estimate(rows, place, "sample", "batch", "own", "others", "depth", "error")


def catalog_command(contigs: DataFrame, periods: tuple[int, int] = (2, 6), flank: int = 50, gap: int = config.BUNDLE_GAP, min_purity: float = config.MIN_PURITY, min_score: int = 20) -> DataFrame:
    """Contigs (contig, bases) to microsatellite loci with their flanked reference: tandem repeats of the periods, pure, alone, with enough copies."""
    from lociweave.functions.sequence import purity

    found = scan.scan(contigs, "contig", "bases", "tandem").where(F.col("period").between(*periods) & (F.col("score") >= min_score))
    alone = intervals.drop_bundles(found.withColumn("last", F.col("end") - 1), ["contig"], "start", "last", gap).drop("last")
    with_bases = alone.join(contigs, "contig")
    tract = F.substring("bases", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    motif = F.substring("bases", F.col("start").cast("int") + 1, F.col("period"))
    whole = ((F.col("end") - F.col("start")) / F.col("period")).cast("int")
    least = F.when(F.col("period") == 2, 5).when(F.col("period") == 3, 4).otherwise(3)
    low = F.greatest(F.col("start") - flank, F.lit(0))
    loci = with_bases.withColumn("motif", motif).withColumn("purity_fraction", purity(tract, F.col("motif")).cast("float")).withColumn("copies", whole)
    loci = loci.where((F.col("copies") >= least) & (F.col("purity_fraction") >= min_purity))
    return loci.select(F.col("contig").alias("chrom"), "start", "end", "motif", "purity_fraction", low.alias("ref_seq_start"), F.substring("bases", low.cast("int") + 1, (F.col("end") + flank - low).cast("int")).alias("ref_seq"))


def ssr_command(tracts: DataFrame, catalog: DataFrame, locus: list[str], period: str, seq: str = "seq", min_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Tract reads (locus, sample, seq) to genotypes, and to the fate of every catalog locus."""
    tallies = ssr.tally(tracts, [*locus, "sample", period], seq)
    ladder = ssr.rungs(tallies, [*locus, "sample"], seq, "reads", F.col(period))
    deep = ladder.groupBy(*locus).agg(F.sum("reads").alias("_n")).where(F.col("_n") >= min_depth).select(*locus)
    calls = ssr.call(ladder.join(deep, locus, "left_semi"), locus, "sample")
    modal = ssr.modal_units(ladder, locus)
    differ = calls.join(modal, locus).groupBy(*locus).agg(F.max(((F.col("first") != F.col("modal")) | (F.col("second") != F.col("modal"))).cast("int")).alias("_v"))
    judged = ladder.select(*locus).distinct().join(differ, locus, "left").select(*locus, F.when(F.col("_v").isNull(), "filtered").when(F.col("_v") == 1, "emitted").otherwise("monomorphic").alias("reason"))
    return calls, ssr.fate(catalog, judged, locus, "reason")


def regions_command(contigs: DataFrame) -> DataFrame:
    """Contigs (contig, bases) to a table of typed regions as lines of text, half-open from 0."""
    typed = scan.typed_regions(contigs, "contig", "bases")
    return typed.select("contig", "start", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "kind").alias("value"))


def dump_command(sites: DataFrame) -> DataFrame:
    """Allele statistics (allele_idx, seq and the rest) as lines of seven columns."""
    return files.pileup_line(sites, SITE, "chrom_id", "pos")
