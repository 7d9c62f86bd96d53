"""Genomic text formats as DataFrames, and back. Paths are whatever Spark's readers open."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.sequence import canonical
from lociweave.operators.reads import parse_cigar

SITES = "sample string, chrom_id int, pos long, allele_idx int, seq string, num_obs long, q_sum double, fwd long, placed_left long, placed_start long, mapq_sum long, mapq_sum_sq long, chain_ids array<long>, windowed_gc float, windowed_coverage float"
EVIDENCE = "sample string, chrom_id int, start long, end long, depth int, n_filtered int, mapped_reads int, n_low_quality int, n_border_off_end int, n_widened int, n_window_truncated int, observed array<struct<seq:string,count:int>>"


def check_schema(df: DataFrame, ddl: str) -> DataFrame:
    """df if it has the columns of the schema, in their types; an error that names the first that differs otherwise."""
    want = df.sparkSession.createDataFrame([], ddl).schema
    for f in want:
        if f.name not in df.columns or df.schema[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} must be {f.dataType.simpleString()}")
    return df.select(*[f.name for f in want])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return check_schema(spark.read.parquet(path), SITES)


def write_sites(sites: DataFrame, path: str) -> None:
    """Pileup records by position, so that row-group statistics serve range scans; invalid rows are an error."""
    bad = (F.length("seq") < 1) | (F.length("seq") > 10_000) | ~F.col("seq").rlike("^[ACGTN]+$") | F.isnan("q_sum") | (F.abs("q_sum") == float("inf")) | F.exists(F.arrays_zip(F.col("chain_ids").alias("a"), F.slice("chain_ids", 2, F.greatest(F.size("chain_ids"), F.lit(1))).alias("b")), lambda x: x["a"] >= x["b"])
    checked = check_schema(sites, SITES).where(F.when(bad, F.raise_error(F.concat(F.lit("invalid record at "), F.col("pos").cast("string")))).otherwise(F.lit(True)))
    checked.repartitionByRange("chrom_id", "pos").sortWithinPartitions("chrom_id", "pos", "allele_idx").write.option("compression", "zstd").parquet(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text; header lines are left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f"))
    quals = F.transform(F.split(F.get("f", F.lit(10)), ""), lambda c: F.ascii(c) - 33)
    return lines.select(
        F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(2)).alias("chrom"), F.get("f", F.lit(3)).cast("long").alias("pos"), F.get("f", F.lit(4)).cast("int").alias("mapq"),
        parse_cigar(F.get("f", F.lit(5))).alias("cigar"), F.get("f", F.lit(7)).cast("long").alias("mate_pos"), F.get("f", F.lit(8)).cast("long").alias("tlen"), F.get("f", F.lit(9)).alias("seq"), quals.alias("qual"), F.slice("f", 12, 1000).alias("tags"),
    )


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields: map) of header lines."""
    lines = spark.read.text(path).where(F.col("value").startswith("@"))
    pairs = F.filter(F.split(F.regexp_replace("value", "^@..\t?", ""), "\t"), lambda x: F.contains(x, F.lit(":")))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 30)))).alias("fields"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bases): a record's lines joined, upper case, all but A, C, G and T as N."""
    whole = spark.read.option("lineSep", ">").text(path).where(F.length("value") > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    return whole.select(name.alias("contig"), canonical(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("bases"))


def contig_table(fasta: DataFrame) -> DataFrame:
    return fasta.select("contig", F.length("bases").cast("long").alias("length"), F.md5(F.encode("bases", "UTF-8")).alias("md5"))


def contig_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Contigs that the two tables (contig, length, md5) do not agree on, and how."""
    both = left.alias("a").join(right.alias("b"), "contig", "full_outer")
    why = F.when(F.col("a.length").isNull(), "only_right").when(F.col("b.length").isNull(), "only_left").when(F.col("a.length") != F.col("b.length"), "length").when(F.col("a.md5") != F.col("b.md5"), "md5")
    return both.select("contig", why.alias("difference")).where("difference IS NOT NULL")


def read_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(contig, start, end), inclusive from 1, ends clamped to contigs. Unknown contigs and empty or inverted spans are errors."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^#|^track|^browser"))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("_a"), F.get(f, F.lit(2)).cast("long").alias("_b")).join(contigs.select("contig", "length"), "contig", "left")
    bad = F.col("length").isNull() | F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") >= F.col("_b"))
    rows = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("bad BED line on "), F.col("contig")))).otherwise(F.lit(True)))
    return rows.select("contig", (F.col("_a") + 1).alias("start"), F.least("_b", "length").alias("end"))


def parse_region(region: Column) -> Column:
    """contig[:start-end] as a struct."""
    shape = r"^([^:]+)(?::(\d+)-(\d+))?$"
    return F.struct(F.regexp_extract(region, shape, 1).alias("contig"), F.nullif(F.regexp_extract(region, shape, 2), F.lit("")).cast("long").alias("start"), F.nullif(F.regexp_extract(region, shape, 3), F.lit("")).cast("long").alias("end"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Microsatellite loci, half-open from 0."""
    schema = "chrom string, start long, end long, motif string, purity_fraction float, ref_seq_start long, ref_seq string"
    return spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path)


def catalog_lines(loci: DataFrame) -> DataFrame:
    return loci.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "motif", F.format_string("%.4f", F.col("purity_fraction").cast("double")), F.col("ref_seq_start").cast("string"), "ref_seq").alias("value"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("sample string, batch string").csv(path)


def read_artefact(spark: SparkSession, path: str, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, samples) of a contamination artefact, a JSON document; probabilities of a batch must add up to 1, and every sample of the cohort be named."""
    doc = spark.read.option("multiLine", True).json(path)
    batches, named = doc.select(F.explode("batches").alias("b")).select("b.*"), doc.select(F.explode("samples").alias("s")).select("s.*")
    off = F.abs(F.col("contaminant_ref_prob") + F.col("contaminant_snp_alt_prob") + F.col("contaminant_indel_alt_prob") - 1) >= 1e-5
    batches = batches.where(F.when(off, F.raise_error(F.concat(F.lit("probabilities of batch "), F.col("id"), F.lit(" do not add up to 1")))).otherwise(F.lit(True)))
    missing = samples.join(named.select(F.col("name").alias("sample")), "sample", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"sample {missing[0][0]} is not in the artefact")
    return batches, named


def write_artefact(batches: DataFrame, samples: DataFrame, path: str) -> None:
    """Batches and samples of a run, a few rows each, as one JSON document."""
    one = batches.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("batches")).join(samples.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("samples")))
    one.select(F.to_json(F.struct("batches", "samples")).alias("value")).coalesce(1).write.text(path)


def vcf_header(samples: list[str], contigs: list[tuple[str, int]], extra: dict[str, str] | None = None) -> str:
    # Fields of the format.
    info = [("AF", "A", "Float", "Allele frequency"), ("AC", "A", "Integer", "Allele count"), ("AN", "1", "Integer", "Alleles called"), ("DP", "1", "Integer", "Depth"), ("CA", "A", "Integer", "Compound allele"), ("MQRef", "1", "Float", "Mean MAPQ of REF reads"), ("MQAlt", "A", "Float", "Mean MAPQ of ALT reads"), ("MQDiff", "A", "Float", "Difference of the means"), ("MQDiffT", "A", "Float", "Welch t of the difference"), ("PARALOG_POST", "1", "Float", "Posterior of a hidden paralog")]
    fmt = [("GT", "1", "String", "Genotype"), ("GQ", "1", "Integer", "Genotype quality"), ("DP", "1", "Integer", "Depth"), ("AD", "R", "Integer", "Reads of each allele")]
    lines = ["##fileformat=VCFv4.4", *[f"##{k}={json.dumps(v)}" for k, v in (extra or {}).items()], '##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=EMNoConv,Description="Not converged">']
    lines += [f'##INFO=<ID={a},Number={b},Type={c},Description="{d}">' for a, b, c, d in info] + [f'##FORMAT=<ID={a},Number={b},Type={c},Description="{d}">' for a, b, c, d in fmt]
    lines += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])])


def vcf_line(chrom: Column, pos: Column, ref: Column, alt: Column, qual: Column, passed: Column, info: Column, samples: Column) -> Column:
    """A record as text; samples: array<string> of GT:GQ:DP:AD cells."""
    return F.concat_ws("\t", chrom, pos.cast("string"), F.lit("."), ref, alt, F.format_string("%.2f", qual), F.when(passed, "PASS").otherwise("EMNoConv"), info, F.lit("GT:GQ:DP:AD"), F.array_join(samples, "\t"))


def write_vcf(lines: DataFrame, header: str, path: str, chrom: str, pos: str, value: str) -> None:
    """Lines in order, in part files that follow each other, the header first; Spark's commit makes the output appear whole."""
    body = lines.select(F.lit(1).alias("_k"), F.col(chrom).cast("string").alias("_c"), F.col(pos).cast("long").alias("_p"), F.col(value).alias("value"))
    head = lines.sparkSession.createDataFrame([(0, "", 0, header)], "_k int, _c string, _p long, value string")
    head.unionByName(body).repartitionByRange("_k", "_c", "_p").sortWithinPartitions("_k", "_c", "_p").select("value").write.text(path)


def pileup_line(sites: DataFrame, keys: list[str], chrom: str, pos: str) -> DataFrame:
    """(keys, line): the seven-column text of a position's alleles (allele_idx, seq, num_obs, fwd, placed_left, placed_start, q_sum)."""
    own = sites.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("allele_idx", "seq", "num_obs", "fwd", "placed_left", "placed_start", "q_sum"))).alias("_a"))
    a, ref = F.col("_a"), F.get(F.col("_a"), F.lit(0))["seq"]
    depth = F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x["num_obs"]).cast("int")

    def symbols(x: Column) -> Column:
        anchor, same = F.substring(x["seq"], 1, 1), F.length(x["seq"]) - F.length(ref)
        matches = (x["allele_idx"] == 0) | (anchor == F.substring(ref, 1, 1))
        tail = F.when(same > 0, F.concat(F.lit("+"), same.cast("string"), F.substring(x["seq"], F.length(ref) + 1, same))).when(same < 0, F.concat(F.lit("-"), (-same).cast("string"), F.substring(ref, F.length(x["seq"]) + 1, -same))).otherwise("")
        up = F.concat(F.when(matches, ".").otherwise(F.upper(anchor)), F.upper(tail))
        low = F.concat(F.when(matches, ",").otherwise(F.lower(anchor)), F.lower(tail))
        fwd = F.least(x["fwd"], x["num_obs"]).cast("int")
        return F.concat(F.repeat(up, fwd), F.repeat(low, x["num_obs"].cast("int") - fwd))

    detail = F.transform(a, lambda x: F.concat_ws(":", x["seq"], x["num_obs"].cast("string"), x["fwd"].cast("string"), x["placed_left"].cast("string"), x["placed_start"].cast("string"), F.format_string("%.3f", x["q_sum"])))
    line = F.concat_ws("\t", F.col(chrom).cast("string"), F.col(pos).cast("string"), F.substring(ref, 1, 1), depth.cast("string"), F.array_join(F.transform(a, symbols), ""), F.repeat(F.lit("!"), depth), F.array_join(detail, ","))
    return own.select(*keys, line.alias("line"))

