"""Commands end to end on small made-up cohorts, file formats, and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave import config
from lociweave.operators import contamination, pileup, reads
from lociweave.plans import commands
from lociweave.sources import files
from lociweave.streaming import pileup_stream

SITES = "sample string, chrom_id int, pos long, ref string, seq string, num_obs long, q_sum double, fwd long, placed_left long, placed_start long, mapq_sum long, mapq_sum_sq long"


def site(sample, pos, ref, seq, n):
    return (sample, 0, pos, ref, seq, n, -6.9 * n, n // 2, n // 2, 1, 60 * n, 3600 * n)


def test_variant_command(spark):
    rows = []
    for s in range(6):
        rows += [site(f"s{s}", 10, "A", "A", 20), site(f"s{s}", 50, "C", "C", 10 if s < 2 else 20)]
    rows += [site("s0", 50, "C", "T", 10), site("s1", 50, "C", "T", 9), site("s5", 10, "A", "G", 1), site("s2", 90, "G", "T", 30), site("s3", 90, "G", "G", 30)]
    loci = {r["pos"]: r for r in commands.variant_command(spark.createDataFrame(rows, SITES)).collect()}
    assert set(loci) == {50, 90}
    assert dict(zip(loci[50]["samples"], loci[50]["genotypes"], strict=True)) == {"s0": 1, "s1": 1, "s2": 0, "s3": 0, "s4": 0, "s5": 0}
    assert dict(zip(loci[90]["samples"], loci[90]["genotypes"], strict=True)) == {"s2": 2, "s3": 0} and loci[50]["drop_reason"] is None
    masked = spark.createDataFrame([(0, 40, 60)], "chrom_id int, start long, end long")
    assert {r["pos"] for r in commands.variant_command(spark.createDataFrame(rows, SITES), masked).collect()} == {90}


def test_pileup_command(spark):
    rows = [("s", f"r{i}", 0, 0, 5, 60, "4M1I4M", "ACGTTACGT", [30] * 9) for i in range(40)]
    raw = spark.createDataFrame([*rows, ("s", "bad", 0, 0, 5, 3, "8M", "ACGTACGT", [30] * 8)], "sample string, qname string, flag int, chrom_id int, pos long, mapq int, c string, seq string, qual array<int>")
    raw = raw.withColumn("cigar", reads.parse_cigar(F.col("c"))).drop("c").withColumn("seq", F.col("seq"))
    reference = spark.createDataFrame([(0, p, "ACGTACGT"[p - 5]) for p in range(5, 13)], "chrom_id int, pos long, ref string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(reads.drop_reason, "__defaults__", (config.MIN_MAPQ, 1))
        got = {(r["pos"], r["seq"]): r["num_obs"] for r in commands.pileup_command(raw, reference).collect()}
    assert got == {(p, "ACGTACGT"[p - 5]): 40 for p in range(5, 13) if p != 8} | {(8, "TT"): 40}


def test_contamination_is_recovered(spark):
    rng = random.Random(3)
    rows = []
    for pos in range(3000):
        for s in range(6):
            others = sum(rng.random() < (0.03 if s == 0 else 0.001) for _ in range(40))
            rows.append((f"s{s}", 0, pos, 40 - others, others, 40, 0.001, "b"))
    df = spark.createDataFrame(rows, "sample string, chrom_id int, pos long, own long, others long, depth long, error double, batch string")
    got = {r["sample"]: r["contamination"] for r in contamination.estimate(df, ["chrom_id", "pos"], "sample", "batch", "own", "others", "depth", "error").collect()}
    assert got["s0"] == pytest.approx(0.03, abs=0.006) and all(got[f"s{i}"] < 0.01 for i in range(1, 6))
    few = contamination.estimate(df.where("sample < 's3'"), ["chrom_id", "pos"], "sample", "batch", "own", "others", "depth", "error")
    assert [r["contamination"] for r in few.collect()] == [None] * 3


def test_batches(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    got = contamination.assign_batches(samples, spark.createDataFrame([("a", "x")], "sample string, batch string"), "sample", "batch")
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("b", "all_samples")}
    with pytest.raises(Exception, match="two batches"):
        contamination.assign_batches(samples, spark.createDataFrame([("a", "x"), ("a", "y")], "sample string, batch string"), "sample", "batch").collect()


def test_catalog_and_genotypes(spark):
    rng = random.Random(4)
    flank = "".join(rng.choice("ACGT") for _ in range(120))
    contigs = spark.createDataFrame([("c1", flank + "CA" * 12 + flank[::-1])], "contig string, bases string")
    loci = [r for r in commands.catalog_command(contigs).collect() if r["end"] - r["start"] >= 20]
    assert len(loci) == 1 and loci[0]["motif"] in ("CA", "AC") and loci[0]["start"] in (119, 120)
    reads_ = [(1, s, 2, "CA" * n) for s, ns in (("x", (10, 10)), ("y", (10, 13))) for n in ns for _ in range(12)]
    tracts = spark.createDataFrame(reads_, "locus int, sample string, period int, seq string")
    calls, fates = commands.ssr_command(tracts, spark.createDataFrame([(1,), (2,)], "locus int"), ["locus"], "period")
    assert {r["sample"]: (r["first"], r["second"]) for r in calls.collect()} == {"x": (10, 10), "y": (10, 13)}
    assert {r["locus"]: r["fate"] for r in fates.collect()} == {1: "emitted", 2: "no_evidence"}


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACgt\nRN\n>c2\nGGG\n")
    fasta = files.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {tuple(r) for r in fasta.collect()} == {("c1", "ACGTNN"), ("c2", "GGG")}
    contigs = files.contig_table(fasta)
    assert files.contig_differences(contigs, contigs).count() == 0
    assert files.contig_differences(contigs, contigs.where("contig = 'c1'")).collect()[0]["difference"] == "only_left"
    (tmp_path / "a.bed").write_text("# x\ntrack a\nc1\t0\t3\nc2\t1\t99\n\n")
    assert {tuple(r) for r in files.read_bed(spark, str(tmp_path / "a.bed"), contigs).collect()} == {("c1", 1, 3), ("c2", 2, 3)}
    (tmp_path / "b.bed").write_text("c9\t0\t3\n")
    with pytest.raises(Exception, match="bad BED line"):
        files.read_bed(spark, str(tmp_path / "b.bed"), contigs).collect()
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:6\n@RG\tID:1\tSM:s\nq1\t0\tc1\t2\t60\t3M\t*\t0\t0\tCGT\tI?5\tNM:i:0\n")
    read = files.read_sam(spark, str(tmp_path / "a.sam")).collect()[0]
    assert read["qual"] == [40, 30, 20] and read["pos"] == 2 and read["cigar"][0]["len"] == 3
    assert {r["kind"]: r["fields"] for r in files.read_sam_header(spark, str(tmp_path / "a.sam")).collect()}["RG"] == {"ID": "1", "SM": "s"}
    region = spark.range(1).select(files.parse_region(F.lit("chr1:5-9")).alias("r"), files.parse_region(F.lit("chr1")).alias("q")).first()
    assert tuple(region["r"]) == ("chr1", 5, 9) and tuple(region["q"]) == ("chr1", None, None)


def test_sites_are_checked_on_writing(spark, tmp_path):
    row = ("s", 0, 5, 0, "A", 3, -1.0, 1, 1, 1, 60, 3600, [1, 2], float("nan"), 1.0)
    files.write_sites(spark.createDataFrame([row], files.SITES), str(tmp_path / "ok"))
    assert files.read_sites(spark, str(tmp_path / "ok")).count() == 1
    for bad in ({4: "AX"}, {6: float("inf")}, {12: [2, 2]}):
        wrong = tuple(bad.get(i, x) for i, x in enumerate(row))
        with pytest.raises(Exception, match="invalid record"):
            files.write_sites(spark.createDataFrame([wrong], files.SITES), str(tmp_path / f"bad{next(iter(bad))}"))


def test_vcf_is_in_order(spark, tmp_path):
    lines = spark.createDataFrame([("c1", i, f"c1\t{i}") for i in range(50, 0, -1)], "chrom string, pos long, value string")
    files.write_vcf(lines, files.vcf_header(["s"], [("c1", 100)]), str(tmp_path / "v"), "chrom", "pos", "value")
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    body = [x for x in text if not x.startswith("#")]
    assert text[0] == "##fileformat=VCFv4.4" and body == [f"c1\t{i}" for i in range(1, 51)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "sample int, pos long, base string, bq int, fwd boolean, read_start long, mapq int"
    rng = random.Random(5)
    rows = [(i % 2, i // 10, rng.choice("AC"), 30, i % 3 == 0, i // 10 - i % 2, 60) for i in range(400)]
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keys = ["sample", "pos", "base"]
    stream = pileup_stream.fold_stream(pileup_stream.stream_reads(spark, str(tmp_path / "in"), schema), keys)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("folded").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("folded").select(*keys, *config.STATS).collect()}
    batch = pileup.fold(spark.createDataFrame(rows, schema), keys).select(*keys, *config.STATS)
    assert got == {tuple(r) for r in batch.collect()}
