"""The generic test tables seen as genomic records, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import pileup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each line item."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 8 AS sample",
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS chrom_id",
        "1 + datediff(l_shipdate, date'1992-01-01') div 7 AS pos",
        "l_quantity", "l_partkey", "20 + 5 * l_linenumber AS mapq", "10 + cast(round(l_discount * 100) AS int) * 3 AS bq", "l_linestatus = 'F' AS fwd", "l_orderkey AS chain_id", "l_orderkey * 8 + l_linenumber AS read_id", "l_linenumber",
    )
    df = df.withColumn("ref", F.expr("substr('ACGT', cast(1 + (pos * 7 + chrom_id * 3) % 4 AS int), 1)"))
    return df.selectExpr("sample", "chrom_id", "pos", "ref", "CASE WHEN l_quantity > 12 THEN ref ELSE substr('ACGT', cast(1 + l_partkey % 4 AS int), 1) END AS base", "mapq", "bq", "fwd", "chain_id", "read_id", "pos - l_linenumber % 3 AS read_start", "1 + l_linenumber % 4 AS span", "l_linenumber")


READS = """li AS (SELECT l_suppkey % 8 AS sample, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS chrom_id,
 1 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS pos, l_quantity, l_partkey, 20 + 5 * l_linenumber AS mapq,
 10 + CAST(round(l_discount * 100) AS INT) * 3 AS bq, l_linestatus = 'F' AS fwd, l_orderkey AS chain_id, l_orderkey * 8 + l_linenumber AS read_id, l_linenumber FROM lineitem),
lr AS (SELECT *, substr('ACGT', CAST(1 + (pos * 7 + chrom_id * 3) % 4 AS INT), 1) AS ref FROM li),
reads AS (SELECT sample, chrom_id, pos, ref, CASE WHEN l_quantity > 12 THEN ref ELSE substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) END AS base,
 mapq, bq, fwd, chain_id, read_id, pos - l_linenumber % 3 AS read_start, 1 + l_linenumber % 4 AS span, l_linenumber FROM lr)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.fold(reads(spark, sf_dir), ["sample", "chrom_id", "pos", "ref", "base"])


SITES = READS + """,
sites AS (SELECT sample, chrom_id, pos, ref, base, count(*) AS num_obs, sum(bq) * (-ln(10.0) / 10) AS q_sum, CAST(sum(CASE WHEN fwd THEN 1 ELSE 0 END) AS BIGINT) AS fwd,
 CAST(sum(CASE WHEN pos - read_start <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS placed_left, CAST(sum(CASE WHEN pos = read_start THEN 1 ELSE 0 END) AS BIGINT) AS placed_start,
 CAST(sum(mapq) AS BIGINT) AS mapq_sum, CAST(sum(mapq * mapq) AS BIGINT) AS mapq_sum_sq FROM reads GROUP BY ALL)"""


def biallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and other reads of each sample and position, side by side."""
    is_ref = F.col("base") == F.col("ref")
    s = sites(spark, sf_dir)
    sums = []
    for c in ("num_obs", "fwd", "placed_left", "mapq_sum", "mapq_sum_sq", "q_sum"):
        sums += [F.sum(F.when(is_ref, F.col(c)).otherwise(0)).alias(f"ref_{c}"), F.sum(F.when(~is_ref, F.col(c)).otherwise(0)).alias(f"alt_{c}")]
    return s.groupBy("sample", "chrom_id", "pos").agg(*sums)


BIALLELIC = SITES + ",\nbi AS (SELECT sample, chrom_id, pos, " + ", ".join(f"{'sum' if c == 'q_sum' else 'CAST(sum'}(CASE WHEN base {op} ref THEN {c} ELSE 0 END){'' if c == 'q_sum' else ' AS BIGINT)'} AS {side}_{c}" for c in ("num_obs", "fwd", "placed_left", "mapq_sum", "mapq_sum_sq", "q_sum") for side, op in (("ref", "="), ("alt", "<>"))) + " FROM sites GROUP BY ALL)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each order, on a contig for each customer."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS contig", "cast(datediff(o_orderdate, date'1992-01-01') AS bigint) AS start", "cast(datediff(o_orderdate, date'1992-01-01') AS bigint) + o_orderkey % 30 AS end", "o_orderkey AS span_id", "o_orderkey % 3 = 0 AS variant")


SPANS = """spans AS (SELECT o_custkey AS contig, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start,
 date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS "end", o_orderkey AS span_id, o_orderkey % 3 = 0 AS variant FROM orders)"""


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each document: its letters a to z, dealt onto the four bases in turn."""
    letters, bases = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), letters, bases).alias("seq"))


SEQS = "seqs AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of a repeat tract for each event: its locus by user, its length by the event."""
    return table(spark, sf_dir, "events").selectExpr("user_id % 100 AS locus", "event_id % 12 AS sample", "repeat('CA', cast(4 + (event_id * 7 + length(event_type)) % 5 AS int)) || CASE WHEN event_id % 11 = 0 THEN 'C' ELSE '' END AS seq")


TRACTS = "tracts AS (SELECT user_id % 100 AS locus, event_id % 12 AS sample, repeat('CA', CAST(4 + (event_id * 7 + length(event_type)) % 5 AS INT)) || CASE WHEN event_id % 11 = 0 THEN 'C' ELSE '' END AS seq FROM events)"
