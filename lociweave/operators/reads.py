"""Reads: filter cascade, CIGAR strings, events, overlapping mates, depth caps, reservoirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave import config
from lociweave.operators.intervals import ensure

# SAM flag bits.
UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 4, 256, 512, 1024, 2048
CIGAR = "array<struct<op:string,len:int>>"


def drop_reason(flag: Column, mapq: Column, length: Column, min_mapq: int = config.MIN_MAPQ, min_length: int = config.MIN_READ_LENGTH) -> Column:
    """Why a read is dropped, the first that applies, or null."""

    def has(bit: int) -> Column:
        return flag.bitwiseAND(bit) != 0

    return F.when(has(DUPLICATE), "duplicate").when(mapq < min_mapq, "low_mapq").when(has(SUPPLEMENTARY), "supplementary").when(has(SECONDARY), "secondary").when(has(UNMAPPED), "unmapped").when(has(QC_FAIL), "qc_fail").when(length < min_length, "short")


def parse_cigar(cigar: Column) -> Column:
    """A CIGAR string as an array of operations."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def bad_cigar(ops: Column) -> Column:
    """An insertion next to a deletion, or a deletion outermost within the clips."""
    inner = F.filter(ops, lambda x: ~x["op"].isin("S", "H"))
    mixed = F.exists(F.zip_with(ops, F.slice(ops, 2, F.greatest(F.size(ops), F.lit(1))), lambda x, y: (x["op"] == "I") & (y["op"] == "D") | (x["op"] == "D") & (y["op"] == "I")), lambda x: F.coalesce(x, F.lit(False)))
    return mixed | F.when(F.size(inner) > 0, (F.get(inner, F.lit(0))["op"] == "D") | (F.element_at(inner, -1)["op"] == "D")).otherwise(F.lit(False))


def reference_span(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda acc, x: acc + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def events(reads: DataFrame, pos: str = "pos", cigar: str = "cigar", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """A row for each aligned base, and for each insertion or deletion at the base before it: kind, ref_pos, bases, span, bq.

    An indel's quality is the lowest in its window, one base to either side included.
    """
    start = F.struct(F.col(pos).cast("long").alias("r"), F.lit(1).alias("q"), F.array().cast("array<struct<kind:string,ref_pos:bigint,q:int,len:int>>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        kind, n = op["op"], op["len"]
        match = kind.isin("M", "=", "X")
        one = F.struct(F.when(match, "match").when(kind == "I", "insertion").otherwise("deletion").alias("kind"), F.when(match, acc["r"]).otherwise(acc["r"] - 1).alias("ref_pos"), F.when(match | (kind == "I"), acc["q"]).otherwise(acc["q"] - 1).alias("q"), n.alias("len"))
        out = F.when(match | kind.isin("I", "D"), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct((acc["r"] + F.when(match | kind.isin("D", "N"), n).otherwise(0)).alias("r"), (acc["q"] + F.when(match | kind.isin("I", "S"), n).otherwise(0)).alias("q"), out.alias("out"))

    blocks = F.aggregate(F.col(cigar), start, step)["out"]

    def spread(b: Column) -> Column:
        each = F.when(b["kind"] == "match", F.sequence(F.lit(0), b["len"] - 1)).otherwise(F.array(F.lit(0)))

        def one(i: Column) -> Column:
            low = F.greatest(b["q"] - F.when(b["kind"] == "insertion", 1).otherwise(0), F.lit(1))
            window = F.slice(F.col(qual), low, F.when(b["kind"] == "insertion", b["len"] + 2).otherwise(F.lit(2)))
            return F.struct(
                b["kind"].alias("kind"),
                (b["ref_pos"] + i).alias("ref_pos"),
                F.when(b["kind"] == "match", F.substring(F.col(seq), b["q"] + i, F.lit(1))).when(b["kind"] == "insertion", F.substring(F.col(seq), b["q"], b["len"])).otherwise("").alias("bases"),
                F.when(b["kind"] == "deletion", b["len"]).otherwise(F.when(b["kind"] == "match", 1).otherwise(0)).alias("span"),
                F.when(b["kind"] == "match", F.get(F.col(qual), b["q"] + i - 1)).otherwise(F.array_min(window)).alias("bq"),
            )

        return F.transform(each, one)

    rest = [c for c in reads.columns if c not in (pos, cigar, seq, qual)]
    return reads.select(*rest, F.explode(F.flatten(F.transform(blocks, spread))).alias("e")).select(*rest, "e.*")


def resolve_mates(reads: DataFrame, keys: list[str], base: str, bq: str, start: str, first: str | None, tie: str) -> DataFrame:
    """reads with bq where two of a fragment (keys) cover a place: agreeing mates give the keeper the sum, at most 200, and the other 0;
    disagreeing ones leave the better 0.8 of its own, and the other 0. The first of the pair is kept, then the one that starts first.
    """
    own = Window.partitionBy(*keys)
    prefer = [F.col(first).cast("int").desc()] if first else []
    by_role = own.orderBy(*prefer, start, tie)
    by_bq = own.orderBy(F.col(bq).desc(), *prefer, start, tie)
    n = F.count("*").over(own)
    agree = F.min(base).over(own) == F.max(base).over(own)
    keeper, winner = F.row_number().over(by_role) == 1, F.row_number().over(by_bq) == 1
    both = F.when(keeper, F.least(F.sum(bq).over(own).cast("double"), F.lit(200.0))).otherwise(0.0)
    better = F.when(winner, 0.8 * F.col(bq)).otherwise(0.0)
    return reads.withColumn("resolved_bq", F.when(n != 2, F.col(bq).cast("double")).when(agree, both).otherwise(better))


def cap_depth(reads: DataFrame, keys: list[str], order: list[str], has_indel: str, snp_cap: int = config.MAX_SNP_COLUMN_DEPTH, indel_cap: int = config.MAX_INDEL_COLUMN_DEPTH) -> DataFrame:
    """The first reads of each place in order of admission, fewer where any has an indel."""
    own = Window.partitionBy(*keys)
    cap = F.when(F.max(F.col(has_indel).cast("int")).over(own) == 1, indel_cap).otherwise(snp_cap)
    return reads.withColumn("_n", F.row_number().over(own.orderBy(*order))).withColumn("_cap", cap).where("_n <= _cap").drop("_n", "_cap")


def reservoir(rows: DataFrame, keys: list[str], identity: list[str], k: int, seed: int = 1) -> DataFrame:
    """k rows of each group, each set as likely as any other, the same on every run: those with the smallest seeded hashes.

    The hash takes the group in, so that groups draw apart.
    """
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *identity)]))
    order = Window.partitionBy(*keys).orderBy(drawn, *identity)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def link_mates(reads: DataFrame, qname: str, pos: str, read_id: str, window: int = config.MATE_WINDOW) -> DataFrame:
    """reads with chain_id: that of the fragment's first read where mates start within the window of each other, else their own."""
    own = Window.partitionBy(qname)
    near = (F.count("*").over(own) == 2) & (F.max(pos).over(own) - F.min(pos).over(own) <= window)
    return reads.withColumn("chain_id", F.when(near, F.min(read_id).over(own)).otherwise(F.col(read_id)))


def merge_files(files: list[DataFrame], identity: list[str], order: list[str]) -> DataFrame:
    """One sample's files as one table; the same read in two files is an error."""
    both = None
    for i, df in enumerate(files):
        df = df.withColumn("source_file", F.lit(i))
        both = df if both is None else both.unionByName(df)
    own = Window.partitionBy(*identity)
    clash = F.min("source_file").over(own) != F.max("source_file").over(own)
    return ensure(both, clash, F.lit("a read is in two files")).orderBy(*order, "source_file")


def mismatching(bases: DataFrame, read: list[str], base: str, ref: str, bq: str, floor: int = config.MISMATCH_BQ_FLOOR, most: float = config.MAX_MISMATCH_FRACTION) -> DataFrame:
    """(read, compared, mismatches, dropped) from a row for each aligned base: a read is dropped where too large a share of its bases of
    some quality differs from the reference. N on either side is not compared."""
    sound = (F.col(bq) >= floor) & (F.upper(base) != "N") & (F.upper(ref) != "N")
    counts = bases.groupBy(*read).agg(F.count_if(sound).alias("compared"), F.count_if(sound & (F.upper(base) != F.upper(ref))).alias("mismatches"))
    return counts.withColumn("dropped", F.col("mismatches") > most * F.col("compared"))


def position_steps(rows: DataFrame, keys: list[str], position: str, block: int) -> DataFrame:
    """rows with their block, of that many rows in order of position, and the step from the row before in it, 0 for the first."""
    numbered = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(position)) - 1) / block).cast("int"))
    return numbered.withColumn("step", F.col(position) - F.lag(position).over(Window.partitionBy(*keys, "block").orderBy(position))).fillna(0, ["step"])
