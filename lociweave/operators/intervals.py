"""Intervals: islands, unions, joins by overlap, complements. Ends are inclusive; columns are named by parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensure(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """df, failing with the message at a row that is bad."""
    return df.withColumn("_bad", bad).where(F.when(F.col("_bad"), F.raise_error(message)).otherwise(F.lit(True))).drop("_bad")


def with_islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int | Column = 0, order: list[str] | None = None, name: str = "island") -> DataFrame:
    """df with the number, from 1 in each key, of the island that a row is in: rows join while start <= running end + gap."""
    by = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def union(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """(keys, start, end, members): what the intervals cover; those with up to gap - 1 places between them are one."""
    found = with_islands(df, keys, start, end, gap)
    return found.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("island")


def variant_groups(df: DataFrame, keys: list[str], start: str, end: str, has_variant: str, max_span: int) -> DataFrame:
    """df's rows that are in a group, with its number. Only rows with a variant open a group; reference rows of one place stay
    only inside. A group wider than max_span is an error, never split.

    Exact where reference rows span one place: such a row outside a group is an island of its own without a variant.
    """
    found = with_islands(df, keys, start, end)
    own = Window.partitionBy(*keys, "island")
    found = found.withColumn("_any", F.max(F.col(has_variant).cast("int")).over(own)).where("_any = 1").drop("_any")
    width = F.max(end).over(own) - F.min(start).over(own) + 1
    return ensure(found, width > max_span, F.lit(f"a variant group spans more than {max_span}"))


def drop_bundles(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Intervals with no neighbour closer than gap: every run of two or more close ones goes whole."""
    found = with_islands(df, keys, start, end, gap)
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "island"))).where("_n = 1").drop("_n", "island")


def tiles_of(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], tile: int) -> DataFrame:
    """Pairs of rows whose spans overlap: both sides go to the tiles they touch and meet by tile; a pair counts in the tile where the later one starts.

    Column names of the two sides must differ but for the keys. A tile width near the usual span keeps copies few.
    """
    (a, b), (c, d) = left_span, right_span
    here = left.withColumn("_tile", F.explode(tiles_of(F.col(a), F.col(b), tile)))
    there = right.withColumn("_tile", F.explode(tiles_of(F.col(c), F.col(d), tile)))
    pairs = here.join(there, [*keys, "_tile"]).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
    return pairs.where(F.floor(F.greatest(a, c) / tile) == F.col("_tile")).drop("_tile")


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, span: tuple[str, str], tile: int) -> DataFrame:
    """The points in none of the intervals. Intervals are united first, so that a point meets each at most once."""
    a, b = span
    covered = union(intervals, keys, a, b).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    covered = covered.withColumn("_tile", F.explode(tiles_of(F.col("_a"), F.col("_b"), tile)))
    at = points.withColumn("_tile", F.floor(F.col(point) / tile).cast("long"))
    inside = (F.col("_p._tile") == F.col("_c._tile")) & F.col(f"_p.{point}").between(F.col("_c._a"), F.col("_c._b"))
    for k in keys:
        inside = inside & (F.col(f"_p.{k}") == F.col(f"_c.{k}"))
    return at.alias("_p").join(covered.alias("_c"), inside, "left_anti").drop("_tile")


def complement(df: DataFrame, lengths: DataFrame, keys: list[str], start: str, end: str, length: str) -> DataFrame:
    """(keys, start, end): what the intervals leave free of 1 to the contig's length. Of intervals that run out of the contig the part in it counts."""
    own = lengths.select(*keys, F.col(length).alias("_length"))
    clipped = df.join(own, keys).select(*keys, F.greatest(F.col(start), F.lit(1)).alias(start), F.least(F.col(end), F.col("_length")).alias(end)).where(F.col(start) <= F.col(end))
    edges = union(clipped, keys, start, end).select(*keys, start, end).unionByName(own.select(*keys, (F.col("_length") + 1).alias(start), (F.col("_length") + 1).alias(end)))
    before = F.lag(end, 1, 0).over(Window.partitionBy(*keys).orderBy(start))
    return edges.withColumn("_before", before).where(F.col(start) > F.col("_before") + 1).select(*keys, (F.col("_before") + 1).alias(start), (F.col(start) - 1).alias(end))


def intersect(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, tile: int) -> DataFrame:
    """What both cover, united on either side first."""
    there = union(right, keys, start, end).select(*keys, F.col(start).alias("_c"), F.col(end).alias("_d"))
    both = overlap_join(union(left, keys, start, end).select(*keys, start, end), there, keys, (start, end), ("_c", "_d"), tile)
    return both.select(*keys, F.greatest(start, "_c").alias(start), F.least(end, "_d").alias(end))


def in_order(df: DataFrame, keys: list[str], ordinal: str, position: str) -> DataFrame:
    """df, failing where positions fall in the rows' own order: late input is an error, never dropped."""
    before = F.lag(position).over(Window.partitionBy(*keys).orderBy(ordinal))
    return ensure(df, before > F.col(position), F.concat(F.lit("positions out of order at "), F.col(position).cast("string")))


def restrict(covered: DataFrame, regions: DataFrame, keys: list[str], span: tuple[str, str], region: tuple[str, str], tile: int) -> DataFrame:
    """The parts of covered intervals that lie in a region, with the interval's columns; one for each region that an interval meets."""
    (a, b), (c, d) = span, region
    return overlap_join(covered, regions, keys, span, region, tile).withColumn(a, F.greatest(a, c)).withColumn(b, F.least(b, d)).drop(c, d)


def inside(points: DataFrame, regions: DataFrame, keys: list[str], point: str, span: tuple[str, str], tile: int) -> DataFrame:
    """The points in any of the regions, each once."""
    a, b = span
    covered = union(regions, keys, a, b).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).withColumn("_tile", F.explode(tiles_of(F.col("_a"), F.col("_b"), tile)))
    at = points.withColumn("_tile", F.floor(F.col(point) / tile).cast("long"))
    return at.join(covered, [*keys, "_tile"]).where(F.col(point).between(F.col("_a"), F.col("_b"))).drop("_tile", "_a", "_b")


def depth(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, depth): runs of places that as many intervals cover, from the changes at their ends; places without any are left out."""
    changes = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("_at"), F.lit(1).alias("_d")), F.struct((F.col(end) + 1).alias("_at"), F.lit(-1).alias("_d")))).alias("x")).select(*keys, "x.*")
    sums = changes.groupBy(*keys, "_at").agg(F.sum("_d").alias("_d")).where("_d <> 0")
    by = Window.partitionBy(*keys).orderBy("_at")
    runs = sums.withColumn("depth", F.sum("_d").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("_at").over(by))
    return runs.where("depth > 0").select(*keys, F.col("_at").alias(start), (F.col("_next") - 1).alias(end), "depth")


def safe_cut(df: DataFrame, keys: list[str], start: str, end: str, watermark: int) -> DataFrame:
    """(keys, cut): where work up to the watermark can be cut without splitting an island: at the start of the last island if that runs
    past the watermark, else right after it."""
    found = with_islands(df.where(F.col(start) <= watermark), keys, start, end)
    islands = found.groupBy(*keys, "island").agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    last = islands.groupBy(*keys).agg(F.max_by(F.struct("_a", "_b"), "island").alias("_l"))
    return last.select(*keys, F.when(F.col("_l._b") > watermark, F.col("_l._a")).otherwise(watermark + 1).alias("cut"))
