"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the whole size by their weights; a source's target stops at `most` epochs and the excess is reshared by weight
until none is above. A source repeats all of its documents for as many complete epochs as its target holds; for the rest,
documents are drawn without replacement in the order of exponential keys, -ln(u) / weight, where u in (0, 1) is a hash of
the document's id and text and the weight its quality weight, until the running sum of sizes reaches what is left of the target. The
document that crosses it is taken in part, so that a source's words meet its target to the word.

Running sums are made in two steps, so that no source lands in one task: keys are cut into buckets of about BUCKET_ROWS
documents by the distribution that the keys would have at the source's mean weight; sums over buckets are small tables. Only
the bucket in which a source's target is met is sorted, and gives the key at which it is met: documents with smaller keys
are taken whole, those with larger ones not at all, so that texts and other columns are never shuffled.
The table of sources, one row each, goes to the driver for the resharing; sources are few (corpora, not hosts).

Defined cases: null texts have size 0; a null source is a source of its own, last in order; sources of size 0 get target 0;
documents of size 0 are never taken; documents that share an id have keys of their own, as u hashes the text too; rows that repeat
id and text have equal keys and are drawn in any order, as they are equal, and only those at which a target is met are numbered; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

MOST, BUCKET_ROWS, SEED = 3, 2000, 20
MOST_BROADCAST = 10_000  # sources; beyond, the join shuffles
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of runs without space, tab, line feed, vertical tab, form feed or carriage return."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1)
    ends = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - ends).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.5 to 2: texts whose words have the usual mean length, three to nine characters with their gap, weigh most."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.5), F.lit(2.0) - F.abs(mean - 6.0) / 4.0)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the parts' MD5, the same in every engine; null parts count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def reshare(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above most times its size; the excess is reshared among the others."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left = total - sum(targets)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def mix(docs: DataFrame, weight_of: Callable[[int], float] = lambda i: 1.0 + i % 3, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) and the columns named in keep. weight_of: a source's weight by its place in order."""
    spark = docs.sparkSession
    size = words_in(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep or []])
    slim = slim.withColumn("weight", quality_weight(F.col("text"), F.col("size"))).withColumn("hash", F.md5(F.coalesce("text", F.lit("")))).drop("text")
    slim, _ = cut(slim.withColumn("key", -F.log(uniform(seed, F.col("id"), F.col("hash"))) / F.col("weight")), "sizes")

    rows = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("mean")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # strings compare by code point
    targets = reshare([r["source_size"] for r in rows], [weight_of(i) for i in range(len(rows))], most)
    plan = []
    for r, target in zip(rows, targets, strict=True):
        epochs = int(target // r["source_size"]) if r["source_size"] else 0
        rest = round(target) - epochs * r["source_size"]
        plan.append((r["source"], r["source_size"], target, epochs, max(0, rest), r["mean"], max(1, -(-r["n"] // bucket_rows))))
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, epochs long, rest long, mean double, buckets int")

    bucket = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * F.col("buckets")).cast("int"), F.col("buckets") - 1)

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if len(plan) <= MOST_BROADCAST else table

    drawn = slim.join(small(sources), slim["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", bucket)
    # what the buckets before hold; a row for each bucket, and windows over these rows alone
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).where("before < rest AND before + held >= rest")
    met = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in"), "before")
    # the place in that bucket at which the target is met, and what is then open; equal documents have one place
    within = drawn.join(small(met), drawn["source"].eqNullSafe(met["of"]) & (drawn["bucket"] == met["in"]))
    places = within.groupBy("of", "key", "id", "hash").agg(F.sum("size").alias("held"), F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    sofar = Window.partitionBy("of").orderBy("key", "id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = places.withColumn("upto", F.col("before") + F.sum("held").over(sofar)).where("upto >= rest AND upto - held < rest")
    ends, _ = cut(places.select("of", F.struct("key", "id", "hash").alias("end"), (F.col("rest") - F.col("upto") + F.col("held")).alias("open"), "copies"), "ends")

    # structs compare field by field, nulls first, as the window orders them
    drawn = drawn.join(small(ends), drawn["source"].eqNullSafe(ends["of"]), "left").withColumn("place", F.struct("key", "id", "hash"))
    tied = F.coalesce((F.col("place") == F.col("end")) & (F.col("copies") > 1), F.lit(False))
    part = F.when(F.col("place") < F.col("end"), F.col("size")).when(F.col("place") == F.col("end"), F.col("open")).otherwise(F.lit(0))
    if ends.where("copies > 1").isEmpty():
        drawn = drawn.withColumn("part", part)
    else:
        nth = F.row_number().over(Window.partitionBy("source").orderBy("place"))
        equal = drawn.where(tied).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - (nth - 1) * F.col("size"))))
        drawn = drawn.where(~tied).withColumn("part", part).unionByName(equal)
    return drawn.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep or []])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of docs: each document as often as the mix takes it, a part of half or more as the whole, with docs' columns."""
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    known = docs.select(*columns, F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("o"))
    taken = mix(known, id_col="i", text_col="t", source_col="o", keep=[f"c{i}" for i in range(len(docs.columns))])
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return taken.withColumn("_times", times).where("_times > 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.explode(F.sequence(F.lit(1), "_times")).alias("_time")).drop("_time")
