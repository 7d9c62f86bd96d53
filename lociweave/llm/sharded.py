"""Search structures per shard, met by every block of queries.

Each shard's structure is built once by one task and written to the shared folder. Query blocks are sent to every shard
and stream past it, so a task holds one shard and one block at a time. A shard's blocks are dealt to several tasks in groups,
each with a copy of its structure, so that tasks grow with the product of shards and blocks rather than with shards alone.
Shards are of bounded size; their number grows with the data, and a shard that is lost with its executor is read again from
the written table. Only the Python workers ever hold a whole shard: its rows come to them in Arrow batches, sorted by shard, and its
structure is written, sent and read as PIECE bytes a row, so that the JVM sorts and spills rows of bounded size.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, cut


GROUP_BLOCKS, SHARD_BYTES = 64, 64 << 20
PIECE, ROW_GROUP = 256 << 10, 8 << 20  # a vectorized reader holds a row group of such rows at a time


def shards_for(n: int, row_bytes: int, shard_rows: int, least: int) -> int:
    """The number of shards for n rows: none holds more than shard_rows of them or SHARD_BYTES; few rows are one shard."""
    return max(least, -(-n // max(1, min(shard_rows, SHARD_BYTES // max(1, row_bytes))))) if n > 64 * least else 1


def build(rows: DataFrame, columns: list[str], make: Callable[[dict], object], n_shards: int, label: str) -> DataFrame:
    """rows (shard, *columns) to (shard, piece, blob): make() gets a shard's columns as Arrow arrays, and what it returns is pickled."""
    sorted_rows = rows.select("shard", *columns).repartitionByRange(n_shards, "shard").sortWithinPartitions("shard")

    def pieces(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        blob = cloudpickle.dumps(make({c: own[c].chunk(0) for c in columns}), protocol=5)
        for k in range(0, len(blob), PIECE):
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([k // PIECE], pa.int32()), pa.array([blob[k : k + PIECE]], pa.binary())], names=["shard", "piece", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            begins = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for low, high in zip(begins, begins[1:], strict=False):
                if high == low:
                    continue
                if held and at != shards[low]:
                    yield from pieces(at, held)
                at = int(shards[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from pieces(at, held)

    return cut(sorted_rows.mapInArrow(run, "shard int, piece int, blob binary"), label, ROW_GROUP)[0]


def blocks_of(rows: DataFrame, columns: list[str], block: str) -> DataFrame:
    """rows with a column that names their block to (block, rows)."""
    return rows.groupBy(F.col(block).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def meet(shards: DataFrame, blocks: DataFrame, columns: list[str], search: Callable[[object, dict], Iterator[pa.RecordBatch]], out: str, n_shards: int, label: str, opened: Callable[[object], object] = lambda x: x) -> DataFrame:
    """search(opened(structure), columns of a block) for every block at every shard, cut to the shared folder."""
    spark = shards.sparkSession
    blocks, _ = cut(blocks, label + "-blocks", ROW_GROUP)
    n = blocks.agg(F.max("block")).first()[0]
    n = 0 if n is None else n + 1
    groups = max(1, min(n, max(-(-n // GROUP_BLOCKS), -(-spark.sparkContext.defaultParallelism // n_shards))))
    kind = blocks.schema["rows"].dataType.simpleString()
    task = (F.col("shard") * groups + F.col("group")).cast("long").alias("task")
    to_all = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("group", F.col("block") % groups)
    to_all = to_all.select(task, F.col("block").cast("long").alias("block"), F.lit(0).alias("piece"), F.lit(None).cast("binary").alias("blob"), "rows")
    own = shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(task, F.lit(-1).cast("long").alias("block"), "piece", "blob", F.lit(None).cast(kind).alias("rows"))
    # a shard's structure comes before the blocks that meet it
    stream = to_all.unionByName(own).repartitionByRange(n_shards * groups, "task").sortWithinPartitions("task", "block", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held = None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                task = batch.column(0)[k].as_py()
                if batch.column(1)[k].as_py() < 0:
                    if task != at:
                        shard, at, held = None, task, []
                    held.append(batch.column(3)[k].as_py())
                elif task == at:
                    if held:
                        blob = b"".join(held)
                        held = []
                        shard = opened(cloudpickle.loads(blob))
                        del blob
                    own = batch.column(4)[k].values
                    yield from search(shard, {c: own.field(i) for i, c in enumerate(columns)})

    with arrow_rows(spark, 1):
        return cut(stream.mapInArrow(run, out), label)[0]
