"""Exact top-k search of binary codes by incremental multi-index hashing, one index per shard.

A code's bits are cut into segments; a shard indexes its codes by each segment's value. A query probes the segments in turn,
first for equal values, then for values one bit away, and so on. After segment s (from 0) of m has been probed out to radius
r, every code not yet met differs by r + 1 bits or more in s + 1 segments and by r or more in the rest, so all codes
within m * r + s bits have been met and verified; the search ends once the kth distance found is no larger. Ties at the kth
distance are then complete too, and the smaller id goes first. Shards answer with k rows per query, merged by a ranking.

Codes are the signs of a vector's components: bit 1 where a component is above zero.

Defined cases: rows whose vector is null or empty or holds nulls or NaN, or whose id is null, are neither queries nor answers;
vectors are compared with those of their own length; of rows that repeat an id the largest array counts; a query is not its
own answer; fewer than k other rows give fewer answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sharded import blocks_of, build, meet, shards_for
from .shared import cut

K, SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS = 10, 1_000_000, 6, 4096


class Index:
    """The codes of a shard, as rows of bits packed to bytes, indexed by each segment's value."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.bits = ids[order], codes[order], bits
        width = int(np.clip(np.log2(max(2, len(ids))), 4, 16))  # about one code for each value
        self.count = max(1, -(-bits // width))
        self.edges = np.linspace(0, bits, self.count + 1).astype(int)
        self.tables = []
        for s in range(self.count):
            value = self.segment(self.codes, s)
            by = np.argsort(value, kind="stable")
            begins = np.searchsorted(value[by], np.arange((1 << self.edges[s + 1] - self.edges[s]) + 1))
            self.tables.append((by, begins))
        widest = int(np.diff(self.edges).max())
        every = np.arange(1 << widest, dtype=np.int64)
        weight = np.bitwise_count(every)
        self.masks = [every[weight == r] for r in range(widest + 1)]

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        bits = np.unpackbits(codes, axis=1, count=self.bits)[:, self.edges[s] : self.edges[s + 1]]
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1])[::-1])

    def nearest(self, ids: np.ndarray, codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, row ids, distances) of the k nearest, for each query."""
        values = [self.segment(codes, s) for s in range(self.count)]
        for q in range(len(ids)):
            met = np.zeros(len(self.ids), dtype=bool)
            rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
            own = np.searchsorted(self.ids, ids[q])
            if own < len(self.ids) and self.ids[own] == ids[q]:
                met[own] = True
            for radius in range(len(self.masks)):
                for s in range(self.count):
                    width = self.edges[s + 1] - self.edges[s]
                    masks = self.masks[radius]
                    probe = values[s][q] ^ masks[masks < 1 << width]
                    by, begins = self.tables[s]
                    low, high = begins[probe], begins[probe + 1]
                    some = high > low
                    low, size = low[some], (high - low)[some]
                    if len(low):
                        at = by[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                        at = at[~met[at]]
                        met[at] = True
                        d = np.bitwise_count(self.codes[at] ^ codes[q]).sum(axis=1, dtype=np.int64)
                        rows, distances = np.concatenate([rows, at]), np.concatenate([distances, d])
                        if len(rows) > k:
                            best = np.lexsort((rows, distances))[:k]  # rows are in order of ids
                            rows, distances = rows[best], distances[best]
                    if len(rows) >= k and distances.max() <= self.count * radius + s:
                        break
                else:
                    continue
                break
            best = np.lexsort((rows, distances))
            yield int(ids[q]), self.ids[rows[best]], distances[best]


def codes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, bits, code): code packs the signs to bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            codes = [np.packbits(flat[e - n : e] > 0).tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary())], names=["id", "bits", "code"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return rows.groupBy("id").agg(F.max("v").alias("v")).mapInArrow(run, "id bigint, bits int, code binary")


def packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other rows of each row that meets the SQL condition `queries` on column id."""
    codes, _ = cut(codes_of(vectors, id_col, vector_col), "codes")
    sizes = [(r["bits"], r["n"], r["q"]) for r in codes.groupBy("bits").agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("q")).collect()]  # a row for each length
    found = None
    for bits, n, asked in sizes:
        shards = shards_for(n, 8 + bits // 8, shard_rows, least_shards)
        own = codes.where(F.col("bits") == bits).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

        def make(c: dict, bits: int = bits) -> Index:
            return Index(c["id"].to_numpy(zero_copy_only=False), packed(c["code"]), bits)

        def search(index: Index, c: dict) -> Iterator[pa.RecordBatch]:
            for q, ids, distances in index.nearest(c["id"].to_numpy(zero_copy_only=False), packed(c["code"]), k):
                if len(ids):
                    yield pa.record_batch([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(distances.astype(np.int32))], names=["query_id", "id", "distance"])

        def gathered(index: Index, c: dict) -> Iterator[pa.RecordBatch]:
            parts = list(search(index, c))
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        blocks = own.where(queries).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, -(-asked // block_rows)))))
        indexes = build(own.select("shard", "id", "code"), ["id", "code"], make, shards, "indexes")
        part = meet(indexes, blocks_of(blocks.select("block", "id", "code"), ["id", "code"], "block"), ["id", "code"], gathered, "query_id bigint, id bigint, distance int", shards, "nearest")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return codes.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")  # k rows from each shard
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")
