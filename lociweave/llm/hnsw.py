"""Embedding near-duplicates: hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class from the start. Classes are dealt to shards by hash; each shard builds a graph, every class
is a query at every shard, and beams widen for queries whose beam is half full of links; queries whose beam grows so
wide that its steps cost more than all the shard's vectors (by WIDEST) are compared with it whole. Each block of queries is audited at each shard: links of a sample of its queries, found by
brute force, must be among those found, else the base beam of the whole block doubles and the search is repeated; once the beam
would hold the shard, block and shard are compared whole. Candidates are verified by cosine in double precision. A block answers
with each query's number of links and each vector's part of what its links join, so that dense groups are never written out as all
pairs; components unite the parts.

A task holds one shard and one block, both bounded by bytes, and searches and compares at most PAIRS of query and place at a time:
links are counted and united as they come, so that memory does not grow with the number of links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows without
an id, which return a row each, not kept; vectors link only with vectors of their own length; of rows that repeat an id, the
largest array counts and one row is returned; very large and very small components count as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharded import blocks_of, build, meet, shards_for
from .shared import components, cut, split_join

LINKS, BREADTH, SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS = 10, 40, 100_000, 6, 2048
AUDITED = 1 << 21  # pairs compared to audit a block at a shard, if that is more than `audit` queries
BLOCK_BYTES = 1 << 20
PAIRS, WIDEST = 1 << 19, 4  # a beam of b nodes takes in the order of b * b steps


class Graph:
    """A navigable small-world graph over unit vectors; inserts come in batches that double, and searches run many queries at once."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, breadth: int = BREADTH, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 6)
        self.links = links
        order = rng.permutation(n)
        self.layers: list[np.ndarray] = []
        self.row: list[np.ndarray] = []  # of a node in its layer; the last row of a layer stands for nodes that are not on it
        for height in range(int(self.level.max(initial=0)) + 1):
            degree = 2 * links if height == 0 else links
            on = np.flatnonzero(self.level >= height)
            row = np.full(n, len(on), dtype=np.int32)
            row[on] = np.arange(len(on))
            self.row.append(row)
            self.layers.append(np.full((len(on) + 1, 2 * degree), -1, dtype=np.int32))
        self.used = [np.zeros(len(layer), dtype=np.int32) for layer in self.layers]
        self.top: np.ndarray = np.zeros(0, dtype=np.int64)  # nodes where searches begin, all on the highest layer so far
        done = 0
        while done < n:
            batch = order[done : done + max(1, min(done, 1024))]
            self.insert(batch, breadth)
            done += len(batch)

    def __getstate__(self) -> dict:
        """All but the vectors, which are kept beside it."""
        return {k: v for k, v in vars(self).items() if k not in ("x", "used")}

    def insert(self, batch: np.ndarray, breadth: int) -> None:
        peak = int(self.level[self.top].max()) if len(self.top) else -1
        near = {}
        if len(self.top):
            entry = np.repeat(self.top[None, :1], len(batch), axis=0)
            for height in range(peak, -1, -1):
                # only nodes that live on this layer take links here, but all pass through
                found, _ = self.beam(self.x[batch], entry, height, breadth)
                near[height] = found
                entry = found
        sims = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(sims, -np.inf)
        k = min(len(batch) - 1, 2 * self.links)
        mates = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), np.int64)
        for height in range(int(self.level[batch].max()) + 1):
            for row in np.flatnonzero(self.level[batch] >= height):
                node = int(batch[row])
                own = [m for m in batch[mates[row]].tolist() if self.level[m] >= height]
                known = near.get(height, np.zeros((len(batch), 0), np.int64))[row]
                known = known[known >= 0]
                candidates = np.unique(np.array([*known[self.level[known] >= height].tolist(), *own], dtype=np.int64))
                for other in self.diverse(node, candidates, self.links):
                    self.attach(node, int(other), height)
                    self.attach(int(other), node, height)
        highest = int(self.level[batch].max())
        if highest > peak:
            self.top = batch[self.level[batch] == highest][:1]

    def attach(self, node: int, other: int, height: int) -> None:
        layer, used, row = self.layers[height], self.used[height], self.row[height][node]
        at = used[row]
        if other in layer[row, :at]:
            return
        if at == layer.shape[1]:
            kept = self.diverse(node, layer[row].astype(np.int64), layer.shape[1] // 2)
            layer[row] = -1
            layer[row, : len(kept)] = kept
            at = len(kept)
        layer[row, at] = other
        used[row] = at + 1

    def diverse(self, node: int, candidates: np.ndarray, most: int) -> np.ndarray:
        """Candidates closest first, leaving out those closer to a chosen one than to node; then the closest of those left out."""
        if len(candidates) <= most:
            return candidates
        c = self.x[candidates]
        to_node = c @ self.x[node]
        order = np.argsort(-to_node, kind="stable")
        candidates, c, to_node = candidates[order], c[order], to_node[order]
        mutual = c @ c.T
        covered = np.full(len(c), -np.inf, dtype=np.float32)
        chosen = []
        for i in range(len(c)):
            if covered[i] <= to_node[i]:
                chosen.append(i)
                np.maximum(covered, mutual[i], out=covered)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(c)) if i not in taken][: most - len(chosen)]
        return candidates[chosen]

    def beam(self, queries: np.ndarray, entry: np.ndarray, height: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a beam search ends with, and their cosines, best first, -1 where there are fewer; for all queries at once."""
        q, adjacency, row = len(queries), self.layers[height], self.row[height]
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.x) + 1), dtype=bool)  # the last column stands for no node
        nodes = np.full((q, breadth), -1, dtype=np.int64)
        nodes[:, : min(entry.shape[1], breadth)] = entry[:, :breadth]
        sims = np.where(nodes >= 0, np.einsum("qkd,qd->qk", self.x[nodes], queries), -np.inf).astype(np.float32)
        seen[rows, nodes] = True
        open_ = nodes >= 0
        active = np.arange(q)
        while len(active):
            cost = np.where(open_[active], sims[active], -np.inf)
            width = min(4, breadth)
            pick = np.argpartition(-cost, width - 1, axis=1)[:, :width]
            a = active[:, None]
            good = np.take_along_axis(cost, pick, axis=1) > -np.inf
            alive = good.any(axis=1)
            if not alive.all():
                active, pick, good = active[alive], pick[alive], good[alive]
                if not len(active):
                    break
                a = active[:, None]
            open_[a, pick] = False
            heads = np.where(good, nodes[a, pick], -1)
            nb = np.where(heads[:, :, None] >= 0, adjacency[row[heads]], -1).reshape(len(active), -1).astype(np.int64)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[a, nb]] = -1
            seen[a, nb] = True
            some = np.flatnonzero((nb >= 0).any(axis=0))
            nb = nb[:, some] if len(some) < nb.shape[1] else nb
            r, c = np.nonzero(nb >= 0)
            s = np.full(nb.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.x[nb[r, c]], queries[active[r]])
            all_s = np.concatenate([sims[active], s], axis=1)
            all_n = np.concatenate([nodes[active], nb], axis=1)
            all_o = np.concatenate([open_[active], nb >= 0], axis=1)
            best = np.argpartition(-all_s, breadth - 1, axis=1)[:, :breadth]
            sims[active], nodes[active], open_[active] = (np.take_along_axis(z, best, axis=1) for z in (all_s, all_n, all_o))
            open_[active] &= sims[active] > -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, queries: np.ndarray, breadth: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes and cosines on the lowest layer, from the nodes in start (a row for each query) or down from the top."""
        breadth = min(breadth, max(4, len(self.x)))
        out_n, out_s = [], []
        step = max(16, min(512, (1 << 27) // (len(self.x) + 1)))
        for low in range(0, len(queries), step):
            q = queries[low : low + step]
            entry = np.repeat(self.top[None, :1], len(q), axis=0)
            for height in range(int(self.level[self.top].max()), 0, -1) if start is None else ():
                entry, _ = self.beam(q, entry, height, 8)
                entry = entry[:, :4]
            n, s = self.beam(q, entry if start is None else start[low : low + step], 0, breadth)
            out_n.append(n)
            out_s.append(s)
        return np.concatenate(out_n), np.concatenate(out_s)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Links:
    """What a block's queries link with at a shard, counted and united as links come."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, asked: np.ndarray) -> None:
        self.ids, self.copies, self.asked = ids, copies, asked
        self.counts = np.zeros(len(asked), np.int64)
        self.found = np.zeros(len(asked), np.int64)  # the query itself included
        self.names, at = np.unique(np.concatenate([asked, ids]), return_inverse=True)
        self.of_query, self.of_node = at[: len(asked)], at[len(asked) :]
        self.part = np.arange(len(self.names))  # the first name of those that links join, for each

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        self.found += np.bincount(rows, minlength=len(self.asked))
        other = self.asked[rows] != self.ids[cols]
        rows, cols = rows[other], cols[other]
        self.counts += np.bincount(rows, weights=self.copies[cols], minlength=len(self.asked)).astype(np.int64)
        u, v = self.of_query[rows], self.of_node[cols]
        while len(u):
            a, b = self.part[u], self.part[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.part, np.maximum(a, b), np.minimum(a, b))
            while (up := self.part[self.part]).tobytes() != self.part.tobytes():
                self.part = up

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and the first of their part, other than those that are the first themselves."""
        at = np.flatnonzero(self.part != np.arange(len(self.part)))
        return self.names[at], self.names[self.part[at]]


def exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float) -> np.ndarray:
    step = max(1, PAIRS // 8 * 64 // x.shape[1])
    return np.concatenate([np.zeros(0, bool), *[np.einsum("kd,kd->k", q[rows[k : k + step]], x[cols[k : k + step]]) >= least for k in range(0, len(rows), step)]])


def whole(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of links by comparing all with all, in pieces."""
    margin, step = 1e-9, max(1, PAIRS // max(1, len(q)))
    for low in range(0, len(x), step):
        sims = q @ x[low : low + step].T
        rows, cols = np.nonzero(sims >= least - margin)
        near = sims[rows, cols] < least + margin
        good = np.ones(len(rows), bool)
        good[near] = exact(x, q, rows[near], cols[near] + low, least)  # as found by beams
        yield rows[good], cols[good] + low


def linked(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, breadth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of links with cosine of at least `least`, in pieces; x and q are unit vectors in double precision."""
    n, margin = len(x), 1e-5
    q32 = q.astype(np.float32)
    open_ = [(np.arange(len(q)), breadth, None)]
    while open_:
        todo, beam, start = open_.pop()
        if start is not None and beam * beam >= WIDEST * n:
            for rows, cols in whole(x, q[todo], least):
                yield todo[rows], cols
            continue
        if len(todo) > 1 and len(todo) * beam > PAIRS:
            half = len(todo) // 2
            open_ += [(todo[some], beam, None if start is None else start[some]) for some in (slice(half), slice(half, None))]
            continue
        nodes, sims = graph.search(q32[todo], beam, start)
        # links fill half of the beam: there may be more, or some that only places farther out lead to
        full = (sims[:, sims.shape[1] // 2] >= least - margin) & (beam < n)
        r, c = np.nonzero((sims >= least - margin) & ~full[:, None])
        rows, cols = todo[r], nodes[r, c]
        good = exact(x, q, rows, cols, least)
        yield rows[good], cols[good]
        if full.any():
            open_.append((todo[full], min(2 * beam, n), nodes[full]))  # a wider beam goes on from what it holds


def links_of(graph: Graph, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, least: float, breadth: int, recall: float, audit: int) -> Links:
    """A block's links at a shard, as many as the audit asks for."""
    n = len(x)
    sample = np.unique(np.linspace(0, len(q) - 1, min(max(audit, AUDITED // n), len(q))).astype(np.int64))
    true = sum(len(rows) for rows, _ in whole(x, q[sample], least))
    while True:
        out = Links(ids, copies, asked)
        for rows, cols in linked(graph, x, q, least, breadth) if breadth < n else whole(x, q, least):
            out.add(rows, cols)
        if out.found[sample].sum() >= recall * true or breadth >= n:
            return out
        breadth *= 2


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, block_rows: int = BLOCK_ROWS, breadth: int = BREADTH, recall: float = 1.0, audit: int = 256) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector."""
    # floats travel as floats; they are compared as doubles
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    nameless = rows.where("id IS NULL").select("id")
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows, _ = cut(rows.where("id IS NOT NULL").groupBy("id").agg(F.max("v").alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    classes, _ = cut(rows.where("sound").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies")), "classes")

    sizes = [(r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]  # a row for each length
    answers = None
    for d, n in sizes:
        width = (4 if kind == "array<float>" else 8) * d
        shards, of_block = shards_for(n, width, shard_rows, least_shards), max(1, min(block_rows, BLOCK_BYTES // width))
        own = classes.where(F.size("v") == d).withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(shards)).cast("int")).withColumn("block", F.pmod(F.xxhash64("low", F.lit(7)), F.lit(max(1, -(-n // of_block)))))

        def make(c: dict) -> tuple:
            order = np.argsort(c["low"].to_numpy(zero_copy_only=False), kind="stable")
            raw = c["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
            return c["low"].to_numpy(zero_copy_only=False)[order], c["copies"].to_numpy(zero_copy_only=False)[order], raw, Graph(unit(raw.astype(np.float64)))

        def opened(shard: tuple) -> tuple:
            ids, copies, raw, graph = shard
            x = unit(raw.astype(np.float64))
            graph.x = x.astype(np.float32)
            return ids, copies, x, graph

        def search(shard: tuple, c: dict) -> Iterator[pa.RecordBatch]:
            ids, copies, x, graph = shard
            out = links_of(graph, ids, copies, x, c["low"].to_numpy(zero_copy_only=False), unit(matrix(c["v"])), least, breadth, recall, audit)
            some, (a, b) = np.flatnonzero(out.counts), out.joined()
            if len(some):
                none = np.full(len(some), None)
                yield pa.record_batch([pa.array(np.concatenate([out.asked[some], a])), pa.array(np.concatenate([out.counts[some], np.zeros(len(a), np.int64)])), pa.array([*none, *b.tolist()], pa.int64())], names=["a", "links", "b"])

        graphs = build(own.select("shard", "low", "copies", "v"), ["low", "copies", "v"], make, shards, "graphs")
        part = meet(graphs, blocks_of(own.select("block", "low", "v"), ["low", "v"], "block"), ["low", "v"], search, "a bigint, links bigint, b bigint", shards, "links", opened)
        answers = part if answers is None else answers.unionByName(part)
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    alone = alone.unionByName(nameless.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    if answers is not None:
        links = answers.where("b IS NULL").groupBy(F.col("a").alias("low")).agg(F.sum("links").alias("others"))
        stars = components(answers.where("b IS NOT NULL").select("a", "b"))
        of_class = classes.join(links, "low", "left").join(stars.withColumnRenamed("id", "low"), "low", "left")
        of_class, _ = cut(of_class.select("v", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "low").alias("component_id")), "of-class")
        alone = split_join(rows.where("sound").select("id", "v"), of_class, "v", "copies", ["id"]).select("id", "n_links", "component_id").unionByName(alone)
    return alone.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
