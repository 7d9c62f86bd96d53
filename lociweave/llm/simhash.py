"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by exact tiled comparison.

Fingerprints that occur in several documents are one class from the start, so copies are never compared or paired. Classes
are sorted into cells by the population counts of four 16-bit segments; a cell is cut into tiles of at most TILE
fingerprints. Two fingerprints within the radius differ in their four counts by no more than the radius in sum, so a tile
is only met with tiles of cells that near: for all other tile pairs the counts prove that nothing can link. A tile pair
is compared whole by numpy exclusive-or and bit counts, and answers with a spanning forest of its links, not all pairs.

Work on tile pairs grows with the square of the number of distinct fingerprints, at the share of cell pairs in reach
(below 2 % of pairs at radius 2); no link is lost to a cap.

For similarity rather than a given radius, similar_groups() proposes the pairs that fingerprints link and checks each on whole
shingle sets; pairs of the wanted similarity whose fingerprints are farther apart are then found by shared shingles of their
prefixes and checked alike, so that none is missed. The texts that share such a shingle are compared in tiles by numpy, on
parity sketches of their sets that can only understate how many shingles two sets do not share: what a sketch rules out is
below the similarity, and only pairs that it leaves become rows.

Defined cases: null texts count as empty; texts without words have fingerprint zero and link like any other; texts of fewer
words than a shingle are one shingle; ties of a bit (exactly half) give 0; repeated rows keep one output row each; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SHARES, arrow_rows, components, cut, drop_path, likely_among, spanning_forest, split_join

TILE = 4096
SEED = 42
# similar_groups(): texts sampled to order shingles and shingles known as common, turns of forests, a sketch's bits, rows of a tile and
# pairs looked at together; no result depends on them
ORDER_SAMPLE = 8000
HOT_SHINGLES = 100_000
FOREST_TURNS = 2
SKETCH_BITS = 4096
LEAST_TILE = 256
STEP = 1 << 16
PROPOSED_BITS = 3  # fingerprints of near copies that similar_groups() proposes first
TEXTS = 1000  # in an Arrow batch


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unsigned hashes of a text's shingles, in chunks. A-Z are lower-cased; words are runs without space, tab, line feed,
    vertical tab, form feed or carriage return."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return
    plain = b" ".join(words)
    if len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(plain, seed)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, step, hashed = len(words) - shingle + 1, 1 << 16, xxhash.xxh64_intdigest
    for low in range(0, n, step):
        high = min(low + step, n)
        yield np.fromiter([hashed(plain[a:b], seed) for a, b in zip(starts[low:high].tolist(), ends[low + shingle - 1 : high + shingle - 1].tolist(), strict=True)], dtype=np.uint64, count=high - low)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n).view(">u8")[0]) if n else 0


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The text's different shingles by their hashes, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def packed_set(shingles: np.ndarray) -> bytes:
    """A set by 48 bits of its hashes, six bytes each: of two sets of n shingles about n * n / 2^48 look alike that differ."""
    low = np.unique(shingles & np.uint64((1 << 48) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sketch(shingles: np.ndarray) -> bytes:
    """Of a set's hashes, at each place the parity of those that fall there. Two sets' sketches differ at no more places than there are
    shingles that only one of them has. Places are a power of 2, four for a shingle and SKETCH_BITS at most."""
    places = min(SKETCH_BITS, max(64, 1 << (4 * len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, size, sketch): the fingerprint as a signed long, the number of different shingles and their sketch()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            sets = [(len(x), sketch(x)) for x in (shingle_set(t.as_py(), shingle) for t in batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(fp), pa.array([x[0] for x in sets], pa.int32()), pa.array([x[1] for x in sets], pa.binary())], names=["id", "fp", "size", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint, size int, sketch binary")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, size): fp is the fingerprint as a signed long, size is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp), pa.array(np.zeros(len(fp), np.int32))], names=["id", "fp", "size"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint, size int")


def near_cells(radius: int, segments: int, bands: bool) -> list[int]:
    """Differences of cell codes within the radius, other than none, each pair of cells met from one side only."""
    counts = [d for d in itertools.product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    steps = [(band, *d) for band in ((-1, 0, 1) if bands else (0,)) for d in counts]
    zero = (0,) * (segments + 1)
    return sorted(sum(x * 128 ** (segments - k) for k, x in enumerate(d)) for d in steps if d > zero)


def link_classes(classes: DataFrame, radius: int = 2, tile: int = TILE, loose: int | None = None) -> DataFrame:
    """(a, b, sure): links between fingerprints (column fp, distinct) within the radius, thinned to forests within each tile pair.

    With `loose`, fingerprints up to that many bits apart are proposed too (sure is false), one pair for any two parts that
    sure links of the tile pair leave apart; and only classes whose sizes (column size) are within a ratio of 0.8 meet.
    """
    reach, bands = loose or radius, loose is not None
    segments = 4 if reach <= 3 else 2
    # sizes within the ratio are in the same band or in neighbours
    cell = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / float(np.log(1.25))).cast("bigint") if bands else F.lit(0).cast("bigint")
    for k in range(segments):
        width = 64 // segments
        part = F.bit_count(F.shiftrightunsigned(F.col("fp"), 64 - width - width * k).bitwiseAND((1 << width) - 1)).cast("bigint")
        cell = cell * 128 + part  # counts stay below half of 128, so that differences of codes are unique to a step
    sized = classes.select("fp", "size", cell.alias("cell"))
    tiles_of = sized.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    packed = sized.join(tiles_of, "cell").select("cell", part.alias("part"), F.struct("fp", "size").alias("one")).groupBy("cell", "part").agg(F.collect_list("one").alias("fps"))
    packed, _ = cut(packed, "tiles")

    # a pair of tiles is named once: within a cell by parts in order, across cells from the side that near_cells() names
    left = packed.select(F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("fps").alias("a"), F.explode(F.array(*[F.lit(d).cast("bigint") for d in [0, *near_cells(reach, segments, bands)]])).alias("d"))
    left = left.select((F.col("from_cell") + F.col("d")).alias("cell"), "from_cell", "from_part", "a")
    pairs = left.join(packed.withColumnRenamed("fps", "b"), "cell").where("cell <> from_cell OR part >= from_part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, a_size), (b, b_size) = ([batch.column(c)[k].values.field(x).to_numpy(zero_copy_only=False) for x in (0, 1)] for c in (0, 1))
                us, vs, ds = [], [], []
                rows = max(1, (1 << 20) // max(1, len(b)))
                for low in range(0, len(a), rows):
                    d = np.bitwise_count(a[low : low + rows, None].view(np.uint64) ^ b.view(np.uint64)[None, :])
                    i, j = np.nonzero(d <= reach)
                    d = d[i, j]
                    i += low
                    if bands:
                        fit = 5 * np.minimum(a_size[i], b_size[j]) >= 4 * np.maximum(a_size[i], b_size[j])
                        i, j, d = i[fit], j[fit], d[fit]
                    if batch.column(2)[k].as_py():
                        d, i, j = d[i < j], i[i < j], j[i < j]
                    us.append(a[i])
                    vs.append(b[j])
                    ds.append(d)
                if not sum(map(len, us)):
                    continue
                u, v, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
                sure = d <= radius
                kept = [(x, y, True) for x, y in spanning_forest(u[sure], v[sure])]
                if not sure.all():
                    part = parts(kept)
                    open_ = {}
                    for at in np.argsort(d, kind="stable")[sure.sum() :].tolist():
                        x, y = int(u[at]), int(v[at])
                        ends = (part.get(x, x), part.get(y, y))
                        if ends[0] != ends[1]:
                            open_.setdefault((min(ends), max(ends)), (x, y, False))
                    kept += open_.values()
                if kept:
                    yield pa.record_batch([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.bool_())], names=["a", "b", "sure"])

    same = (F.col("cell") == F.col("from_cell")) & (F.col("part") == F.col("from_part"))
    return pairs.select("a", "b", same.alias("same")).mapInArrow(compare, "a bigint, b bigint, sure boolean")


def parts(links: list[tuple[int, int, bool]]) -> dict[int, int]:
    """The part of each id that links name."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for a, b, _ in links:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (fp, low and the rest) with component, the smallest low of the classes that links (a, b) reach, and first, that class's fp."""
    stars = components(links)
    # stars name a class by its fingerprint; the class's smallest id stands for it
    best = F.min(F.when(F.col("low").isNotNull(), F.struct("low", "fp"))).alias("best")
    named = stars.join(classes, stars["id"] == classes["fp"]).groupBy("component").agg(best)
    to = stars.join(named, "component").select(F.col("id").alias("fp"), "best")
    return classes.join(to, "fp", "left").select(*classes.columns, F.coalesce("best.low", "low").alias("component"), F.coalesce("best.fp", "fp").alias("first"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id whose fingerprint links reach, the row's own included."""
    prints, _ = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes, _ = cut(prints.groupBy("fp").agg(F.min("id").alias("low"), F.min("size").alias("size"), F.count("*").alias("copies")), "classes")
    links, _ = cut(link_classes(classes, radius).select("a", "b"), "links")
    joined, _ = cut(joined_classes(classes.select("fp", "low", "copies"), links).select("fp", "component", "copies"), "joined")
    return split_join(prints, joined, "fp", "copies", ["id"]).select(F.col("id").alias(id_col), "fp", "component")


def hot_shingles(reps: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many of a sample of texts share, the most common last. They only set the order in which prefixes are taken:
    the answer is the same for any order, the work is less when common shingles come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch([pa.array(shingle_set(x.as_py(), shingle).view(np.int64))], names=["token"])

    one_in = max(1, reps.count() // ORDER_SAMPLE)
    counted = reps.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "token bigint").groupBy("token").count().where("count > 3")
    with arrow_rows(reps.sparkSession, TEXTS):
        rows = counted.orderBy(F.desc("count"), "token").limit(HOT_SHINGLES).collect()
    return np.array([r["token"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def prefixes(reps: DataFrame, shingle: int, least: Fraction, hot: np.ndarray) -> DataFrame:
    """(token, fp, size, at, hot): of each text's different shingles, in one order for all texts, as many from the front as two sets
    of the similarity cannot both do without; `at` counts from 0, hot is whether the shingle is one of `hot`."""
    by_hash, rank = np.sort(hot), np.argsort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = shingle_set(text.as_py(), shingle)
                if not len(have):
                    continue
                ranked = np.zeros(len(have), np.int64)
                if len(by_hash):
                    place = np.minimum(np.searchsorted(by_hash, have), len(by_hash) - 1)
                    ranked = np.where(by_hash[place] == have, rank[place] + 1, 0)
                    order = np.argsort(ranked, kind="stable")
                    have, ranked = have[order], ranked[order]
                # a partner shares at least ceil(least * n) of them, so that one is among the first n - that + 1
                n = len(have) + int(-least * len(have) // 1) + 1
                yield pa.record_batch([pa.array(have[:n].view(np.int64)), pa.array(np.full(n, fp, np.int64)), pa.array(np.full(n, len(have), np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ranked[:n] > 0)], names=["token", "fp", "size", "at", "hot"])

    return reps.select("fp", "text").mapInArrow(run, "token bigint, fp bigint, size int, at int, hot boolean")


def shared_prefixes(found: DataFrame) -> DataFrame:
    """Of prefixes() the rows whose shingle another text's prefix holds too, and all rows of hot shingles, which several texts have.

    One shuffle by shingle, in which a row looks at its neighbours; hot rows need not look and are spread by a hash of their own.
    """
    alone = F.when(F.col("hot"), F.pmod(F.xxhash64("fp", "at"), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    near = Window.partitionBy("token", "alone").orderBy("fp")
    met = found.withColumn("alone", alone).select("token", "fp", "size", "at", "alone").withColumn("before", F.lag("fp").over(near)).withColumn("after", F.lead("fp").over(near))
    return met.where("alone > 0 OR before IS NOT NULL OR after IS NOT NULL").select("token", "fp", "size", "at")


def differing(flat: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """At how many places the sketches of pairs differ. starts and words, of two rows each, say where in flat the sketches are and how
    long; of unlike lengths, which sizes within the ratio have by a factor of 2 at most, the longer is folded."""
    out, least = np.zeros(words.shape[1], np.int64), words.min(axis=0)
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        step = max(1, (1 << 19) // w)
        for low in range(0, len(at), step):
            some = at[low : low + step]
            x = np.zeros((len(some), w), np.uint64)
            for begins, long in zip(starts[:, some], words[:, some], strict=True):
                x ^= flat[begins[:, None] + np.arange(w)]
                for k in range(1, int(long.max()) // w):
                    more = np.flatnonzero(long > k * w)
                    x[more] ^= flat[begins[more, None] + k * w + np.arange(w)]
            out[some] = np.bitwise_count(x).sum(axis=1)
    return out


def candidates(rows: pa.Table, least: Fraction, forest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): texts that meet in a group of tiled(), are in different parts and may be as similar as `least` by their sizes, by what is
    left of both from the shared shingle on, and by their sketches. rows has whole groups, sorted by group, side and size.

    With `forest` only as many pairs as join all parts that those pairs would join, of each step those with the most alike sketches.
    """
    num, den = least.numerator, least.denominator
    token, tile, crossed, side, fp, size, at, part = (rows.column(c).to_numpy().astype(np.int64) for c in range(8))
    data = pa.concat_arrays(rows.column(8).chunks)
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    flat = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64)
    starts = (ends - ends[0]) // 8
    group = np.cumsum(np.concatenate([[0], (np.diff(token) != 0) | (np.diff(tile) != 0)]))
    # each row looks at the rows after it, or at the other side, whose sizes are within the ratio
    key, other = group * 2 + side << 32 | size, group * 2 + crossed << 32
    first = np.where(crossed, np.searchsorted(key, other | -(-size * num // den)), np.arange(len(size)) + 1)
    counts = np.where(crossed & side, 0, np.maximum(0, np.searchsorted(key, other | size * den // num, side="right") - first))
    of = np.unique(part, return_inverse=True)[1]
    root = np.arange(len(size))
    till, low = np.cumsum(counts), 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(till, (till[low - 1] if low else 0) + STEP, side="right")))
        n = counts[low:high]
        i = np.repeat(np.arange(low, high), n)
        j = np.repeat(first[low:high] - np.cumsum(n) + n, n) + np.arange(len(i))
        low = high
        both = size[i] + size[j]
        fit = (root[of[i]] != root[of[j]]) & (np.minimum(size[i] - at[i], size[j] - at[j]) * (num + den) >= both * num)
        i, j, both = i[fit], j[fit], both[fit]
        far = differing(flat, np.stack([starts[i], starts[j]]), np.stack([np.diff(starts)[i], np.diff(starts)[j]]))
        near = np.flatnonzero(far * (num + den) <= both * (den - num))
        if forest:
            near = near[np.argsort(far[near] / both[near], kind="stable")]
            u, v = root[of[i[near]]], root[of[j[near]]]
            pairs = spanning_forest(u, v)
            place = {}
            for k, x in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
                place.setdefault(x, k)
            near = near[[place[x] for x in pairs]]
            to = np.arange(len(root))
            for x, y in parts([(x, y, True) for x, y in pairs]).items():
                to[x] = y
            root = to[root]
        if len(near):
            a, b = fp[i[near]], fp[j[near]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def tiled(rows: DataFrame) -> DataFrame:
    """rows (token, n, the number of its rows, and the rest) in groups (token, tile) of bounded size: a token of many rows is dealt into
    tiles, any two of which are a group whose sides meet (crossed), and each by itself one of one side."""
    most = min(TILE, max(LEAST_TILE, rows.count() // SHARES))
    k = F.ceil(F.col("n") / most).cast("bigint")
    own = F.pmod(F.xxhash64("fp"), k)
    few = rows.where(k <= 1).withColumns({"tile": F.lit(0).cast("bigint"), "crossed": F.lit(False), "side": F.lit(False)})
    many = rows.where(k > 1).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
    many = many.withColumns({"tile": F.least("own", "other") * k + F.greatest("own", "other"), "crossed": F.col("own") != F.col("other"), "side": F.col("own") > F.col("other")})
    return few.unionByName(many.drop("own", "other"))


def sharing_pairs(now: DataFrame, prints: DataFrame, least: Fraction, forest: bool) -> DataFrame:
    """candidates() of now (token, fp, size, at, part, n), with the sketches of prints (id, sketch)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held else new
            if not held.num_rows:
                continue
            # the last group may go on in the next batch
            token, tile = held.column(0).to_numpy(), held.column(1).to_numpy()
            whole = int(np.argmax((token == token[-1]) & (tile == tile[-1])))
            if whole:
                yield from candidates(held.slice(0, whole), least, forest)
                held = held.slice(whole)
        if held:
            yield from candidates(held, least, forest)

    rows = tiled(now.join(prints.select(F.col("id").alias("fp"), "sketch"), "fp"))
    met = rows.repartition("token", "tile").sortWithinPartitions("token", "tile", "side", "size")
    return met.select("token", "tile", "crossed", "side", "fp", "size", "at", "part", "sketch").mapInArrow(compare, "a bigint, b bigint").distinct()


def similar_pairs(pairs: DataFrame, reps: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Of pairs (a, b) of classes those whose whole shingle sets are as similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                yield pa.record_batch([some.column(0), pa.array([packed_set(shingle_set(x.as_py(), shingle)) for x in some.column(1)], pa.binary())], names=["of", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    asked = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    asked, asked_path = cut(asked, "asked")
    # not a semi-join, which the optimizer would push below the cheaper test and so move all texts; each fp is asked for once
    with arrow_rows(pairs.sparkSession, TEXTS):
        held, path = cut(likely_among(reps.select("fp", "text"), asked, "fp").join(asked, "fp").select("fp", "text").mapInArrow(sets, "of bigint, shingles binary"), "shingles")
    met = pairs.join(held.select(F.col("of").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("of").alias("b"), F.col("shingles").alias("y")), "b")
    with arrow_rows(pairs.sparkSession, 1000):
        verified, _ = cut(met.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"), "verified")
    drop_path(pairs.sparkSession, path)
    drop_path(pairs.sparkSession, asked_path)
    return verified


def fingerprint_pairs(reps: DataFrame, shingle: int, radius: int = PROPOSED_BITS, prints: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of texts (fp names one, text) that join all whose fingerprints links within the radius join. prints: their sketched()."""
    if prints is None:
        with arrow_rows(reps.sparkSession, TEXTS):
            prints, _ = cut(sketched(reps, "fp", "text", shingle), "fingerprints")
    heads, _ = cut(prints.groupBy("fp").agg(F.min("id").alias("head"), F.min("size").alias("size"), F.count("*").alias("copies")), "heads")
    links = link_classes(heads.select("fp", "size"), radius).select("a", "b")
    of_a, of_b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    between = links.join(of_a, "a").join(of_b, "b").select("head_a", "head_b")
    same = split_join(prints.select("id", "fp"), heads.select("fp", "head", "copies"), "fp", "copies", ["id"]).where("id <> head").select("id", "head")
    both = between.union(same)
    return both.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(id, fp, component): component is the smallest id that links of texts sharing at least `least` of their different shingles
    reach, the row's own included; fp names the class of rows with the same text."""
    rows = classed(docs, id_col, text_col)
    return split_join(rows.select("id", "fp"), similar_classes(rows, shingle, least).drop("first"), "fp", "copies", ["id"]).select(F.col("id").alias(id_col), "fp", "component")


def classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, fp): fp names the text, all texts without words being one."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), with_words(text).alias("text"), classed_as(text).alias("fp"))


def with_words(text: Column) -> Column:
    """The text, or an empty one in place of null and of texts without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))


def classed_as(text: Column) -> Column:
    return F.xxhash64(with_words(text))


def similar_classes(rows: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Of rows (id, text, fp): (fp, copies, component, first) for each text: its rows, the smallest id of its group, and the text with that id.

    Pairs that fingerprints link are compared first. Then every pair of that similarity is either compared on whole shingle sets or
    already joined by others that were, or ruled out by sketches: two such sets share a shingle of their prefixes, at places that leave
    room for what they share. First of the pairs that sketches allow so many are compared as would join all, which joins most of large
    groups; then all that these leave apart. Texts without words are one class.
    """
    spark = rows.sparkSession
    ratio = Fraction(str(least))
    reps, reps_path = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.first("text").alias("text"), F.count("*").alias("copies")), "classes")
    classes = reps.select("fp", "low", "copies")
    with arrow_rows(spark, TEXTS):
        prints, prints_path = cut(sketched(reps, "fp", "text", shingle), "fingerprints")
    tried, _ = cut(fingerprint_pairs(reps.select("fp", "text"), shingle, prints=prints), "proposals")
    links = similar_pairs(tried, reps, shingle, ratio)
    hot = hot_shingles(reps, shingle)
    with arrow_rows(spark, TEXTS):
        places, places_path = cut(shared_prefixes(prefixes(reps, shingle, ratio, hot)), "places")

    for turn in range(FOREST_TURNS + 1):
        parts, _ = cut(components(links), "parts")
        now = places.join(parts.select(F.col("id").alias("fp"), F.col("component").alias("part")), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
        apart = now.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n")).where("least < most").select("token", "n")
        now, path = cut(now.join(apart, "token"), "apart")
        pairs = sharing_pairs(now, prints, ratio, turn < FOREST_TURNS)
        pairs, _ = cut(pairs.join(tried, ["a", "b"], "left_anti"), "proposals")
        drop_path(spark, path)
        good = similar_pairs(pairs, reps, shingle, ratio)
        links, tried = links.unionByName(good), tried.unionByName(pairs)
    joined, _ = cut(joined_classes(classes, links).select("fp", "copies", "component", "first"), "joined")
    drop_path(spark, reps_path)
    drop_path(spark, places_path)
    drop_path(spark, prints_path)
    return joined


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of docs for each group of similar_groups(), that with the smallest id, with docs' columns; rows without an id stay.

    Texts that share an id are told apart: of a group's rows with its smallest id those with other texts than the first go like the
    rest, while a text of another group under that id stays. Rows that repeat id and text are one. An empty table stays empty.
    """
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    known = classed(docs.select(*columns, F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t")
    chosen = similar_classes(known, shingle).where("fp = first").select("fp", F.col("component").alias("id"))
    text = F.col(f"c{docs.columns.index(text_col)}")
    named = docs.select(*columns).select("*", classed_as(text).alias("fp"), F.col(f"c{docs.columns.index(id_col)}").cast("bigint").alias("id"))
    kept = named.join(chosen, ["fp", "id"], "left_semi").dropDuplicates(["fp", "id"])
    return kept.unionByName(named.where(F.col("id").isNull())).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
