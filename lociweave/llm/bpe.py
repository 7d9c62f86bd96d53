"""Byte-level BPE with Spark higher-order functions over the distinct words of a block of documents.

1. An Arrow step splits each text into words by the tokenizer's pattern (white space by its Unicode property), names the
   words of a run of documents by codes and passes each distinct word on once, with the codes of each document; no
   shuffle, and no word is carried twice within a run.
2. Words that a bounded sample shows to be frequent (at most FREQUENT, of about SAMPLE documents) are folded ahead, once.
3. aggregate() folds merges over each distinct word, an array of its bytes' ids: the adjacent pair of lowest rank, the
   leftmost of equals, is merged until none is left. Ranks come from a literal map in the plan: (left id, right id)
   to merged id, kept as a two-level perfect hash in one literal array, as Spark's own maps are searched linearly.
4. A second Arrow step puts the documents together: ids by code, digests, and for decoding the pieces concatenated.

Words and codes of a run stay in one row of bounded size; a run ends after RUN_WORDS words. One document's words always
share a row, so memory follows the longest document. A word of n bytes takes at most n merges, each a pass over its array.
Words of more than LONG_WORD bytes, for which that square counts, are folded in the Arrow step instead, by the same merges
and rank map, all places of the lowest pair in one pass.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows each give a row; an empty table gives an
empty result; other columns are ignored; any Unicode string decodes to its own UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_WORDS, BATCH_TOKENS = 600_000, 200_000
LONG_WORD = 1024  # bytes
SAMPLE, FREQUENT = 20_000, 200_000
WIDTH, PLACES = 17, 28  # bits of an id and of a byte's place in its word
NO_PAIR = 1 << WIDTH + WIDTH + PLACES  # entries from here on have no pair to merge


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the id of their concatenation, for each way to cut a token into two tokens."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def perfect_hash(pairs: dict[tuple[int, int], int]) -> tuple[int, np.ndarray]:
    """The number of buckets, and one table: a shift for each bucket, then each slot's key * 2^WIDTH + merged id.

    A key's bucket is key mod buckets, its slot (key mod slots + the bucket's shift) mod slots.
    """
    keys = np.array([a << WIDTH | b for a, b in pairs], dtype=np.int64)
    values = np.array(list(pairs.values()), dtype=np.int64)
    buckets, slots = max(1, len(keys) // 3) | 1, int(len(keys) * 1.25) | 1
    while True:
        h1, h2 = keys % buckets, keys % slots
        if len(np.unique(h1 * slots + h2)) == len(keys):
            break
        buckets += 2
    shift, slot = [0] * buckets, [-1] * slots
    order = np.argsort(h1, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(h1[order])) + 1) if len(keys) else []
    for group in sorted(groups, key=len, reverse=True):
        base = h2[group].tolist()
        d = 0
        while any(slot[(x + d) % slots] != -1 for x in base):
            d += 1
        shift[int(h1[group[0]])] = d
        for k, x in zip(group, base, strict=True):
            slot[(x + d) % slots] = int(keys[k]) << WIDTH | int(values[k])
    return buckets, np.array(shift + slot, dtype=np.int64)


def plain_pattern(pattern: str) -> str | None:
    """The pattern with each property as the ranges of its code points below 0x10000, for Python's own matcher, which knows no properties
    and is twice as fast; None if it cannot be written so."""
    import regex

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x10000))))
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part[:2] in (r"\p", r"\P"):
            ranges = "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(part.lower()[:3] + part[3:] + "+", every))
            if not ranges or inside and part[1] == "P":
                return None
            part = ranges if inside else f"[{'^' * (part[1] == 'P')}{ranges}]"
        elif part[0] == "\\":
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return "".join(out)


def splitter(pattern: str, plain: str | None) -> Callable[[str], list[str]]:
    """What splits a text into its words; plain: plain_pattern() of the pattern, for texts of code points below 0x10000."""
    import regex

    any_words = regex.compile(pattern).findall
    if plain is None:
        return any_words
    words = re.compile(plain).findall
    return lambda text: (words if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else any_words)(text)


class Tokenizer:
    """The ranks of a vocabulary file and the expression that folds its merges."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        # white space by its Unicode property, whatever a matcher takes for it
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.plain = plain_pattern(self.pattern)
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair_rank = np.full(1 << 16, 1 << WIDTH, dtype=np.int64)  # of two bytes
        for t, r in self.ranks.items():
            if len(t) == 2:
                self.pair_rank[t[0] << 8 | t[1]] = r
        self.buckets, self.table = perfect_hash(pair_ranks(self.ranks))

    def __getstate__(self) -> dict:
        """What workers split and fold words with."""
        return {k: v for k, v in vars(self).items() if k not in ("ranks", "pieces")}

    def merged_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """merged() of arrays."""
        key = left << WIDTH | right
        slots = len(self.table) - self.buckets
        entry = self.table[self.buckets + (key % slots + self.table[key % self.buckets]) % slots]
        return np.where(entry >> WIDTH == key, entry & (1 << WIDTH) - 1, 1 << WIDTH)

    def fold_long(self, word: bytes) -> np.ndarray:
        """The ids of a word: all places of the lowest pair are merged at once, from the left, unless that makes a pair lower still,
        which would come before the places further right; then only the leftmost is."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.merged_of(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) < 1 << WIDTH:
            at = np.flatnonzero(ranks == low)
            # of places that follow each other directly every second one overlaps the one before
            opens = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]) % 2 == 0]
            while True:
                now, pairs = ids.copy(), np.delete(ranks, at)
                now[at] = low
                now = np.delete(now, at + 1)
                places = at - np.arange(len(at))  # of the merged ids
                changed = np.unique(np.concatenate([places - 1, places]))
                changed = changed[(changed >= 0) & (changed < len(pairs))]
                pairs[changed] = self.merged_of(now[changed], now[changed + 1])
                if len(at) == 1 or not len(changed) or pairs[changed].min() >= low:
                    break
                at = at[:1]
            ids, ranks = now, pairs
        return ids

    def literal(self, spark: SparkSession) -> Column:
        """The rank map as one literal array. It is the only value of a literal relation, as plans print each value of an array among
        their expressions, and the driver keeps what they print."""
        values = pa.ListArray.from_arrays(pa.array([0, len(self.table)], pa.int32()), pa.array(self.table))
        return spark.createDataFrame(pa.table({"ranks": values})).scalar()

    def merged(self, table: Column, left: Column, right: Column) -> Column:
        """The id of the two ids' concatenation, which is also the pair's rank, or 2^WIDTH. No part is named twice that is costly, as lambdas run as written."""
        key = left * (1 << WIDTH) + right
        slots = len(self.table) - self.buckets
        shift = F.get(table, (key % self.buckets).cast("int"))
        entry = F.get(table, (self.buckets + (key % slots + shift) % slots).cast("int"))
        # entry less key * 2^WIDTH is the merged id if the slot holds this key, else negative or out of an id's range
        return F.least((entry - key * (1 << WIDTH)).bitwiseAND((1 << 63) - 1), F.lit(1 << WIDTH).cast("bigint"))

    def fold_words(self, rows: DataFrame, words: str) -> DataFrame:
        """rows with, in place of the column of words given as entries for their bytes, the ids of each; the rank map is bound once for all of them."""
        with_ranks = rows.withColumn("_ranks", self.literal(rows.sparkSession))
        # an array that transform() made holds its numbers as objects, which lookups then share rather than make
        held = F.array(F.transform("_ranks", lambda x: x))
        folded = F.get(F.transform(held, lambda table: F.transform(words, lambda w: self.fold(table, w))), F.lit(0))
        return with_ranks.select(*[folded.alias(c) if c == words else F.col(c) for c in rows.columns])

    def fold(self, table: Column, entries: Column) -> Column:
        """The ids of a word given as an entry for each byte: the rank of the pair it begins, its place, its id.

        An entry is rank * 2^(PLACES + WIDTH) + place * 2^WIDTH + id, so that the smallest entry begins the pair to merge,
        the leftmost of the lowest rank. Places are those in the array and move up by one after a merge, so that none is searched.
        """

        def id_of(x: Column) -> Column:
            return x.bitwiseAND((1 << WIDTH) - 1)

        def step(acc: Column, _: Column) -> Column:
            def merge(x: Column) -> Column:
                j, merged = x["j"], F.shiftright(x["low"], WIDTH + PLACES)
                following = F.get(acc, j + 1)
                here = F.when(following.isNull(), F.lit(1 << WIDTH).cast("bigint")).otherwise(self.merged(table, merged, id_of(following)))
                here = here * (1 << WIDTH + PLACES) + x["low"].bitwiseAND((1 << PLACES) - 1 << WIDTH) + merged

                def renewed(e: Column, i: Column) -> Column:
                    before = self.merged(table, id_of(e), merged) * (1 << WIDTH + PLACES) + e.bitwiseAND((1 << WIDTH + PLACES) - 1)
                    return F.when(i < j - 2, e).when(i > j, e - (1 << WIDTH)).when(i == j - 1, here).when(i == j, F.lit(None)).otherwise(before)

                return F.filter(F.transform(acc, renewed), lambda e: e.isNotNull())

            low = F.array_min(acc)
            found = F.struct(low.alias("low"), (F.shiftright(low, WIDTH).bitwiseAND((1 << PLACES) - 1) + 1).cast("int").alias("j"))
            return F.when(low < NO_PAIR, F.get(F.transform(F.array(found), merge), F.lit(0))).otherwise(acc)

        return F.transform(F.when(F.array_min(entries) >= NO_PAIR, entries).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(entries)), entries, step)), id_of)


BLOCK = "doc_ids array<bigint>, lengths array<int>, codes binary, words array<array<bigint>>"


def entries_of(words: list[str], tokenizer: "Tokenizer") -> pa.ListArray:
    """Each word's bytes as the entries that the fold starts from, or a long word's ids as entries without a pair to merge."""
    of_byte, pair_rank = tokenizer.of_byte, tokenizer.pair_rank
    long = {i: tokenizer.fold_long(w.encode()) for i, w in enumerate(words) if 4 * len(w) > LONG_WORD and len(w.encode()) > LONG_WORD}
    if long:
        short = entries_of([w for i, w in enumerate(words) if i not in long], tokenizer)
        each = iter(short)
        return pa.array([NO_PAIR | long[i] if i in long else next(each).values.to_numpy() for i in range(len(words))], pa.list_(pa.int64()))
    raw = pa.array(words, pa.string()).cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[: len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]]
    rank = np.full(len(data), 1 << WIDTH, dtype=np.int64)
    rank[:-1] = pair_rank[data[:-1].astype(np.int64) << 8 | data[1:]]
    rank[ends[1:] - 1] = 1 << WIDTH  # a word's last byte begins no pair; words are never empty
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank << WIDTH + PLACES | place << WIDTH | of_byte[data]))


def name_words(tokenizer: "Tokenizer", known, run_words: int):
    """Batches of (id, text) to rows of BLOCK: ids and word counts of documents, their words as codes, each new distinct word once, as entries.

    known: a broadcast of frequent_words(), whose words have codes already, in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in = splitter(tokenizer.pattern, tokenizer.plain)
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.list_(pa.int64())))])
        # the codes of words, those known first; it gives the next code to each other word that it is asked for
        table: defaultdict[str, int] = defaultdict(None, {w: i for i, w in enumerate(known_words(known.value))})
        table.default_factory = table.__len__
        first, ids, lengths, codes, held = len(table), [], [], [], 0

        def block() -> pa.RecordBatch:
            words = list(itertools.islice(table, first, None))
            for w in words:  # rather than a copy of the known ones for each run
                del table[w]
            new = entries_of(words, tokenizer)
            whole = np.concatenate(codes).tobytes() if codes else b""
            return pa.record_batch([pa.array([ids], schema[0].type), pa.array([lengths], schema[1].type), pa.array([whole], schema[2].type), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_in(text.as_py() or "")
                own = np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words))
                ids.append(i)
                lengths.append(len(own))
                codes.append(own)
                held += len(own)
                if held >= run_words:
                    yield block()
                    ids, lengths, codes, held = [], [], [], 0
        if ids:
            yield block()

    return run


def frequent_words(docs: DataFrame, tokenizer: "Tokenizer", text_col: str, sample: int, words: int) -> list[bytes]:
    """At most `words` words that are frequent in a sample of about `sample` documents, with their ids, as Arrow tables.

    What is frequent saves work only: such words are folded once rather than in each run. The result does not depend on it.
    """
    n = docs.count()
    pattern, plain = tokenizer.pattern, tokenizer.plain
    some = docs.select(F.col(text_col).alias("text")).where(F.length(text_col) < 1 << 20)
    some = some.sample(min(1.0, sample / n), seed=1) if n else some

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, counts = splitter(pattern, plain), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_in(text.as_py() or ""))
        # also what is once here: over all tasks it may be among the frequent
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(low, 2000)
                one = entries_of(part.to_pylist(), tokenizer)
                yield pa.record_batch([pa.array([part.to_pylist()], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)], names=["words", "entries"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).flatten()
            known = pa.record_batch([batch.column(0).flatten(), pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.int32()))], names=["word", "ids"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, known.schema) as stream:
                stream.write_batch(known)
            yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["known"])

    top = some.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(words)
    # dealt out again, as a limit leaves one partition
    dealt = top.select("word").repartition(12).mapInArrow(entries, "words array<string>, entries array<array<bigint>>")
    return [bytes(r["known"]) for r in tokenizer.fold_words(dealt, "entries").mapInArrow(pack, "known binary").collect()]


def known_words(known: list[bytes]) -> list[str]:
    """The words of what frequent_words() returns."""
    return [w for x in known for w in pa.ipc.open_stream(x).read_all().column(0).to_pylist()]


def known_ids(known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of those words, and each one's number of ids."""
    ids = [c for x in known for c in pa.ipc.open_stream(x).read_all().column(1).chunks]
    flat, sizes = ([f(c).to_numpy(zero_copy_only=False) for c in ids] for f in (pa.ListArray.flatten, pa.ListArray.value_lengths))
    none = [np.zeros(0, np.int32)]
    return np.concatenate(none + flat), np.concatenate(none + sizes)


OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def ids_of_blocks(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """For some documents of each block at a time: their ids, all token ids, and where each document's begin and end."""
    for k in range(batch.num_rows):
        docs, lengths = batch.column(0)[k].values.to_pylist(), batch.column(1)[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer(batch.column(2)[k].as_buffer(), dtype=np.int32)
        folded = batch.column(3)[k].values
        flat, sizes = known
        if len(folded):
            flat = np.concatenate([flat, folded.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
            sizes = np.concatenate([sizes, folded.value_lengths().to_numpy(zero_copy_only=False)])
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        places = np.concatenate([[0], np.cumsum(lengths)])
        low = 0
        while low < len(docs):
            high = max(low + 1, int(np.searchsorted(places, places[low] + BATCH_TOKENS // 2, side="right")) - 1)
            high = min(high, low + 1024, len(docs))
            own = codes[places[low] : places[high]]
            each = sizes[own]
            ends = np.concatenate([[0], np.cumsum(each)])
            tokens = flat[np.repeat(begins[own] - ends[:-1], each) + np.arange(ends[-1])]
            yield docs[low:high], tokens, ends[places[low : high + 1] - places[low]]
            low = high


def put_together(pieces: list[bytes], known, with_ids: bool, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = [str(i) for i in range(len(pieces))]
        frequent = known_ids(known.value)
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_decoded
        for batch in batches:
            for docs, tokens, bounds in ids_of_blocks(batch, frequent):
                rows = []
                for d in range(len(docs)):
                    ids = tokens[bounds[d] : bounds[d + 1]].tolist()
                    decoded = b"".join(map(pieces.__getitem__, ids))
                    row = (docs[d], len(ids), hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append(row + (decoded.decode("utf-8", "replace"),) * with_decoded)
                columns = [pa.array(c, fields[i][1]) for i, c in enumerate(zip(*[r[:4] for r in rows], strict=True))]
                columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens, pa.int32()))] * with_ids
                columns += [pa.array([r[4] for r in rows], pa.string()) for _ in range(with_decoded)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return run


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False, run_words: int = RUN_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes; with_ids and with_decoded add the ids and the decoded text."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_words(docs, tokenizer, text_col, SAMPLE, frequent))
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    blocks = slim.mapInArrow(name_words(tokenizer, known, run_words), BLOCK)
    folded = tokenizer.fold_words(blocks, "words")
    out = OUT + ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return folded.mapInArrow(put_together(tokenizer.pieces, known, with_ids, with_decoded), out).withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text bytes): the binary pieces of the ids, concatenated. Null ids count as none."""
    pieces = tokenizer.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([b"".join([pieces[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id bigint, bytes binary").withColumnRenamed("id", id_col)


def public_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path(name), public_tokenizers.PATTERN)
