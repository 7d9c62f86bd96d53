"""Native span extraction: matches of a pattern with their places, from split() and regexp_extract_all() alone.

Offsets count code points, ends are exclusive. Groups that repeat are possessive in the patterns given here, since
Java's matcher recurses on other repeated groups and very long texts would exhaust its stack.

Work is near linear in a text's length and matches: folds gather what they emit in chunks, parts of a text are taken from blocks
of it rather than counted from its start, and duplicates are found after sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"
CHUNK, BLOCK = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used, as lambdas run as written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, state: str, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(state, item) -> (state, output) puts out for each item from left to right, as array<out>."""
    none, nothing = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def one(acc: Column, item: Column) -> Column:
        now, put = step(acc["s"], item)
        return F.struct(now.cast(state).alias("s"), F.concat(acc["o"], F.array(put)).alias("o"))

    def chunk(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items_, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return bound(inner, lambda x: F.struct(x["s"].alias("s"), F.concat(acc["o"], F.array(x["o"])).alias("o")))

    def whole(bound_items: Column) -> Column:
        nonlocal items_
        items_ = bound_items
        chunks = F.sequence(F.lit(0), F.floor((F.size(items_) - 1) / CHUNK).cast("int"))
        return F.when(F.size(items_) > 0, F.flatten(F.aggregate(chunks, F.struct(start.cast(state).alias("s"), nothing.alias("o")), chunk)["o"])).otherwise(none)

    items_ = items
    return bound(items, whole)


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for part()."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % BLOCK), F.lit(0))


def part(parts: Column, a: Column, b: Column) -> Column:
    """The code points from a to b, exclusive, of the text in these blocks."""
    first = F.floor(a / BLOCK).cast("int")
    covered = F.slice(parts, first + 1, F.greatest(F.floor((b - 1) / BLOCK).cast("int") - first + 1, F.lit(1)))

    def own(block: Column, k: Column) -> Column:
        begin = F.greatest(a - (first + k) * BLOCK, F.lit(0))
        return F.substring(block, begin + 1, F.least(b - (first + k) * BLOCK, F.lit(BLOCK)) - begin)

    return F.when(a < b, F.array_join(F.transform(covered, own), "")).otherwise(F.lit(""))


def spans(text: Column, kind: str, pattern: str, probe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of the pattern in text, as SPAN. probe: a cheap condition that any match implies."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        return end, F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["match"].alias("text"))

    # the last gap has no match after it
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    out = running(F.filter(pairs, lambda p: p["match"].isNotNull()), F.lit(0), "int", SPAN[6:-1], step)
    hit = text.rlike(pattern) if probe is None else probe & text.rlike(pattern)
    return F.when(hit, out).otherwise(F.array().cast(SPAN))


def distinct(items: Column) -> Column:
    """The items in order, each once."""
    return bound(F.array_sort(items), lambda x: F.filter(x, lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(x, i - 1))))


def in_order(all_spans: Column, kinds: list[str]) -> Column:
    """The spans by start, then kind as listed, then end, joined as kind:start:end by commas."""
    keyed = F.transform(
        all_spans,
        lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).cast("int").alias("rank"), s["end"], s["kind"]),
    )
    return F.array_join(F.transform(distinct(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")


def not_over(more: Column, base: Column) -> Column:
    """The spans of more that overlap none of base: none that begins before ends beyond their start, none later begins before their end."""
    kind = "struct<start:int,more:boolean,end:int,kind:string,text:string>"

    def keyed(s: Column, is_more: bool) -> Column:
        return F.struct(s["start"], F.lit(is_more).alias("more"), s["end"], s["kind"], s["text"])

    def forward(end: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["more"], end).otherwise(F.greatest(end, s["end"])), F.struct(s.alias("s"), (s["more"] & (s["start"] >= end)).alias("free"))

    def backward(begin: Column, x: Column) -> tuple[Column, Column]:
        s = x["s"]
        return F.when(s["more"], begin).otherwise(F.least(begin, s["start"])), F.struct(s.alias("s"), (x["free"] & (s["end"] <= begin)).alias("free"))

    both = F.array_sort(F.concat(F.transform(more, lambda s: keyed(s, True)), F.transform(base, lambda s: keyed(s, False))))
    pair = f"struct<s:{kind},free:boolean>"
    left = running(both, F.lit(0), "int", pair, forward)
    right = running(F.reverse(left), F.lit(2**31 - 1), "int", pair, backward)
    free = F.transform(F.filter(F.reverse(right), lambda x: x["free"]), lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["text"].alias("text")))
    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(free)
