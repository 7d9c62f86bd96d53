"""Sequence and motif functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(seq: Column) -> Column:
    """Upper case, all but A, C, G and T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def gc_fraction(seq: Column) -> Column:
    """Of bases other than N; null without any."""
    s = F.upper(seq)
    known = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    return F.when(known > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / known)


def motif_count(seq: Column, motif: Column) -> Column:
    """Non-overlapping occurrences from the left."""
    return ((F.length(seq) - F.length(F.replace(seq, motif))) / F.length(motif)).cast("int")


def purity(seq: Column, motif: Column) -> Column:
    """The share of bases that agree with the motif repeated from the start."""
    tiled = F.substring(F.repeat(motif, (F.length(seq) / F.length(motif)).cast("int") + 1), F.lit(1), F.length(seq))
    same = F.size(F.filter(F.zip_with(F.split(seq, ""), F.split(tiled, ""), lambda a, b: a == b), lambda x: x))
    return F.when(F.length(seq) > 0, same / F.length(seq))


def is_primitive(motif: Column) -> Column:
    """No power of a shorter motif."""
    n = F.length(motif)
    return ~F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda d: (d < n) & (n % d == 0) & (F.repeat(F.substring(motif, F.lit(1), d), (n / d).cast("int")) == motif))


def is_repetitive(motif: Column, share: float = 0.8) -> Column:
    """Over that share of it is covered by repeats of a prefix of at most half its length."""
    n = F.length(motif)
    return (n >= 2) & F.exists(F.sequence(F.lit(1), F.greatest((n / 2).cast("int"), F.lit(1))), lambda d: motif_count(motif, F.substring(motif, F.lit(1), d)) * d > n * share)


def triplets(seq: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - 2, F.lit(1))), lambda i: F.substring(seq, i, F.lit(3))), lambda t: F.length(t) == 3)


def dust_score(seq: Column) -> Column:
    """10 · Σ c(c−1)/2 over counts of triplets, for each triplet of the sequence but one."""

    def scored(t: Column) -> Column:
        counts = F.transform(F.array_distinct(t), lambda x: F.size(F.filter(t, lambda y: y == x)))
        pairs = F.aggregate(F.transform(counts, lambda c: c * (c - 1) / 2), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(t) > 1, 10.0 * pairs / (F.size(t) - 1)).otherwise(F.lit(0.0))

    # bound once, as lambdas run as written
    return F.get(F.transform(F.array(triplets(seq)), scored), F.lit(0))


def interruptions(seq: Column, period: Column) -> Column:
    """Bases that differ from the most frequent one at their place in the period; 0 for periods of one and sequences shorter than one."""

    def off(chars: Column) -> Column:
        def at(phase: Column) -> Column:
            own = F.filter(chars, lambda c, i: i % period == phase)
            top = F.array_max(F.transform(F.array_distinct(own), lambda b: F.size(F.filter(own, lambda c: c == b))))
            return F.size(own) - top

        return F.aggregate(F.transform(F.sequence(F.lit(0), period - 1), at), F.lit(0), lambda acc, n: acc + n)

    counted = F.get(F.transform(F.array(F.split(seq, "")), off), F.lit(0))
    return F.when((period < 2) | (F.length(seq) < period), F.lit(0)).otherwise(counted)


def whole_motifs(seq: Column, motif: Column) -> Column:
    """(start, end): the part of a repeat from the first to the last place near its ends where the motif stands twice in a row, end exclusive; null without."""
    m, n = F.length(motif), F.length(seq)
    twice, most = F.concat(motif, motif), F.least(3 * m, F.floor(n / 2).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), most), lambda i: (i + 2 * m < n) & (F.substring(seq, i + 1, 2 * m) == twice))
    ends = F.filter(F.sequence(n, n - most, F.lit(-1)), lambda i: (i >= 2 * m) & (F.substring(seq, i - 2 * m + 1, 2 * m) == twice))
    a, b = F.get(starts, F.lit(0)), F.get(ends, F.lit(0))
    return F.when((n > 0) & (a < b), F.struct(a.alias("start"), b.alias("end")))


def projected(ref: Column, offset: Column, span: Column, allele: Column) -> Column:
    """The reference of a group with `span` bases from `offset`, counted from 0, replaced by an allele."""
    return F.concat(F.substring(ref, F.lit(1), offset), allele, F.substring(ref, offset + span + 1, F.length(ref)))


def locus_parts(ref_seq: Column, ref_start: Column, start: Column, end: Column, motif: Column) -> Column:
    """Of a locus' flanked reference: left flank, tract, right flank, and whether the tract is whole copies of the motif. Ends are exclusive."""
    tract = F.substring(ref_seq, (start - ref_start + 1).cast("int"), (end - start).cast("int"))
    return F.struct(
        F.substring(ref_seq, F.lit(1), (start - ref_start).cast("int")).alias("left"),
        tract.alias("tract"),
        F.substring(ref_seq, (end - ref_start + 1).cast("int"), F.length(ref_seq)).alias("right"),
        ((F.length(tract) % F.length(motif) == 0) & (F.replace(tract, motif) == "")).alias("perfect"),
    )


def dust_windows(seq: Column, window: int) -> Column:
    """The sequence in windows of that many bases, one after the other; the last may be shorter."""
    return F.regexp_extract_all(seq, F.lit("(?s).{1,%d}" % window), F.lit(0))
