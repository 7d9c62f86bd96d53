"""Sequence scans: low-complexity masks, tandem repeats and typed regions, as Arrow kernels over contigs or tiles with halos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave import config

CODE = np.full(256, 4, dtype=np.int64)
for _i, _c in enumerate(b"ACGT"):
    CODE[_c] = CODE[_c + 32] = _i


def dust_mask(seq: str, window: int = config.DUST_WINDOW, threshold: int = config.DUST_THRESHOLD) -> list[tuple[int, int]]:
    """Half-open spans, from 0, covered by perfect intervals: those within the window whose score is over the threshold and not below
    that of any part of theirs. Windows end at any base but A, C, G and T."""
    code = CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    if len(code) < 3:
        return []
    triplet = code[:-2] * 16 + code[1:-1] * 4 + code[2:]
    broken = (code[:-2] > 3) | (code[1:-1] > 3) | (code[2:] > 3)
    n = len(triplet)
    # for intervals that begin at a triplet: how often it comes again; for those that end at one: score, highest ratio of any part
    again, score, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1.0)
    spoiled = broken.copy()
    spans = []
    for k in range(1, min(window - 2, n)):  # intervals of k + 1 triplets, all at once
        again[: n - k] += (triplet[: n - k] == triplet[k:]) & ~broken[: n - k]
        score[k:] += again[: n - k]
        spoiled[k:] |= broken[: n - k]
        ratio = np.where(spoiled[k:], -1.0, score[k:] / k)
        part = np.maximum(top[k:], top[k - 1 : -1])
        ends = np.flatnonzero((10 * score[k:] > threshold * k) & ~spoiled[k:] & (ratio >= part))
        spans += [(e, e + k + 3) for e in ends.tolist()]
        top[k:] = np.maximum(ratio, part)
    return merge_spans(spans)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa): half-open spans with their scores."""
    if not len(scores):
        return []
    done: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, int, int]] = []  # start, end, total before, total after
    total = 0
    edges = np.flatnonzero(np.diff(scores > 0)) + 1  # runs of gains and of losses; a run of gains is never cut
    begins = [0, *edges.tolist()]
    sums = np.add.reduceat(scores, begins).tolist()
    for start, end, s in zip(begins, [*begins[1:], len(scores)], sums, strict=True):
        before, total = total, total + s
        if s <= 0:
            continue
        one = (start, end, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= one[2]:
                j -= 1
            if j < 0:  # nothing before can grow any more
                done += [(x, y, hi - lo) for x, y, lo, hi in found]
                found = [one]
                break
            if found[j][3] >= one[3]:
                found.append(one)
                break
            one = (found[j][0], one[1], found[j][2], one[3])
            del found[j:]
    return done + [(x, y, hi - lo) for x, y, lo, hi in found]


def primitive(motif: str) -> bool:
    return all(len(motif) % d or motif != motif[:d] * (len(motif) // d) for d in range(1, len(motif)))


def tandem_repeats(seq: str, periods: tuple[int, int] = config.TANDEM["periods"], match: int = config.TANDEM["match"], mismatch: int = config.TANDEM["mismatch"], min_copies: int = config.TANDEM["min_copies"]) -> list[tuple[int, int, int, int]]:
    """(start, end, period, score), half-open from 0: maximal segments where bases repeat those a period before, of primitive motifs, at
    least so many copies; tracts half covered by one of a dividing period go."""
    s = seq.upper()
    code = CODE[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)]
    found = []
    for p in range(periods[0], periods[1] + 1):
        if len(code) <= p:
            continue
        same = (code[p:] == code[:-p]) & (code[p:] < 4)
        for a, b, score in maximal_segments(np.where(same, match, -mismatch)):
            start, end = a, b + p
            if end - start >= min_copies * p and primitive(s[start : start + p]):
                found.append((start, end, p, score))
    kept, covered = [], {}
    for q in range(periods[0], periods[1] + 1):
        step = np.zeros(len(code) + 1, dtype=np.int64)
        for a, b, p, _ in found:
            if p == q:
                step[a] += 1
                step[b] -= 1
        covered[q] = np.cumsum(step)[:-1] > 0
    for p in range(periods[0], periods[1] + 1):
        under = np.zeros(len(code), dtype=bool)
        for q in range(periods[0], p):
            if p % q == 0:
                under |= covered[q]
        run = np.concatenate([[0], np.cumsum(under)])
        kept += [(a, b, p, score) for a, b, own, score in found if own == p and 2 * (run[b] - run[a]) < b - a]
    return sorted(kept)


def scan(seqs: DataFrame, key: str, seq: str, kernel: str, offset: str | None = None) -> DataFrame:
    """(key, start, end[, period, score]) of a kernel, dust or tandem, for each row; offset shifts a tile's spans to its contig."""
    names = [key, "start", "end"] + (["period", "score"] if kernel == "tandem" else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            shifts = df["_at"] if "_at" in df else [0] * len(df)
            for k, s, at in zip(df[key], df["_s"], shifts, strict=True):
                for span in tandem_repeats(s or "") if kernel == "tandem" else dust_mask(s or ""):
                    rows.append((k, span[0] + at, span[1] + at, *span[2:]))
            yield pd.DataFrame(rows, columns=names)

    kind = seqs.schema[key].dataType.simpleString()
    slim = seqs.select(key, F.col(seq).alias("_s"), *([F.col(offset).alias("_at")] if offset else []))
    return slim.mapInPandas(run, f"{key} {kind}, start long, end long" + (", period int, score int" if kernel == "tandem" else ""))


def tile(contigs: DataFrame, key: str, seq: str, core: int, halo: int) -> DataFrame:
    """(key, tile, offset, core_start, core_end, bases): cores that partition a contig, with halos on either side."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(core))
    t = contigs.select(key, F.col(seq).alias("_s"), F.posexplode(starts).alias("tile", "core_start"))
    low = F.greatest(F.col("core_start") - halo, F.lit(0))
    end = F.least(F.col("core_start") + core, F.length("_s"))
    return t.select(key, "tile", low.cast("long").alias("offset"), F.col("core_start").cast("long"), end.cast("long").alias("core_end"), F.substring("_s", low + 1, end + halo - low).alias("bases"))


def typed_regions(contigs: DataFrame, key: str, seq: str, bundle_gap: int = 30, max_repeat: int = 100) -> DataFrame:
    """(key, start, end, kind), half-open: each contig cut into ssr_segment, ssr_bundle, satellite and generic, without gaps.

    Repeats closer than the gap form a bundle; a single one longer than max_repeat, or a bundle holding one, is a satellite.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for k, s in zip(df[key], df["_s"], strict=True):
                s, at = s or "", 0
                runs: list[list] = []
                for a, b, p, _ in tandem_repeats(s):
                    if runs and a - runs[-1][1] < bundle_gap:
                        runs[-1][1] = max(runs[-1][1], b)
                        runs[-1][2].append((a, b, p))
                    else:
                        runs.append([a, b, [(a, b, p)]])
                for a, b, members in runs:
                    if a > at:
                        rows.append((k, at, a, "generic"))
                    satellite = any(y - x > max_repeat for x, y, _ in members)
                    rows.append((k, a, b, "satellite" if satellite else "ssr_segment" if len(members) == 1 else "ssr_bundle"))
                    at = b
                if at < len(s):
                    rows.append((k, at, len(s), "generic"))
            yield pd.DataFrame(rows, columns=[key, "start", "end", "kind"])

    kind = contigs.schema[key].dataType.simpleString()
    return contigs.select(key, F.col(seq).alias("_s")).mapInPandas(run, f"{key} {kind}, start long, end long, kind string")
