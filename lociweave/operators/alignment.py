"""Alignment kernels: left-alignment, allele trimming, base-alignment quality, tract borders, forward likelihoods.

Kernels are plain numpy over one read; the functions that take DataFrames run them on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gap opening and extension of base-alignment quality, half-width of its band, cap of its qualities.
BAQ_OPEN, BAQ_EXTEND, BAQ_BAND, BAQ_CAP = 1e-3, 0.1, 7, 99
# Gap opening outside and inside a repeat tract, and the bases to either side that count as inside.
TRACT_OPEN_OUT, TRACT_OPEN_IN, TRACT_SLOP = 2.9e-5, 1e-2, 2

Ops = list[tuple[str, int]]


def compact(ops: Ops) -> Ops:
    """Empty operations out, equal neighbours as one."""
    out: Ops = []
    for op, n in ops:
        if n and out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        elif n:
            out.append((op, n))
    return out


def left_align(ops: Ops, seq: str, ref: str, passes: int = 20) -> Ops:
    """Each insertion and deletion moved left through the match before it while the bases stay the same. ref starts at the read's position."""
    ops = compact(ops)
    for _ in range(passes):
        q = r = 0
        for i, (op, n) in enumerate(ops):
            if op in "ID" and i and ops[i - 1][0] == "M" and i + 1 < len(ops) and ops[i + 1][0] == "M":
                room, shift = ops[i - 1][1], 0
                text, at = (seq, q) if op == "I" else (ref, r)
                while shift < room - 1 and text[at - shift - 1] == text[at - shift - 1 + n]:
                    shift += 1
                if shift:
                    ops = compact([*ops[: i - 1], ("M", room - shift), (op, n), ("M", ops[i + 1][1] + shift), *ops[i + 2 :]])
                    break
            q += n if op in "MIS=X" else 0
            r += n if op in "MDN=X" else 0
        else:
            return ops
    return ops


def trim_alleles(alleles: list[str]) -> tuple[int, list[str]]:
    """Common last bases off, then common first ones, at least one base left to each: how far the start moved, and the alleles."""
    cut = 0
    shortest = min(map(len, alleles))
    while cut < shortest - 1 and len({a[len(a) - 1 - cut] for a in alleles}) == 1:
        cut += 1
    alleles = [a[: len(a) - cut] for a in alleles]
    lead, shortest = 0, min(map(len, alleles))
    while lead < shortest - 1 and len({a[lead] for a in alleles}) == 1:
        lead += 1
    return lead, [a[lead:] for a in alleles]


def project(events: list[tuple[int, int, str]], window: str) -> str:
    """A reference window with events (offset, reference bases replaced, bases) put in from the right; of overlapping ones the later in order wins."""
    for offset, n, bases in sorted(events, key=lambda e: -e[0]):
        window = window[:offset] + bases + window[offset + n :]
    return window


def glocal_posteriors(seq: str, qual: list[int], ref: str, band: int = BAQ_BAND) -> tuple[np.ndarray, np.ndarray]:
    """For each base the reference place (from 0) it most probably matches, -1 for an insertion, and the Phred quality of that.

    A pair hidden Markov model, global in the read and local in the reference, forward and backward in a band around the diagonal.
    """
    n, m = len(seq), len(ref)
    width = max(band, abs(m - n) + 3)
    error = 10 ** (-np.asarray(qual, dtype=float) / 10)
    r = np.frombuffer(ref.upper().encode(), np.uint8)
    q = np.frombuffer(seq.upper().encode(), np.uint8)
    stop = 1 / (2 * n + 2)
    mm, mi, md = (1 - 2 * BAQ_OPEN) * (1 - stop), BAQ_OPEN * (1 - stop), BAQ_OPEN * (1 - stop)
    im, ii = (1 - BAQ_EXTEND) * (1 - stop), BAQ_EXTEND * (1 - stop)
    dm, dd = 1 - BAQ_EXTEND, BAQ_EXTEND
    emit = np.where(r[None, :] == q[:, None], 1 - error[:, None], error[:, None] / 3)
    emit[:, r == ord("N")] = 1.0
    emit[q == ord("N")] = 1.0
    k = np.arange(m)
    inside = np.abs(k[None, :] - np.arange(n)[:, None]) <= width
    fm, fi, fd = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
    scale = np.ones(n)

    def run_right(source: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Deletions along the reference: x[k] = md * source[k-1] + dd * x[k-1]."""
        out, last = np.zeros(m), 0.0
        for j in np.flatnonzero(keep):
            last = md * source[j - 1] + dd * last if j else 0.0
            out[j] = last
        return out

    fm[0], fi[0] = emit[0] * inside[0] * (1 - BAQ_OPEN) / m, 0.25 * inside[0] * BAQ_OPEN / m
    scale[0] = fm[0].sum() + fi[0].sum()
    fm[0], fi[0] = fm[0] / scale[0], fi[0] / scale[0]
    for i in range(1, n):
        before = mm * fm[i - 1] + im * fi[i - 1] + dm * fd[i - 1]
        fm[i, 1:] = emit[i, 1:] * before[:-1]
        fi[i] = 0.25 * (mi * fm[i - 1] + ii * fi[i - 1])
        fm[i] *= inside[i]
        fi[i] *= inside[i]
        fd[i] = run_right(fm[i], inside[i])
        scale[i] = fm[i].sum() + fi[i].sum() + fd[i].sum()
        fm[i], fi[i], fd[i] = fm[i] / scale[i], fi[i] / scale[i], fd[i] / scale[i]
    bm, bi = np.full(m, stop), np.full(m, stop)
    bd = np.zeros(m)
    place, quality = np.full(n, -1), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            ahead = np.append(emit[i + 1, 1:] * bm[1:] * inside[i + 1, 1:], 0.0)
            stay = 0.25 * bi * inside[i + 1]
            new_d = np.zeros(m)
            last = 0.0
            for j in np.flatnonzero(inside[i])[::-1]:
                last = dm * ahead[j] + dd * last
                new_d[j] = last
            right = np.append(new_d[1:], 0.0)
            bm, bi, bd = mm * ahead + mi * stay + md * right, im * ahead + ii * stay, new_d
            total = (fm[i] * bm + fi[i] * bi).sum()
            bm, bi, bd = bm / total, bi / total, bd / total
        pm, pi = fm[i] * bm, fi[i] * bi
        total = pm.sum() + pi.sum()
        best_m, best_i = int(pm.argmax()), int(pi.argmax())
        match = pm[best_m] >= pi[best_i]
        top = (pm[best_m] if match else pi[best_i]) / total if total > 0 else 0.0
        place[i] = best_m if match else -1
        quality[i] = min(BAQ_CAP, -10 * math.log10(max(1 - top, 1e-10)))
    return place, quality


def baq(ops: Ops, seq: str, qual: list[int], ref: str, offset: int) -> list[int]:
    """qual capped by how surely each aligned base is where the alignment has it; ref[offset] is at the read's position. Clips stay as they are."""
    first = ops[0][1] if ops and ops[0][0] == "S" else 0
    last = ops[-1][1] if len(ops) > 1 and ops[-1][0] == "S" else 0
    inner, own = seq[first : len(seq) - last], qual[first : len(qual) - last]
    if not inner or not ref or any(op == "N" for op, _ in ops):
        return list(qual)
    place, sure = glocal_posteriors(inner, own, ref)
    out, q, r = list(qual), 0, offset
    for op, n in ops:
        if op in "M=X":
            for _ in range(n):
                out[first + q] = min(own[q], int(sure[q] + 0.499)) if place[q] == r else 0
                q, r = q + 1, r + 1
        elif op == "I":
            q += n
        elif op == "D":
            r += n
    return out


def tract_borders(read: str, left: str, tract: str, right: str, error: float = 0.01) -> tuple[int, int] | None:
    """Where the tract lies in a read that may begin and end in the flanks: the best path of an affine-gap model whose gaps open readily in the
    tract. None where the read does not reach both flanks."""
    ref = left + tract + right
    n, m = len(read), len(ref)
    if not n or not m:
        return None
    r, q = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(read.encode(), np.uint8)
    inside = np.zeros(m + 1, bool)
    inside[max(0, len(left) - TRACT_SLOP) : len(left) + len(tract) + TRACT_SLOP + 1] = True
    gap = np.log(np.where(inside, TRACT_OPEN_IN, TRACT_OPEN_OUT))
    extend, hit, miss = math.log(0.5), math.log(1 - error), math.log(error / 3)
    low = -1e18
    best = np.full((3, n + 1, m + 1), low)
    came = np.zeros((3, n + 1, m + 1), np.int8)
    best[0, 0] = 0.0  # the read may begin anywhere
    for i in range(1, n + 1):
        options = best[:, i - 1, :-1]
        came[0, i, 1:] = options.argmax(axis=0)
        best[0, i, 1:] = options.max(axis=0) + np.where(r == q[i - 1], hit, miss)
        opened, longer = best[0, i - 1] + gap, best[1, i - 1] + extend
        came[1, i] = longer > opened
        best[1, i] = np.maximum(opened, longer) + math.log(0.25)
        for j in range(1, m + 1):
            opened, longer = best[0, i, j - 1] + gap[j - 1], best[2, i, j - 1] + extend
            best[2, i, j], came[2, i, j] = (longer, 2) if longer > opened else (opened, 0)
    state, i, j = 0, n, int(best[0, n].argmax())
    end_of, latest, earliest = j, {}, {}  # read places at each reference place: insertions at a border count as tract
    while i > 0:
        latest.setdefault(j, i)
        earliest[j] = i
        if state == 0:
            state, i, j = int(came[0, i, j]), i - 1, j - 1
        elif state == 1:
            state, i = int(came[1, i, j]), i - 1
        else:
            state, j = int(came[2, i, j]), j - 1
    latest.setdefault(j, i)
    earliest[j] = i
    a, b = len(left), len(left) + len(tract)
    if j >= a or end_of <= b:
        return None
    start, end = earliest.get(a), latest.get(b)
    return None if start is None or end is None else (start, end)


def forward_log(read: str, allele: str, error: float = 0.01, open_: float = TRACT_OPEN_IN, extend: float = 0.5) -> float:
    """The log likelihood of a read given an allele, over all alignments end to end."""
    n, m = len(read), len(allele)
    fm, fi, fd = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    fm[0] = 1.0
    for j in range(1, m + 1):
        fd[j] = open_ * fm[j - 1] + extend * fd[j - 1]
    log = 0.0
    for c in read:
        same = np.array([1 - error if c == x else error / 3 for x in allele])
        nm, ni, nd = np.zeros(m + 1), 0.25 * (open_ * fm + extend * fi), np.zeros(m + 1)
        nm[1:] = same * ((1 - 2 * open_) * fm[:-1] + (1 - extend) * (fi[:-1] + fd[:-1]))
        for j in range(1, m + 1):
            nd[j] = open_ * nm[j - 1] + extend * nd[j - 1]
        s = nm.sum() + ni.sum() + nd.sum()
        if s <= 0:
            return -math.inf
        fm, fi, fd, log = nm / s, ni / s, nd / s, log + math.log(s)
    end = fm[m] + fi[m] + fd[m] if n or not m else fd[m]
    return log + math.log(end) if end > 0 else -math.inf


def to_read(ops: Column, start: Column, ref_pos: Column) -> Column:
    """The place in the read, from 1, of a reference position through a CIGAR (array of operations), or null where it is not aligned."""
    begin = F.struct(start.cast("long").alias("r"), F.lit(1).alias("q"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, op: Column) -> Column:
        both, ref_only = op["op"].isin("M", "=", "X"), op["op"].isin("D", "N")
        here = both & (ref_pos >= acc["r"]) & (ref_pos < acc["r"] + op["len"])
        return F.struct((acc["r"] + F.when(both | ref_only, op["len"]).otherwise(0)).alias("r"), (acc["q"] + F.when(both | op["op"].isin("I", "S"), op["len"]).otherwise(0)).alias("q"), F.when(here, (acc["q"] + ref_pos - acc["r"]).cast("int")).otherwise(acc["at"]).alias("at"))

    return F.aggregate(ops, begin, step)["at"]


def lower_quartile_at_least(quals: Column, least: int = 15) -> Column:
    """Nearest rank; an empty array passes."""
    return (F.size(quals) == 0) | (F.get(F.array_sort(quals), ((F.size(quals) - 1) / 4).cast("int")) >= least)


def prepare(reads: DataFrame, ref: str = "ref_window", offset: str = "ref_offset") -> DataFrame:
    """reads (cigar, seq, qual, and a reference window with the place of the read's position in it) left-aligned, then capped by BAQ."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            cigars, quals = [], []
            for ops, seq, qual, window, at in zip(df["cigar"], df["seq"], df["qual"], df[ref], df[offset], strict=True):
                plain = left_align([("M" if x["op"] in "=X" else x["op"], x["len"]) for x in ops], seq, window[at:])
                cigars.append([{"op": o, "len": n} for o, n in plain])
                quals.append(baq(plain, seq, list(qual), window, at))
            yield df.assign(cigar=cigars, qual=quals)

    return reads.mapInPandas(run, reads.schema)
