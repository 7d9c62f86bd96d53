import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import alignment as A
from lociweave.operators import reads


def aligned(ops, seq, ref):
    q, r, out = 0, 0, []
    for op, n in ops:
        out += [(seq[q + i], ref[r + i]) for i in range(n)] if op == "M" else []
        q += n if op in "MI" else 0
        r += n if op in "MD" else 0
    return out


def test_left_align():
    ref = "GGCACACACATT"
    assert A.left_align([("M", 8), ("D", 2), ("M", 2)], "GGCACACATT", ref) == [("M", 2), ("D", 2), ("M", 8)]
    assert A.left_align([("M", 9), ("I", 2), ("M", 3)], "GGCACACAC" + "AC" + "ATT", ref) == [("M", 2), ("I", 2), ("M", 10)]
    got = A.left_align([("M", 8), ("D", 2), ("M", 2)], "GGCACACATT", ref)
    assert all(a == b for a, b in aligned(got, "GGCACACATT", ref)) and A.left_align(got, "GGCACACATT", ref) == got
    assert A.left_align([("M", 4), ("I", 1), ("M", 4)], "ACGTGACGT", "ACGTACGT") == [("M", 4), ("I", 1), ("M", 4)]


def test_trim_alleles():
    assert A.trim_alleles(["ACGT", "ACT"]) == (1, ["CG", "C"])
    assert A.trim_alleles(["A", "AT"]) == (0, ["A", "AT"]) and A.trim_alleles(["TCA", "TGA"]) == (1, ["C", "G"])


def test_project():
    assert A.project([(1, 1, "TT"), (4, 2, "")], "ACGTACGT") == "ATTGTGT"


def test_baq_trusts_clean_reads_and_not_wrong_indels():
    ref = "GATTACAGGCTTAACCGGATATCCGTAGCTAGGT"
    clean = A.baq([("M", len(ref))], ref, [40] * len(ref), ref, 0)
    assert all(x >= 20 for x in clean[2:-2])
    read = ref[:16] + ref[18:]  # two bases deleted, aligned as a match: the bases after it can't be where they are said to be
    wrong = A.baq([("M", len(read))], read, [40] * len(read), ref, 0)
    right = A.baq([("M", 16), ("D", 2), ("M", len(read) - 16)], read, [40] * len(read), ref, 0)
    assert sum(x == 0 for x in wrong) > 8 and sum(x == 0 for x in right) <= 3
    assert A.baq([("S", 4)], "ACGT", [30] * 4, "ACGT", 0) == [30] * 4


def test_tract_borders():
    left, right = "GATTACAGGCTTAACC", "TTGGCATCGATCCGAA"
    for units in (4, 6, 8):
        read = left[5:] + "CA" * units + right[:11]
        start, end = A.tract_borders(read, left, "CA" * 6, right)
        assert read[start:end] == "CA" * units
    assert A.tract_borders("CA" * 6 + right, left, "CA" * 6, right) is None


def test_forward_sums_over_alignments():
    assert A.forward_log("ACGT", "ACGT") > A.forward_log("ACGT", "ACT") > A.forward_log("ACGT", "TTTTTTTT")
    total = sum(math.exp(A.forward_log("".join(w), "AC")) for k in range(0, 6) for w in itertools.product("ACGT", repeat=k))
    assert 0.5 < total <= 1.3


def test_to_read_and_quartile(spark):
    ops = reads.parse_cigar(F.lit("2S3M1I2M2D3M"))
    at = lambda p: spark.range(1).select(A.to_read(ops, F.lit(10), F.lit(p)).alias("x")).first()["x"]
    assert [at(p) for p in (9, 10, 12, 13, 15, 17)] == [None, 3, 5, 7, None, 9]
    for quals in ([], [10], [20], [10, 20, 20, 20, 20], [10, 10, 20, 20, 20]):
        want = not quals or sorted(quals)[(len(quals) - 1) // 4] >= 15
        assert spark.range(1).select(A.lower_quartile_at_least(F.array(*map(F.lit, quals)).cast("array<int>")).alias("x")).first()["x"] == want


def test_prepare(spark):
    ref = "TTGGCACACACATTGC"
    df = spark.createDataFrame([("GGCACACATT", [40] * 10, ref, 2)], "seq string, qual array<int>, ref_window string, ref_offset int").withColumn("cigar", reads.parse_cigar(F.lit("8M2D2M")))
    row = A.prepare(df).first()
    assert [(x["op"], x["len"]) for x in row["cigar"]] == [("M", 2), ("D", 2), ("M", 8)] and len(row["qual"]) == 10
    assert np.all(np.array(row["qual"]) <= 40)


@pytest.mark.parametrize("ops", [[("M", 0), ("M", 3), ("M", 2)], []])
def test_compact(ops):
    assert A.compact(ops) == ([("M", 5)] if ops else [])
