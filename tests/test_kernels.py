"""Kernels and expressions against plain versions and known values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave import config
from lociweave.functions import sequence, stats
from lociweave.functions.genotypes import genotype_order
from lociweave.operators import cohort, genotyping, intervals, paralog, reads, scan, ssr


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x", [1e-12, 0.3, 0.5, 1.0, 2.5, 40.0, 1e5])
def test_lgamma(spark, x):
    assert one(spark, stats.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_genotype_order():
    assert genotype_order(2, 3) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_binomial_tail(spark):
    n, p = 12, 0.3
    pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for k in range(n + 1):
        want = sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7))
        assert one(spark, stats.binomial_tail(F.lit(k), F.lit(n), F.lit(p))) == pytest.approx(min(1, want), rel=1e-6)


def test_single_weak_alt_is_reference():
    cohort_ll = np.array([[0.0, -3.0, -30.0]] * 20 + [[-4.0, -2.5, -20.0]])
    got = genotyping.em_locus(cohort_ll, np.array([10.0, 0.01]))
    assert got["best"].tolist() == [0] * 21 and got["converged"]


def test_clear_carriers_are_called():
    ll = np.array([[0.0, -10.0, -80.0]] * 6 + [[-60.0, -5.0, -60.0]] * 3 + [[-90.0, -12.0, 0.0]])
    got = genotyping.em_locus(ll, np.array([10.0, 0.01]))
    assert got["best"].tolist() == [0] * 6 + [1] * 3 + [2]
    assert got["qual"] > 100 and np.allclose(got["posteriors"].sum(axis=1), 1)
    assert genotyping.em_locus(np.zeros((1, 3)), np.array([10.0, 0.01]))["best"].tolist() == [0]


def test_prune_unused():
    kept, freq, post, best = genotyping.prune_unused([0.5, 0.3, 0.2], [[0.1, 0.0, 0.0, 0.8, 0.0, 0.1]], [3])
    assert kept == [0, 2] and freq == pytest.approx([5 / 7, 2 / 7]) and best == [1] and sum(post[0]) == pytest.approx(1)


def test_maximal_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-7, 2, 2, 2]) for _ in range(rng.randint(0, 25))]

        def best(low, high, s=s):
            spans = [(sum(s[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)]
            top = max((x for x in spans if x[0] > 0), default=None)
            if not top:
                return []
            total, size, a = top[0], -top[1], -top[2]
            return best(low, a) + [(a, a + size, total)] + best(a + size, high)

        assert sorted(scan.maximal_segments(np.array(s))) == best(0, len(s))


def test_tandem_repeats():
    assert (4, 14, 2, 16) in scan.tandem_repeats("GGTACACACACACATTG"[0:4].replace("TA", "TG") + "CACACACACA" + "TTG")
    assert scan.tandem_repeats("") == [] and scan.tandem_repeats("ACGT") == []
    assert all(p != 4 for _, _, p, _ in scan.tandem_repeats("ACACACACACACACAC"))


def perfect(seq, window, threshold):
    out = []
    n = len(seq)

    def ratio(a, b):
        t = [seq[i : i + 3] for i in range(a, b - 2)]
        return sum(c * (c - 1) / 2 for c in (t.count(x) for x in set(t))) / (len(t) - 1) if len(t) > 1 else 0.0

    for a, b in itertools.combinations(range(n + 1), 2):
        if 4 <= b - a <= window and ratio(a, b) * 10 > threshold and all(ratio(c, e) <= ratio(a, b) for c in range(a, b) for e in range(c + 4, b + 1)):
            out.append((a, b))
    return scan.merge_spans(out)


def test_dust_against_definition():
    rng = random.Random(2)
    for _ in range(25):
        s = "".join(rng.choice("ACGT") for _ in range(8)) + rng.choice(["A", "AC", "ACG"]) * 6 + "".join(rng.choice("ACGT") for _ in range(8))
        assert scan.dust_mask(s, 16) == perfect(s, 16, config.DUST_THRESHOLD)
    assert scan.dust_mask("") == [] and scan.dust_mask("AC") == []


def test_typed_regions_partition(spark):
    seq = "ACGTTGCAAGCTTAGC" * 2 + "CA" * 12 + "GATTGCCTAGGCTTAACGGATC" * 2
    rows = scan.typed_regions(spark.createDataFrame([(1, seq), (2, ""), (3, None)], "k int, s string"), "k", "s").orderBy("k", "start").collect()
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(seq)
    assert all(a["end"] == b["start"] for a, b in itertools.pairwise(rows)) and {r["k"] for r in rows} == {1}


def test_cigar(spark):
    got = one(spark, reads.parse_cigar(F.lit("3S10M2I5D4M")))
    assert [(x["op"], x["len"]) for x in got] == [("S", 3), ("M", 10), ("I", 2), ("D", 5), ("M", 4)]
    assert one(spark, reads.bad_cigar(reads.parse_cigar(F.lit("3S10M2I5D4M"))))
    assert one(spark, reads.bad_cigar(reads.parse_cigar(F.lit("3S2D10M"))))
    assert not one(spark, reads.bad_cigar(reads.parse_cigar(F.lit("3S10M2I4M2D3M"))))
    assert one(spark, reads.reference_span(reads.parse_cigar(F.lit("3S10M2I5D4M")))) == 19


def test_events(spark):
    df = spark.createDataFrame([("r", 100, "ACGTAC", [30, 20, 10, 40, 35, 25])], "id string, pos long, seq string, qual array<int>")
    rows = reads.events(df.withColumn("cigar", reads.parse_cigar(F.lit("2M1I2M2D1M")))).orderBy("ref_pos", "kind").collect()
    assert [(r["kind"], r["ref_pos"], r["bases"], r["bq"]) for r in rows] == [("match", 100, "A", 30), ("insertion", 101, "G", 10), ("match", 101, "C", 20), ("match", 102, "T", 40), ("deletion", 103, "", 25), ("match", 103, "A", 35), ("match", 106, "C", 25)]


def test_group_wider_than_allowed_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 50, True), (1, 40, 120, False)], "c int, start long, end long, v boolean")
    assert intervals.variant_groups(df, ["c"], "start", "end", "v", 200).count() == 2
    with pytest.raises(Exception, match="spans more than 100"):
        intervals.variant_groups(df, ["c"], "start", "end", "v", 100).collect()


def test_late_positions_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 4)], "c int, n int, pos long")
    with pytest.raises(Exception, match="out of order"):
        intervals.in_order(df, ["c"], "n", "pos").collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "c int, start long, end long, v boolean")
    assert intervals.union(empty, ["c"], "start", "end").count() == 0
    assert intervals.drop_bundles(empty, ["c"], "start", "end", 5).count() == 0
    assert cohort.compounds(spark.createDataFrame([], "s int, k int, p int, a string"), "s", "k", "p", "a").count() == 0


def test_motifs(spark):
    assert one(spark, sequence.is_primitive(F.lit("AC"))) and not one(spark, sequence.is_primitive(F.lit("ACAC")))
    assert one(spark, sequence.is_repetitive(F.lit("AAAAA"))) and not one(spark, sequence.is_repetitive(F.lit("ACGTT")))
    assert one(spark, sequence.purity(F.lit("CACACT"), F.lit("CA"))) == pytest.approx(5 / 6)
    assert one(spark, sequence.gc_fraction(F.lit("GCAN"))) == pytest.approx(2 / 3)
    assert one(spark, sequence.canonical(F.lit("acgtRn"))) == "ACGTNN"


def test_paralog_ratio_signs():
    n = 20
    plain = paralog.locus_ratio([0] * 15 + [10] * 5, [20] * 15 + [10] * 5, [1.0] * n, [0.0] * n, [0.15] * n)
    hidden = paralog.locus_ratio([10] * n, [30] * n, [2.0] * n, [0.0] * n, [0.15] * n)
    assert plain < 0 < hidden and math.isnan(paralog.locus_ratio([0], [0], [1.0], [0.0], [0.1]))


def test_ssr_genotypes():
    got = ssr.genotype_em(np.array([9, 10, 11, 12, 13, 14]), np.array([[1, 20, 1, 0, 0, 0], [0, 10, 0, 0, 0, 10], [0, 0, 0, 0, 1, 18]]), np.array([10, 14]))
    assert list(zip(got["first"].tolist(), got["second"].tolist(), strict=True)) == [(10, 10), (10, 14), (14, 14)]


def test_fixed_point_sum_ignores_order(spark):
    df = spark.range(1000).select(((F.col("id") % 7) * 0.1 + F.col("id") * 1e-9).alias("x"))
    sums = {df.repartition(n).agg(stats.ordered_sum(F.col("x"))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1


def test_complement_of_spans_beyond_the_contig(spark):
    from lociweave.operators import intervals

    spans = [("a", 95, 130), ("a", 100, 140), ("a", 150, 160), ("a", -5, 3), ("b", 20, 20), ("c", 1, 10), ("d", 11, 30)]
    lengths = spark.createDataFrame([("a", 100), ("b", 20), ("c", 10), ("d", 10)], "contig string, length long")
    got = intervals.complement(spark.createDataFrame(spans, "contig string, start long, end long"), lengths, ["contig"], "start", "end", "length")
    assert sorted(map(tuple, got.collect())) == [("a", 4, 94), ("b", 1, 19), ("d", 1, 10)]


def test_integers_of_variable_length(spark):
    from pyspark.sql import functions as F

    from lociweave.functions import encoding

    numbers = [0, -1, 1, 63, -64, 64, 300, 2**31, -(2**40), 2**62, -(2**63)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", encoding.leb128(encoding.zigzag(F.col("n"))).alias("b")).withColumn("back", encoding.unzigzag(encoding.from_leb128(F.concat("b", F.lit("ff00"))))).collect()
    assert [r["back"] for r in rows] == numbers and [r["b"] for r in rows[:4]] == ["00", "01", "02", "7e"]
    assert encoding.parse_floors("6, 4,4,3,3,3") == [6, 4, 4, 3, 3, 3]
    for bad in ("6,4", "6,4,4,3,3,x"):
        try:
            encoding.parse_floors(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
