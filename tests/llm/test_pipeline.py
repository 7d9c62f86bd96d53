"""The pipeline's stages: on a clean table, and each on tables with nulls, repeats, clashing columns or nothing in them."""

import collections
import hashlib
import math
import re

import brute
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"

from lociweave.llm import mixing, secrets, simhash  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.cut(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before and ids
        if name == "quality":
            assert len(ids & bad) <= 0.2 * len(bad)
        before = ids
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == docs.count()
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in last)


CLASHING = ["_label", "label", "id", "fp", "low", "blob", "_blob", "_found", "findings", "blocks", "score", "size", "key", "c0", "i", "t", "component", "first", "copies", "_parts", "_part", "part", "bucket", "of", "in", "ids", "words", "_ranks"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977} and{i % 13}." for i in range(30_000))
    key = "token = abcdefgh12345678"
    texts = [(1, None), (2, ""), (3, " \n "), (None, "no id here at all, " * 5), (None, None), (4, long), (4, long), (4, f"other text {key} under that id"), (5, f"say {key} twice {key} end"), (5, f"say {key} twice {key} end"), (6, "plain words stand here. " * 9), (7, "plain words stand here. " * 9)]
    rows = [(i, t, ["en", None][k % 2], ["a", None, "b"][k % 3], None if t is None else len(t), *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, DATA)
    rows = out.collect()
    if name != "tokens":
        assert out.columns == odd.columns
        known = {tuple(r[c] for c in CLASHING) for r in odd.collect()}
        assert {tuple(r[c] for c in CLASHING) for r in rows} <= known
    assert stage(spark, odd.where("false"), DATA).count() == 0
    if name == "near_copies":
        # texts without words are a group; each text under id 4 stays once, rows without an id all do
        assert collections.Counter(r["doc_id"] for r in rows) == {1: 1, None: 2, 4: 2, 5: 1, 6: 1}
    if name == "secrets":
        assert len(rows) == odd.count() and {r["text"] for r in rows if r["doc_id"] == 5} == {"say [secret] twice [secret] end"}
        assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows)
    if name == "tokens":
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in odd.collect())


def test_copies_by_the_thousand_are_split(spark):
    rows = [(i, "many copies of this one text here") for i in range(3000)] + [(9000 + i, f"text number {i} of its own kind") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter(r["component"] for r in simhash.similar_groups(docs).collect())
    assert got == {0: 3000, **{9000 + i: 1 for i in range(20)}}
    keyed = docs.withColumn("text", F.when(F.col("doc_id") < 3000, F.lit("token = abcdefgh12345678")).otherwise(F.lit("")))
    assert collections.Counter(len(r["findings"]) for r in secrets.scan_once(keyed).collect()) == {1: 3000, 0: 20}


def test_many_secrets_are_masked_in_time(spark):
    text = " ".join(f"token = secretvalue{i:08d} é" for i in range(20_000))
    out = secrets.without_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert out == " ".join(["[secret] é"] * 20_000)


def plain_mix(rows, seed=mixing.SEED):
    """rows: (id, text, source). id -> words taken, by keys drawn, sorted and summed one after the other."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    held = [sum(sizes[i] for i, _, o in rows if o == s) for s in sources]
    taken = {}
    for s, total, target in zip(sources, held, mixing.reshare(held, [1.0 + k % 3 for k in range(len(sources))], 3), strict=True):
        epochs = int(target // total) if total else 0
        left = max(0, round(target) - epochs * total)
        drawn = []
        for i, t, o in rows:
            if o == s:
                h = hashlib.md5((t or "").encode()).hexdigest()
                u = (int(hashlib.md5(f"{seed}|{i}|{h}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mean = len(t or "") / max(1, sizes[i])
                drawn.append((-math.log(u) / max(0.5, 2.0 - abs(mean - 6.0) / 4.0), i))
        for _, i in sorted(drawn):
            part = min(sizes[i], left)
            left -= part
            taken[i] = epochs * sizes[i] + part
    return taken


def test_mixing_draws_as_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = plain_mix(rows)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, bucket_rows=7).collect()} == want
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    times = collections.Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert times == +collections.Counter({i: int(n / max(1, size[i]) + 0.5) for i, n in want.items()})


def test_near_copies_as_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    roots = brute.closure(list(sets), [(a, b) for a in sets for b in sets if a < b and (not sets[a] and not sets[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))])
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(roots.values())


def test_near_copies_are_proposed_by_fingerprints(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(300)) + f" end{i}") for i in range(30)] + [(100 + i, " ".join(f"v{i}x{k}" for k in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    reps = docs.select(F.col("doc_id").alias("fp"), "text")
    bits = {i: simhash.fingerprint(t, 5) for i, t in rows}
    want = brute.closure(list(bits), [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= simhash.PROPOSED_BITS])
    pairs = [(r["a"], r["b"]) for r in simhash.fingerprint_pairs(reps, 5).collect()]
    assert brute.closure(list(bits), pairs) == want and len(set(want.values())) < 50
    checked, similar_pairs = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, *rest: (checked.append(pairs.count()), similar_pairs(pairs, *rest))[1])
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {0, *range(100, 120)}
    assert checked[0] >= len(pairs) > 0 and checked[-1] == 0


def test_mixing_shuffles_no_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7), "ab"[i % 2]) for i in range(200)] + [(900, "same words here", "c")] * 60 + [(901, "other words here too", "a")] * 40, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "keep_" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]
    size = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    got = mixing.mix(docs, lambda i: [3.0, 1.0, 0.2][i]).collect()
    taken, targets, held = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = "c" if r["doc_id"] == 900 else "a" if r["doc_id"] == 901 else "ab"[r["doc_id"] % 2]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        held[s, r["taken"] % r["size"] > 0] += 1
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
    assert len(got) == 300 and all(taken[s] == round(targets[s]) for s in targets) and all(held[s, True] <= 1 for s in targets)
