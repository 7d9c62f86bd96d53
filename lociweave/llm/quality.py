"""Quality by hierarchical empirical Bayes: a document classifier's evidence, moved by what its host and path are like.

A logistic regression on text features, fitted on at most SAMPLE labelled rows, gives each document a probability. Beta priors
then shrink: a path's posterior towards its host's, a host's towards the global mean, the more so the fewer documents they
have. The priors' strengths come from the spread of group means over what sampling alone would give. A document's score
is its own log-odds plus those of its path's posterior less the global ones; its own probability is first taken out of its path's
and host's sums, so that evidence counts once.

Sums are grouped aggregates that combine map-side, over all documents. The group tables are broadcast only where they have
at most BROADCAST rows; beyond, adaptive execution splits the join on large hosts.

Defined cases: null texts count as empty and have the features of an empty text; null hosts or paths are groups of their own;
repeated ids are scored row by row; without labels of both kinds the classifier answers the labels' base rate; an empty table
gives an empty result; other columns are kept where asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import Model, fit, labelled_sample
from .shared import arrow_rows, cut

SAMPLE, BROADCAST = 20_000, 50_000
TEXTS = 1000  # in an Arrow batch
FEATURES = 12


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * (FEATURES - 1) + [1.0]
    letters = len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", text))
    marks = len(re.findall(r"[^\w\s.,;:'\"()-]", text))
    digits = len(re.findall(r"\d", text))
    counts = Counter(words)
    lines = text.split("\n")
    pairs = set(zip(words, words[1:], strict=False))
    ends = sum(x[-1] in ".!?" for x in words)
    return [
        upper / max(1, letters),
        marks / n,
        digits / n,
        letters / n,
        len(counts) / w**0.8,
        max(counts.values()) / w,
        len(pairs) / max(1, w - 1),
        sum(map(len, words)) / w,
        ends / w,
        len(set(lines)) / len(lines),
        np.log1p(w),
        0.0,
    ]


def with_features(docs: DataFrame, columns: list[str], text_col: str, model: Model | None = None) -> DataFrame:
    """The columns and features (array<double>), or, given a model, its log-odds (logit)."""
    slim = docs.select(*columns, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(len(columns))], dtype=np.float64).reshape(-1, FEATURES)
            last = pa.array(model.logits(x)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[: len(columns)], last], names=[*columns, "logit" if model else "features"])

    out = slim.select(*columns, (F.lit(0.0) if model else F.array().cast("array<double>")).alias("logit" if model else "features")).schema
    return slim.mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    with arrow_rows(docs.sparkSession, TEXTS):
        rows = with_features(labelled_sample(docs, labels, label, sample, id_col, text_col), ["label"], "text").collect()
    return fit(np.array([r["features"] for r in rows]).reshape(-1, FEATURES), np.array([r["label"] for r in rows], dtype=np.float64))


def strength(groups: DataFrame, mean: Column | float) -> float:
    """The beta prior's pseudo-count by moments, from groups of n documents with sum s of probabilities."""
    m = F.lit(mean) if isinstance(mean, float) else mean
    r = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, F.lit(2.0))).alias("between"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.count("*").alias("k")).first()
    if not r["k"] or not r["n"]:
        return 100.0
    noise = max(r["within"], 1e-9) / max(1, r["n"] - r["k"])  # of one document
    extra = max(0.0, (r["between"] - r["k"] * noise) / r["n"])  # of a group's mean beyond noise
    return float(np.clip(noise / extra if extra > 0 else 1e6, 1.0, 1e6))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """(id, document, host, path, score): the document's own probability, the posterior means, and all of it combined."""
    # kept columns go by number on the way, so that none clashes with those made here
    names = [c for c in keep or [] if c != id_col]
    kept = [f"_keep{i}" for i in range(len(names))]
    named = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in zip(names, kept, strict=True)])
    with arrow_rows(docs.sparkSession, TEXTS):
        rows, _ = cut(with_features(named, ["_id", "_host", "_path", *kept], "_text", model), "quality")
    kept = [F.col(k).alias(c) for c, k in zip(names, kept, strict=True)]
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths, _ = cut(rows.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")).first()
    if not total["n"]:
        return rows.select(F.col("_id").alias(id_col), *kept, F.lit(0.0).alias("document"), F.lit(0.0).alias("host"), F.lit(0.0).alias("path"), F.lit(0.0).alias("score"))
    mean = float(np.clip(total["s"] / total["n"], 1e-4, 1 - 1e-4))
    of_hosts = hosts.select(F.col("_host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(of_hosts, F.col("_host").eqNullSafe(F.col("h"))).drop("h")
    host_k, path_k = strength(hosts, mean), strength(both, F.col("host_s") / F.col("host_n"))
    groups = both.select(F.col("_host").alias("h"), F.col("_path").alias("q"), F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s")
    if total["groups"] <= BROADCAST:
        groups = F.broadcast(groups)
    joined = rows.join(groups, F.col("_host").eqNullSafe(F.col("h")) & F.col("_path").eqNullSafe(F.col("q")))
    host = (host_k * mean + F.col("host_s") - F.col("p")) / (host_k + F.col("host_n") - 1)
    path = (path_k * F.col("host") + F.col("path_s") - F.col("p")) / (path_k + F.col("path_n") - 1)

    def odds(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(x / (1 - x))

    combined = F.col("logit") + odds(F.col("path")) - float(np.log(mean / (1 - mean)))
    return joined.withColumn("host", host).withColumn("path", path).select(F.col("_id").alias(id_col), *kept, F.col("p").alias("document"), "host", "path", (1 / (1 + F.exp(-combined))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """score() with a model trained on the labels, and accepted: whether the score is at least `least`."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col, host_col, path_col, keep)
    return scored.withColumn("accepted", F.col("score") >= least)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with docs' columns."""
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    known = docs.select(*columns, F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(host_col).alias("o"), F.col(path_col).alias("a"))
    model = train(docs, labels, id_col, text_col)
    scored = score(known, model, "i", "t", "o", "a", [f"c{i}" for i in range(len(docs.columns))])
    return scored.where(F.col("score") >= least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
