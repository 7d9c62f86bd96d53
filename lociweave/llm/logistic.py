"""Logistic regression on a bounded sample, by Newton steps with a ridge; and the samples it is fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def trains(id_col: str) -> "F.Column":
    """Whether a row's labels may be learnt from: the CRC-32 of its id as text leaves a remainder by FOLDS other than 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): at most `rows` documents that train, chosen by a hash of the id. Ids labelled twice take the larger label; of
    documents that share an id the least text counts."""
    own = labels.where(F.col(label).isNotNull() & trains(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -8, 8)) @ self.weights[:-1] + self.weights[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    """A model that answers the base rate where there is nothing to learn from."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.array([*[0.0] * x.shape[1], np.log(rate / (1 - rate))]))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)
