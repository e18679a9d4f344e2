"""Operator 4: a quality classifier, a byte-level convolutional network in numpy.

Every text is covered by overlapping chunks of bytes. Learned filters look at each chunk through a byte embedding, each
filter keeps its largest response over the document, and these are combined into one probability. The network is
trained by gradient descent through the chunks that gave the largest responses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tidied
from .net import PAD, Adam, padded, text_bytes

#: Labelled documents of each class that the network learns from at most, chosen by hash of doc_id.
TRAIN_DOCS = 1200
#: A chunk has two units of bytes and overlaps its neighbours by one.
UNIT, EMBED, FILTERS = 12, 6, 32
STEPS, BATCH, RATE = 220, 48, 0.02
#: Predicts 1 from this score on.
THRESHOLD = 0.3


class ByteCNN:
    def __init__(self, prior: float = 0.5, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {"e": normal(PAD + 1, EMBED, by=0.5), "w": normal(2, UNIT * EMBED, FILTERS, by=0.15), "b": np.zeros(FILTERS, np.float32), "v": normal(FILTERS, by=0.3), "c": np.zeros(1, np.float32)}
        self.p["e"][PAD] = 0
        self.prior = prior

    def responses(self, units: np.ndarray, counts: np.ndarray, places: bool = False):
        """(documents, filters): largest responses of each document, and on request the chunks that gave them."""
        x = self.p["e"][units].reshape(len(units), -1)
        y = x @ self.p["w"][0]
        y[:-1] += (x @ self.p["w"][1])[1:]
        starts = np.cumsum(counts) - counts
        last = starts + counts - 1  # a chunk from a document's last unit would reach into the next one
        y[last] = -np.inf
        top = np.maximum.reduceat(y, starts, axis=0)
        if not places:
            return top
        where = np.stack([starts[d] + y[starts[d] : starts[d] + counts[d]].argmax(0) for d in range(len(starts))])
        return top, where

    def logit(self, top: np.ndarray) -> np.ndarray:
        return np.tanh(top + self.p["b"]) @ self.p["v"] + self.p["c"]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of label 1 under the prior of the labels."""
        units, counts = padded(*text_bytes(texts), UNIT, 1)
        odds = self.logit(self.responses(units, counts)).astype(np.float64) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def gradients(self, units: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        top, where = self.responses(units, counts, places=True)
        a = np.tanh(top + p["b"])
        d = (1 / (1 + np.exp(-np.clip(a @ p["v"] + p["c"], -30, 30))) - labels) / len(labels)
        d_top = d[:, None] * p["v"] * (1 - a * a)
        grads = {"v": a.T @ d + 1e-4 * p["v"], "c": d.sum(keepdims=True), "b": d_top.sum(0)}
        grads["w"], grads["e"] = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for half in (0, 1):
            chosen = units[where + half]  # documents, filters, unit
            x = p["e"][chosen].reshape(*where.shape, -1)
            grads["w"][half] = np.einsum("dfk,df->kf", x, d_top)
            np.add.at(grads["e"], chosen, (d_top[..., None] * p["w"][half].T[None]).reshape(*chosen.shape, EMBED))
        grads["e"][PAD] = 0
        return grads


def train(texts: list[str], labels: list[int], prior: float, seed: int = 11) -> ByteCNN:
    """A network fitted to whole texts, as many of each class in every step; without both classes it answers the prior."""
    net, rng = ByteCNN(min(max(prior, 1e-3), 1 - 1e-3), seed), np.random.default_rng(seed)
    by_class = [[t for t, y in zip(texts, labels, strict=True) if y == c] for c in (0, 1)]
    if not all(by_class):
        net.p["v"][:] = 0
        return net
    adam = Adam(net.p, RATE)
    y = np.repeat([0.0, 1.0], BATCH // 2).astype(np.float32)
    for step in range(STEPS):
        own = [by_class[c][rng.integers(len(by_class[c]))] for c in (0, 1) for _ in range(BATCH // 2)]
        units, counts = padded(*text_bytes(pa.array(own, pa.string())), UNIT, 1)
        adam.rate = RATE * (1 - 0.9 * step / STEPS)
        adam.step(net.gradients(units, counts, y))
    return net


def train_on(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = TRAIN_DOCS) -> ByteCNN:
    """Fits a network to the texts of at most `limit` rows of each label; the prior comes from all labels for which `learn` holds."""
    known = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("quality") == c).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit) for c in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 x limit rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "doc_id").orderBy("h", "doc_id", "text").limit(2 * limit).collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows], shares.get(1, 0) / max(1, sum(shares.values())) if len(shares) == 2 else 0.5)


def score_quality(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """(doc_id, score) of every row: the probability that a whole text has quality 1.

    A null text counts as empty and is scored as such. Repeated rows are scored each; an empty table gives no rows; other
    columns are left out. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.score(part.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
