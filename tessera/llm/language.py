"""Operator 9: language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into stretches of bytes, over each of which two recurrent layers run in opposite directions; together they
label every byte with probabilities, and a document's probabilities are the means over all its bytes. The network is
trained by backpropagation through time on a bounded, hash-chosen sample; gates and candidates are piecewise linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tidied
from .net import PAD, Adam, padded, text_bytes

#: Documents that the network learns from at most, chosen by hash of doc_id.
TRAIN_DOCS = 1500
#: Stretches drawn from anywhere in the whole text of each, and their characters; training needs no more than these many.
DRAWS, DRAW_CHARS = 24, 64
HIDDEN, STRETCH, ROWS = 8, 192, 2048
STEPS, TRAIN_STRETCH, TRAIN_ROWS, RATE = 160, 48, 192, 0.03
#: Stands for a text without letters.
UNKNOWN = "und"


class BiGRU:
    """Both directions are stacked: parameters and states have a first axis of 2."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, c = HIDDEN, len(classes)
        normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.classes = classes
        self.p = {"x": normal(2, PAD + 1, 3 * h, by=0.5), "u": normal(2, h, 2 * h, by=0.3), "w": normal(2, h, h, by=0.3), "v": normal(2, h, c, by=0.3), "b": np.zeros(c, np.float32)}
        self.hold()

    def hold(self) -> None:
        """Padding leaves the state as it is: its update gate is shut."""
        self.p["x"][:, PAD, :] = 0
        self.p["x"][:, PAD, :HIDDEN] = -1e4

    def logits(self, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(bytes, rows, classes) for (rows, bytes); keep gets what training needs."""
        h_n, p = HIDDEN, self.p
        steps = rows.T.astype(np.int32)
        table = p["x"].reshape(-1, 3 * h_n)
        h = np.zeros((2, rows.shape[0], h_n), np.float32)
        out = np.zeros((len(steps), rows.shape[0], len(self.classes)), np.float32)
        out += p["b"]
        for t in range(len(steps)):
            at = np.stack([steps[t], steps[-1 - t] + (PAD + 1)])
            a = np.take(table, at, axis=0)
            g = np.matmul(h, p["u"])
            g += a[..., : 2 * h_n]
            g *= 0.25
            g += 0.5
            gate = np.clip(g, 0, 1)
            z, r = gate[..., :h_n], gate[..., h_n:]
            s = np.matmul(r * h, p["w"])
            s += a[..., 2 * h_n :]
            c = np.clip(s, -1, 1)
            new = c - h
            new *= z
            new += h
            if keep is not None:
                keep.append((at, h, g, gate, s, c, new))
            h = new
            y = np.matmul(h, p["v"])
            out[t] += y[0]
            out[-1 - t] += y[1]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(-1, keepdims=True))
        e /= e.sum(-1, keepdims=True)
        return e

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions, by backpropagation through time."""
        keep: list = []
        real = (rows.T != PAD).astype(np.float32)
        d_out = self.probabilities(self.logits(rows, keep))
        d_out[:, np.arange(len(labels)), labels] -= 1
        d_out *= (real / max(1.0, real.sum()))[..., None]
        h_n, p = HIDDEN, self.p
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["b"] = d_out.sum((0, 1))
        d_h = np.zeros((2, len(labels), h_n), np.float32)
        ats, d_as = [], []
        swap = lambda x: np.swapaxes(x, -1, -2)
        for t in reversed(range(len(keep))):
            at, h, g, gate, s, c, new = keep[t]
            z, r = gate[..., :h_n], gate[..., h_n:]
            d_y = np.stack([d_out[t], d_out[-1 - t]])
            grads["v"] += np.matmul(swap(new), d_y)
            d_h = d_h + np.matmul(d_y, swap(p["v"]))
            d_s = d_h * z * (np.abs(s) < 1)
            grads["w"] += np.matmul(swap(r * h), d_s)
            d_rh = np.matmul(d_s, swap(p["w"]))
            d_gate = np.concatenate([d_h * (c - h), d_rh * h], -1) * 0.25 * ((g > 0) & (g < 1))
            grads["u"] += np.matmul(swap(h), d_gate)
            ats.append(at.ravel())
            d_as.append(np.concatenate([d_gate, d_s], -1).reshape(-1, 3 * h_n))
            d_h = d_h * (1 - z) + d_rh * r + np.matmul(d_gate, swap(p["u"]))
        where, what = np.concatenate(ats), np.concatenate(d_as)
        order = np.argsort(where, kind="stable")
        firsts = np.flatnonzero(np.diff(where[order], prepend=-1))
        grads["x"].reshape(-1, 3 * h_n)[where[order][firsts]] = np.add.reduceat(what[order], firsts)
        grads["x"][:, PAD] = 0
        return grads

    def score(self, texts: pa.Array) -> np.ndarray:
        """(texts, classes): mean probabilities over all bytes of each text; 0 for texts without bytes."""
        data, offsets = text_bytes(texts)
        rows, units = padded(data, offsets, STRETCH, 0)
        sums = np.zeros((len(rows), len(self.classes)))
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            sums[i : i + ROWS] = (self.probabilities(self.logits(part)) * (part.T != PAD)[..., None]).sum(0)
        return np.add.reduceat(sums, np.cumsum(units) - units, axis=0) / np.maximum(1, np.diff(offsets))[:, None]


def train(texts: list[str], labels: list[str], seed: int = 7) -> BiGRU | None:
    """A network fitted to stretches of the texts, as many of each class; None without texts."""
    classes = sorted(set(labels))
    if not classes:
        return None
    net, rng = BiGRU(classes, seed), np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    by_class = [[x for x, y in zip(raw, labels, strict=True) if y == c and len(x)] or [np.zeros(1, np.uint8)] for c in classes]
    adam = Adam(net.p, RATE)
    for step in range(STEPS):
        y = rng.integers(len(classes), size=TRAIN_ROWS)
        rows = np.full((TRAIN_ROWS, TRAIN_STRETCH), PAD, np.int16)
        for i, c in enumerate(y):
            x = by_class[c][rng.integers(len(by_class[c]))]
            start = rng.integers(max(1, len(x) - TRAIN_STRETCH + 1))
            cut = x[start : start + TRAIN_STRETCH]
            rows[i, : len(cut)] = cut
        adam.rate = RATE * (1 - 0.9 * step / STEPS)
        adam.step(net.gradients(rows, y))
        net.hold()
    return net


def training_rows(docs: DataFrame, learn: Column, limit: int) -> list:
    """(h, stretches, lang) of the `limit` rows with a text and a language for which `learn` holds that come first by the hash of their doc_id.

    Stretches are drawn over the whole text, so every part of it can be learned from and a very long text costs the driver
    no more than others. Tasks would each send `limit` rows to the driver; so a hash below which about twice as many rows
    fall in the whole table goes first, and is raised where fewer are found.
    """
    by = F.xxhash64("doc_id")
    places = F.greatest(F.length("text") - DRAW_CHARS + 1, F.lit(1))
    start = lambda k: F.pmod(F.xxhash64("doc_id", k), places).cast("int") + 1
    draws = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda k: F.col("text").substr(start(k), F.lit(DRAW_CHARS)))
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = 2 * limit / max(1, known.count())
    while True:
        below = known if share >= 1 else known.where(by < int((share - 0.5) * 2**64))
        rows = below.select(by.alias("h"), draws.alias("stretches"), F.col("lang").cast("string").alias("lang")).orderBy("h", "lang", "stretches").limit(limit).collect()
        if share >= 1 or len(rows) == limit:
            return rows
        share *= 4


def train_on(docs: DataFrame, learn: Column, limit: int = TRAIN_DOCS) -> BiGRU | None:
    """Fits a network to at most `limit` rows with a text and a language for which `learn` holds."""
    rows = training_rows(docs, learn, limit)
    return train([x for r in rows for x in r["stretches"]], [r["lang"] for r in rows for _ in r["stretches"]])


def identify(docs: DataFrame, net: BiGRU | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language with the largest mean probability over all bytes.

    Texts that are null or have no letter are `und` with score 0, and so are all texts if there was nothing to learn from.
    Ties go to the first language by name. Repeated rows are scored each; an empty table gives no rows; other columns are
    left out. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text")
                known = np.array([bool(t and letter(t)) for t in texts.to_pylist()], bool)
                if net is None:
                    names, best = [UNKNOWN] * len(known), np.zeros(len(known))
                else:
                    p = net.score(texts)
                    best = np.where(known, np.minimum(p.max(1), 1.0), 0.0)
                    names = [net.classes[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
