"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a
label.  Every passage is described by shares of byte classes, word shapes and
repeats, and by hashed words; a small network encodes it, a gated attention
(tanh times sigmoid) weighs the passages against each other, and the weighted
sum is scored.  Scoring reads whole texts, passage by passage, where the
documents are; only the trained weights are broadcast (a few thousand numbers).

Training runs on the driver on a bounded sample of rows: ``SAMPLE`` labelled
rows by a hash of their id, those of them that together hold ``SAMPLE_BYTES``
of text, each with every passage of its whole text.  Rows whose crc32(id as
text) mod 3 is 1 are never learned from.

Defined results: null and blank texts are bags without passages; they get the
score of an empty representation.  Labels that are null or neither 0 nor 1
are not learned from; without two classes every score is the share of label 1
(0.5 without labels).  Of labels that repeat an id the smaller counts, of texts
the first in byte order, so the model is the same whatever the order of rows.
Columns of any name are carried as they are; one named like ``out`` is
replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import textops as X
from sitelens.llm.common import column, cut, packed, session, slices, unpacked

PASSAGE, SAMPLE, SAMPLE_BYTES = 64, 6000, 1 << 25
HASHED, HIDDEN, ATTENTION, STEPS, RATE, DECAY = 48, 24, 16, 400, 0.02, 1e-4
SEED = 7

# Byte classes whose shares describe a passage.
_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "|", "#$%&*@^~+=_", "'\"`()[]{}<>/\\-", "\n"), 1):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[128:] = 10
_N_CLASSES = 11
FEATURES = _N_CLASSES + 9 + HASHED


def passages(texts: list[bytes], n: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features, text ordinal) of every passage of the texts."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    sep = X.SEPARATOR[buf]
    before = np.ones_like(sep)
    before[1:] = sep[:-1]
    start, stop = np.flatnonzero(before & ~sep), np.flatnonzero(sep & ~before)
    first = np.searchsorted(start, offset)
    words = np.diff(first)
    per = -(-words // n)
    if not per.sum():
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    low = first[text] + nth * n
    high = np.minimum(low + n, first[text + 1])
    size = (high - low).astype(np.float64)
    bag = np.repeat(np.arange(len(text)), high - low)       # passage of each word
    ends = np.append(start[low[1:]], len(buf))              # passages are adjacent: bytes up to the next one
    ends = np.minimum(ends, offset[text + 1])
    spread = np.zeros(len(buf) + 1, np.int64)
    np.add.at(spread, start[low], 1)
    owner = np.cumsum(spread[:-1]) - 1
    inside = owner >= 0
    shares = np.bincount(owner[inside] * _N_CLASSES + _CLASSES[buf[inside]], minlength=len(text) * _N_CLASSES).reshape(-1, _N_CLASSES)
    n_bytes = shares.sum(1)
    length = (stop - start).astype(np.float64)
    mean = np.bincount(bag, length) / size
    spread_ = np.sqrt(np.maximum(np.bincount(bag, length ** 2) / size - mean ** 2, 0))
    longest = np.maximum.reduceat(length, low)
    h = X.words(texts, lower=True).hashes
    order = np.lexsort((h, bag))
    same = (h[order][1:] == h[order][:-1]) & (bag[order][1:] == bag[order][:-1])
    repeats = np.bincount(bag[order][1:][same], minlength=len(text)) / size
    twice = np.bincount(bag[1:][(h[1:] == h[:-1]) & (bag[1:] == bag[:-1])], minlength=len(text)) / size
    letter = np.concatenate(([0], np.cumsum(np.isin(_CLASSES[buf], (0, 1, 10)) & ~sep)))
    plain = letter[stop] - letter[start]
    capital = np.concatenate(([0], np.cumsum(_CLASSES[buf] == 1)))
    caps = np.bincount(bag, (capital[stop] - capital[start] >= 2).astype(float)) / size
    bare = np.bincount(bag, (plain == 0).astype(float)) / size
    mixed = np.bincount(bag, ((plain > 0) & (length - plain >= 3)).astype(float)) / size
    slot = (h % X.U(HASHED)).astype(np.int64)
    sign = np.where((h >> X.U(32)) & X.U(1), 1.0, -1.0)
    hashed = np.bincount(bag * HASHED + slot, sign, minlength=len(text) * HASHED).reshape(-1, HASHED) / np.sqrt(size)[:, None]
    dense = np.stack([mean / 10, spread_ / 10, np.log1p(longest) / 5, repeats, twice, caps, bare, mixed, size / n], 1)
    return np.concatenate([shares / np.maximum(n_bytes, 1)[:, None], dense, hashed], 1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """encode -> gated attention over each bag -> logistic score."""

    def __init__(self, rng: np.random.Generator, width: int):
        def init(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"enc": init(width, HIDDEN), "enc0": np.zeros(HIDDEN), "tanh": init(HIDDEN, ATTENTION), "tanh0": np.zeros(ATTENTION),
                  "gate": init(HIDDEN, ATTENTION), "gate0": np.zeros(ATTENTION), "att": init(ATTENTION, 1)[:, 0],
                  "out": init(HIDDEN, 1)[:, 0], "out0": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, bag: np.ndarray, n_bags: int):
        w = self.w
        z = np.tanh(x @ w["enc"] + w["enc0"])
        t, g = np.tanh(z @ w["tanh"] + w["tanh0"]), _sigmoid(z @ w["gate"] + w["gate0"])
        e = (t * g) @ w["att"]
        top = np.full(n_bags, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a = a / np.bincount(bag, a, minlength=n_bags)[bag]
        m = np.zeros((n_bags, HIDDEN))
        np.add.at(m, bag, a[:, None] * z)
        return m @ w["out"] + w["out0"][0], (z, t, g, a, m)

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        s, (z, t, g, a, m) = self.forward(x, bag, len(y))
        ds = (_sigmoid(s) - y) * weight
        dm = ds[:, None] * w["out"]
        dz = a[:, None] * dm[bag]
        da = (dm[bag] * z).sum(1)
        de = a * (da - np.bincount(bag, a * da, minlength=len(y))[bag])
        dt, dg = de[:, None] * w["att"] * g * (1 - t ** 2), de[:, None] * w["att"] * t * g * (1 - g)
        dz += dt @ w["tanh"].T + dg @ w["gate"].T
        dpre = dz * (1 - z ** 2)
        return {"enc": x.T @ dpre, "enc0": dpre.sum(0), "tanh": z.T @ dt, "tanh0": dt.sum(0), "gate": z.T @ dg, "gate0": dg.sum(0),
                "att": (t * g).T @ de, "out": m.T @ ds, "out0": np.array([ds.sum()])}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        # Both classes weigh the same in training.
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for i in range(1, STEPS + 1):
            for k, d in self.gradients(x, bag, y, weight).items():
                d = d + DECAY * self.w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                rate = RATE * min(1, 2 * (1 - i / (STEPS + 1)))
                self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9 ** i)) / (np.sqrt(second[k] / (1 - 0.999 ** i)) + 1e-8)

    def scores(self, x: np.ndarray, bag: np.ndarray, n_bags: int) -> np.ndarray:
        return _sigmoid(self.forward((x - self.mean) / self.scale, bag, n_bags)[0])


def _bags(batches):
    """Features of every passage of each sampled text."""
    for part, texts in slices(batches):
        x, text = passages(texts)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        rows = [x[i:j].astype(np.float64).tobytes() for i, j in zip(first, first[1:])]
        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "y": part.column(1), "x": pa.array(rows, pa.binary())})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Attention:
    """A model of ``label_col`` from rows that are not held out."""
    session(docs)
    y = labels.select(column(labels, id_col, "doc_id", "bigint"), F.col(f"`{label_col}`").cast("int").alias("y"))
    y = y.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    base = docs.select(column(docs, id_col, "doc_id", "bigint"), column(docs, text_col, "text", "string"))
    # Labels come first and are few: the sample is drawn before texts are joined.
    drawn = y.join(base.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # ``sample`` rows of two numbers: small enough to broadcast by construction.
    rows = cut(base.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
               .withColumn("order", F.struct(F.xxhash64("doc_id"), "doc_id")))
    # A running sum over ``sample`` sizes at most, on one task.
    upto = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy("order"))
    fit = rows.select("doc_id", "order", F.octet_length("text").cast("long").alias("size")).select("doc_id", upto.alias("upto")).where(F.col("upto") <= sample_bytes)
    got = (rows.join(F.broadcast(fit.select("doc_id")), "doc_id").select("doc_id", "y", "text").mapInArrow(_bags, "doc_id long, y int, x binary")
           .toPandas().sort_values("doc_id"))
    model = Attention(np.random.default_rng(seed), FEATURES)
    target = got["y"].to_numpy(np.float64)
    if len(set(target)) < 2:
        share = float(target.mean()) if len(target) else 0.5
        model.w = {k: np.zeros_like(v) for k, v in model.w.items()}
        model.w["out0"][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    bags = [np.frombuffer(b).reshape(-1, FEATURES) for b in got["x"]]
    model.fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), target)
    return model


def score(docs: DataFrame, model: Attention, text_col: str = "text", out: str = "score", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with each text's score as ``out``; a
    column of that name is replaced."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast((model.w, model.mean, model.scale))
    base = packed(docs, text_col, out, carry)

    def run(batches):
        m = Attention(np.random.default_rng(0), FEATURES)
        m.w, m.mean, m.scale = shared.value
        for part, texts in slices(batches):
            x, bag = passages(texts)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row")), pa.array(m.scores(x, bag, len(texts)))],
                                             names=["row", "score"])

    done = T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())])
    return unpacked(base.mapInArrow(run, done), "score", out)
