"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is cut into words (runs of letters, of digits, of other signs).  Its
features are hashed single words and pairs of words, lower-cased, and triples
of word shapes (lower, capitalised, all capitals, digits, signs, each with a
length class), which carry over to words never seen.  Counts are damped by a
logarithm and each text is scaled to length 1.

Training is online: per example the weights follow in closed form from the sums
kept per coordinate (FTRL-proximal).  It runs in one task over a bounded sample
of labelled rows, ``sample`` of them at most, chosen by a hash of their key;
the features of the sample are made in all tasks before.  Scoring is a sparse
dot product of every whole text with the weight vector (``2 ** bits`` numbers).

Defined cases: null and empty texts have no features and get the score of the
intercept; labels that are null are left out; of several labels of a document
the mean decides, 0.5 counts as 1; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sessionlens.llm.common import LOWER, blocks, byte_runs, mixed, prefix_hash, range_hash, text_bytes

BITS = 18
PIECE = 1 << 20  # bytes of text hashed at once: a task's temporaries are some fifty times as large
SIGNS = np.full(256, 3, np.uint8)
SIGNS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
SIGNS[48:58] = 2
SIGNS[[0, 9, 10, 11, 12, 13, 32]] = 0


def hashed_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n rows of text: n + 1 bounds, feature numbers (from 1; 0 is the intercept) and values."""
    n = len(offsets) - 1
    starts, ends, kind, row = byte_runs(data, offsets, SIGNS)
    if not len(starts):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    small = LOWER[data]
    word = range_hash(prefix_hash(small), starts, ends)
    capital = np.concatenate([[0], np.cumsum(small != data)])
    capitals, length = capital[ends] - capital[starts], ends - starts
    case = np.where(kind != 1, kind + 2, np.where(capitals == 0, 0, np.where((capitals == length) & (length > 1), 2, 1)))
    shape = (case * 4 + np.digitize(length, (2, 4, 9))).astype(np.uint64)
    with np.errstate(over="ignore"):
        pair = mixed(word[:-1] * np.uint64(3) + word[1:])[row[:-1] == row[1:]]
        triple = mixed(((shape[:-2] * np.uint64(64) + shape[1:-1]) * np.uint64(64) + shape[2:]) + np.uint64(7 << 40))[row[:-2] == row[2:]]
    feature = np.concatenate([word, pair, triple]) >> np.uint64(64 - bits)
    owner = np.concatenate([row, row[:-1][row[:-1] == row[1:]], row[:-2][row[:-2] == row[2:]]])
    joint, count = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | feature, return_counts=True)
    owner = (joint >> np.uint64(bits)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value = (value / norm[owner]).astype(np.float32)
    return np.searchsorted(owner, np.arange(n + 1)), (joint & np.uint64((1 << bits) - 1)).astype(np.int32) + 1, value


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _packed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in blocks(offsets, PIECE):
                at, feature, value = hashed_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits)
                rows = [(feature[at[i]:at[i + 1]].tobytes(), value[at[i]:at[i + 1]].tobytes()) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                                                  batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)],
                                                 ["feature", "value", "label", "turn"])
    return run


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 12_000,
          epochs: int = 2, bits: int = BITS) -> np.ndarray:
    """Weights of the intercept and the ``2 ** bits`` features, learned from ``sample`` labelled documents at most."""
    turn = F.xxhash64(F.col("_key"), F.lit(11))
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")).where("_key is not null and _label is not null") \
        .groupBy("_key").agg((F.avg("_label") >= 0.5).cast("int").alias("_label")) \
        .withColumn("_turn", turn).orderBy("_turn").limit(sample)
    chosen = docs.join(F.broadcast(marked), docs[key] == F.col("_key"))  # at most ``sample`` keys
    features = chosen.select(F.col(text).alias("text"), "_label", "_turn").mapInArrow(_packed(bits), "feature binary, value binary, label int, turn bigint")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl((1 << bits) + 1), list(batches)  # the packed sample; each epoch reads it in the same order
        for _ in range(epochs):
            for batch in held:
                for feature, value, y in zip(*(batch.column(i) for i in range(3))):
                    at = np.concatenate([[0], np.frombuffer(feature.as_buffer(), np.int32)])
                    model.learn(at, np.concatenate([[0.3], np.frombuffer(value.as_buffer(), np.float32)]), y.as_py())
        weights = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    ordered = features.repartition(1).sortWithinPartitions("turn", "feature")
    rows = ordered.mapInArrow(learn, "weights binary").collect()  # one row of 2 ** bits floats
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (columns of these names are replaced)."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    others = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    first, *inner = text.split(".")  # a text inside a struct is read there: rows cross to Python once
    place = [i for i, f in enumerate(others) if f.name == first]

    def within(batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(place[0]) if place else batch.column(len(others))
        for name in inner if place else []:
            column = pc.struct_field(column, name)
        return column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_bytes(within(batch))
            sums = np.empty(batch.num_rows)
            for lo, hi in blocks(offsets, PIECE):
                at, feature, value = hashed_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits)
                added = np.concatenate([[0.0], np.cumsum(w[feature] * value.astype(np.float64))])
                sums[lo:hi] = np.round(added[at[1:]] - added[at[:-1]], 9) + 0.3 * float(w[0])
            p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             [*(f.name for f in others), "score", "predicted"])

    schema = StructType([*others, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    names = [F.col(f"`{f.name}`") for f in others]
    return docs.select(*names, *([] if place else [F.col(text)])).mapInArrow(run, schema)
