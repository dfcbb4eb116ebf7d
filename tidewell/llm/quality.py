"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII characters, or runs of one other printable character, case kept. Every one-
and two-word gram of the whole text is hashed to one of 2^bits places; two-word grams of one word twice, with or without
a mark between, share a place, so that a stutter is known whatever its word. A text's vector is its counts over the square root
of their sum, and a score is the logistic function of the sparse dot product with the weights. Nothing else of a row is
an input.

Training reads a bounded sample of labelled rows, once: the `sample` rows least by a hash of their key. They are few
enough for one task, which streams them; the weights are of a fixed size. Scoring is one map over all rows.

Handled cases: null and empty texts get the score of the bias; several labels of a key count as the largest; labels or
keys that are null train nothing; without any labelled row every score is one half; an empty table gives no rows; other
columns, such as a clashing `score`, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SYMBOL, U8, by_bytes, least_by_hash, mix, prepare, string_hashes, sums, text_bytes

#: Rows that training reads at most, and places of the weights as a power of two.
SAMPLE, BITS = 12_000, 18
GAP = np.zeros(256, bool)
GAP[:33] = GAP[127] = True


def grams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all one- and two-word grams of the rows, and the n + 1 bounds of each row's."""
    kind = np.where(GAP[data], 0, np.where(SYMBOL[data] & ~((data >= 65) & (data <= 90)), 1, 2)).astype(np.uint8)
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == 1) & (data[1:] != data[:-1]))
    change[off] = True
    cuts = np.flatnonzero(change)
    s, e = cuts[:-1], cuts[1:]
    keep = kind[s] > 0 if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    bound = np.searchsorted(s, off)
    h = string_hashes(sums(data), s, e)
    prev = np.concatenate([np.zeros(1, U8), h[:-1]])[: len(h)]
    prev[bound[:-1][bound[:-1] < len(h)]] = U8(0x5851F42D4C957F2D)  # a text's first word follows its start
    two = np.concatenate([np.zeros(2, U8), h[:-2]])[: len(h)]
    mark = np.concatenate([[False], kind[s[:-1]] == 1])[: len(h)]
    again = (h == prev) | ((h == two) & mark)
    both = np.empty(2 * len(h), np.int64)
    both[::2] = (h >> U8(64 - bits)).astype(np.int64)
    both[1::2] = (np.where(again, U8(0x632BE59BD9B4E019), mix(prev * U8(3) + h)) >> U8(64 - bits)).astype(np.int64)
    return both, 2 * bound


class Learner:
    """FTRL-proximal logistic regression, a row at a time."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def update(self, places: np.ndarray, label: int) -> None:
        at, count = np.unique(places, return_counts=True)
        at, x = np.append(at.astype(np.int64), 1 << self.bits), np.append(count / np.sqrt(max(1, len(places))), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> tuple[bytes, float]:
        w = self.weights(np.arange((1 << self.bits) + 1))
        return w[:-1].astype("<f4").tobytes(), float(w[-1])


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> tuple[bytes, float]:
    """Weights (little-endian 32-bit floats) and bias, learned from at most sample rows of labels whose fold is not 0."""
    prepare(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & (fold(F.col(key)) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    chosen = least_by_hash(chosen, key, sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(F.xxhash64(key).alias("at"), text, "__y")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in by_bytes(off):
                got, bound = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                got = got.astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([got[a:b].tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())], ["at", "y", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, some = Learner(bits), False
        for batch in batches:
            for y, p in zip(batch.column(1).to_pylist(), batch.column(2)):
                learner.update(np.frombuffer(p.as_buffer(), "<u4"), y)
                some = True
        if some:
            w, b = learner.model()
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary()), pa.array([b])], ["weights", "bias"])

    # in one task, which holds the learner and a batch; the sort makes the result independent of how the rows came
    ordered = rows.mapInArrow(places, "at long, y int, places binary").repartition(1).sortWithinPartitions("at", "y", "places")
    got = ordered.mapInArrow(learn, "weights binary, bias double").first()
    return (bytes(got[0]), got[1]) if got else (bytes(4 << bits), 0.0)


def score(docs: DataFrame, model: tuple[bytes, float], *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: key, the carried columns, score, and predicted (1 if score >= threshold, else 0)."""
    prepare(docs.sparkSession)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    bits = (len(model[0]) // 4 - 1).bit_length()
    df = docs.select(key, text, *(c for c in carry if c not in (key, text)))
    names = [c for c in df.columns if c in (key, *carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, "<f4").astype(np.float64)
        for batch in batches:
            data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
            out = [np.zeros(0)]
            for i, j in by_bytes(off):
                got, bound = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                total = np.concatenate([[0.0], np.cumsum(w[got])])
                n = np.maximum(1, np.diff(bound))
                out.append(1 / (1 + np.exp(-np.clip((total[bound[1:]] - total[bound[:-1]]) / np.sqrt(n) + bias, -35, 35))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.mapInArrow(run, f"{kinds}, score double, predicted int")
