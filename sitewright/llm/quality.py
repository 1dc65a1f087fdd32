"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are its words, pairs of words, the shapes of words (letters, capitals,
digits and marks, runs taken together; ``=`` for a word that repeats the one before) and pairs of
shapes, hashed to ``2 ** BITS`` places; a feature that occurs c times weighs 1 + ln c, and the
vector has length 1. Only the text is looked at.

Training: at most ``sample`` labelled rows, those whose hashed id comes first (a documented bound,
so one task can learn them: about 50 MB of features); each is seen ``epochs`` times. The weights
are 1 MB whatever the input is. Scoring is one narrow stage over all rows: a sparse dot product.

Labels other than 0 and 1 and null ids do not take part; an id labelled both ways counts as
its rounded mean, 1 for a tie; an id with several texts is learned by its greatest text. Without labelled
rows every score is 0.5. Null and empty texts get the score of the bias. Every row is scored,
repeated ones too. Other columns pass through ``score`` untouched, but for earlier columns named
as its output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.llm.common import ship

BITS = 18
#: Labelled rows learned from, at most.
SAMPLE = 8192
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

#: Byte classes of shapes: capitals, other letters (all of UTF-8 beyond ASCII with them), digits; marks stay.
_CLASSES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


class _Shapes(dict):
    """Hash of a word of byte classes, runs taken together."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = crc32(re.sub(rb"(.)\1+", rb"\1", word), 7)
        return found


def features(text: str, shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's features."""
    data = text.encode()
    listed = data.split()
    if not listed:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    word = np.fromiter(map(crc32, listed), np.uint64, len(listed))
    shape = np.fromiter(map(shapes.__getitem__, data.translate(_CLASSES).split()), np.uint64, len(listed))
    shape[1:][word[1:] == word[:-1]] = 61
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = [
        word * mix,
        shape * mix + np.uint64(1),
        (word[:-1] * np.uint64(31) + word[1:] + np.uint64(2)) * mix,
        (shape[:-1] * np.uint64(37) + shape[1:] + np.uint64(3)) * mix,
    ]
    places, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS), return_counts=True)
    x = 1 + np.log(counts)
    return places.astype(np.int64), (x / np.sqrt((x * x).sum())).astype(np.float32)


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes = _Shapes()
    for f in frames:
        found = [features(t or "", shapes) for t in f.text]
        yield pd.DataFrame(
            {"doc_id": f.doc_id, "label": f.label, "i": [a.astype(np.int32) for a, _ in found], "x": [b for _, b in found]}
        )


def _learn(rows: pd.DataFrame, epochs: int) -> pd.DataFrame:
    """Follow the regularised leader, per coordinate; the last place is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = rows.assign(h=[crc32(str(d).encode()) for d in rows.doc_id]).sort_values(["h", "doc_id"])
    examples = [
        (np.append(np.asarray(i, np.int64), size - 1), np.append(np.asarray(x, float), 1.0), float(y))
        for i, x, y in zip(rows.i, rows.x, rows.label)
    ]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for i, x, y in examples:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[i] = grown
    return pd.DataFrame({"weights": [weights(z, n).astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None, sample: int = SAMPLE, epochs: int = EPOCHS) -> bytes:
    """Weights learned from labelled documents; ``learn`` says which ids may be learned from."""
    marked = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        marked = marked.where(learn)
    # Ids alone are cut to the sample; texts join it afterwards. The sample has a fixed bound, so it may be broadcast.
    chosen = (
        marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.max("text").alias("text"))
        .mapInPandas(_featured, "doc_id long, label int, i array<int>, x array<float>")
    )

    def learn_all(group: pd.DataFrame) -> pd.DataFrame:
        return _learn(group, epochs)

    learned = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn_all, "weights binary").collect()
    return bytes(learned[0].weights) if learned else bytes(4 * ((1 << BITS) + 1))


def _scored(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    w = np.frombuffer(model.value, np.float32)
    bias, shapes = float(w[-1]), _Shapes()
    for batch in batches:
        scores = []
        for text in batch.column(at):
            i, x = features(text.as_py() or "", shapes)
            scores.append(1 / (1 + np.exp(-np.clip(bias + float(w[i] @ x), -35, 35))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def score(docs: DataFrame, weights: bytes) -> DataFrame:
    """All rows and columns of ``docs`` and a score from 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(partial(_scored, model=model, at=docs.columns.index("text")), schema)


ship(__name__)
