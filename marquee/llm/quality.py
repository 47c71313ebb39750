"""Quality by supervised subword embeddings.

A text's vector is the average of learned vectors of its words and of the character n-grams (2 to 4) inside
its words, hashed into 2**bits places each; a softmax layer gives the classes. Vectors and layer are trained
together by numpy stochastic gradient descent on a bounded, labelled sample (``cap`` documents a label value
and ``most_bytes`` of features at most, documented bounds; weights restore the whole table's mix of labels). Since the layer is linear in the average, the vectors are multiplied with it
once and whole texts are scored as averages of these products, in one map.

Defined results: null, empty and blank texts have no feature and get the score of the bias; repeated rows
give repeated rows; an empty table gives an empty one; without training rows every score is 0.5; a null id is
scored like any other and never learned from; ties can't occur, as nothing is ranked; a column with the name of
the result is replaced, and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Characters, Words, appended, bounded_rows, labelled_sample, mix, ready, slices, total

GRAMS = (2, 3, 4)


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word and n-gram; words take the first 2**bits places, n-grams the next."""
    words = Words(texts, lower=False)
    docs, places = [words.doc], [(words.hashes >> np.uint64(64 - bits)).astype(np.int32)]
    held = Characters(texts)
    c, fine = held.points.astype(np.uint64), ~held.blank
    code, inside = np.zeros(len(c), dtype=np.uint64), np.ones(len(c), dtype=bool)
    for n in range(1, max(GRAMS) + 1):
        end = len(c) - n + 1
        if end <= 0:
            break
        code, inside = mix(code[:end] + c[n - 1 :]), inside[:end] & fine[n - 1 :]
        if n in GRAMS:
            docs.append(held.doc[:end][inside])
            places.append((code[inside] >> np.uint64(64 - bits)).astype(np.int32) + (1 << bits))
    return np.concatenate(docs), np.concatenate(places)


def _collect(bits: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 1 << 20):
            doc, place = features(part.column(3).to_pylist(), bits)
            keys, counts = np.unique((doc << (bits + 1)) | place, return_counts=True)
            stops = np.searchsorted(keys, np.arange(1, part.num_rows) << (bits + 1))
            rows = [np.split(x, stops) for x in ((keys & ((2 << bits) - 1)).astype("<i4"), counts.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([x.tobytes() for x in r], pa.binary()) for r in rows)], ["label", "weight", "draw", "places", "counts"])

    return run


@dataclass
class Model:
    places: np.ndarray  # the product of each place's vector with the layer, class 1 over class 0
    bias: float
    bits: int


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int, float]], bits: int, width: int = 12, rate: float = 0.5, epochs: int = 8, seed: int = 3) -> Model:
    """Vectors and softmax layer by stochastic gradient descent with a falling rate. rows: places, shares, label, weight."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (2 << bits, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    # A longer step than that of weight 2 would overshoot: then all steps are shorter, and the mix stays.
    rate *= min(1.0, 2.0 / max([1e-9, *(weight for *_, weight in rows)]))
    for _ in range(epochs):
        for k in draw.permutation(len(rows)).tolist():
            at, share, y, weight = rows[k]
            lr = np.float32(rate * (1 - done / steps))
            mean = share @ vectors[at]
            out = mean @ layer + bias
            g = np.exp(out - out.max())
            g /= g.sum()
            g[y] -= 1
            g *= np.float32(weight)
            back = layer @ g
            layer -= lr * np.outer(mean, g)
            bias -= lr * g
            # Shares of a text sum to one; scaled up, rare subwords move as well.
            vectors[at] -= lr * np.minimum(1, 40 * share)[:, None] * back
            done += 1
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", cap: int = 1500, bits: int = 16, most_bytes: int = 24 << 20, **options) -> Model:
    """A model from at most cap documents a label value, and most_bytes of features; docs and labels: the rows to learn from."""
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, cap).select(F.col("label").cast("int").alias("label"), "weight", "draw", "text")
    found = bounded_rows(sample.mapInArrow(_collect(bits), "label int, weight double, draw long, places binary, counts binary"), "quality-sample", most_bytes)
    examples = []
    for r, weight in found:
        if r["places"]:
            count = np.frombuffer(r["counts"], dtype="<i4").astype(np.float32)
            examples.append((np.frombuffer(r["places"], dtype="<i4"), count / count.sum(), r["label"], weight))
    return sgd(examples, bits, **options)


def probabilities(texts: list[str | None], model: Model) -> np.ndarray:
    doc, place = features(texts, model.bits)
    margin = model.bias + total(doc, model.places[place], len(texts)) / np.maximum(total(doc, None, len(texts)), 1)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of df (or those in keep) and the score of each text."""
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**(bits + 1) numbers

    def make() -> callable:
        return lambda texts: [pa.array(probabilities(texts, held.value))]

    return appended(df, text_col, make, f"{name} double", keep)
