"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the presence of its words, word pairs, and pairs with one or two words between, hashed
into 2**bits places. Training is FTRL-proximal with per-coordinate rates on a bounded, labelled sample
(``cap`` documents a label value and ``most_bytes`` of features at most, documented bounds; weights restore the
whole table's mix of labels). Rate and L1 penalty are chosen among ``settings`` by the log loss of a third of that
sample, kept apart; the penalty leaves few weights, and those alone are broadcast (at most 2**bits of them).
Scoring reads every text whole, in one map.

Defined results: null, empty and blank texts have no feature and get the score of the bias; repeated rows
give repeated rows; an empty table gives an empty one; without training rows every score is 0.5; a null id is
scored like any other and never learned from; of settings with equal losses the first counts; a column with the name
of the result is replaced, and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Words, appended, bounded_rows, labelled_sample, mix, ready, slices, total

SIGNS = b".,!?;:\"'()[]{}<>#$%&*|"


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature occurrence."""
    words = Words(texts, strip=SIGNS)
    h, doc = words.hashes, words.doc
    docs, hashes = [doc], [h]
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:] if len(h) > gap else np.zeros(0, dtype=bool)
        a, b = (h[:-gap][same], h[gap:][same]) if len(same) else (h[:0], h[:0])
        docs.append(doc[:-gap][same] if len(same) else doc[:0])
        hashes.append(mix(a * np.uint64(3) + b + np.uint64(gap)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def encoded(places: np.ndarray) -> bytes:
    """Ascending places as 16-bit gaps; 65535 stands for a gap that goes on."""
    gaps = np.diff(places, prepend=-1) - 1
    more = gaps // 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, dtype="<u2")
    out[np.cumsum(more + 1) - 1] = gaps % 65535
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, dtype="<u2")
    ends = gaps != 65535
    return (np.cumsum(gaps, dtype=np.int64)[ends] + np.arange(int(ends.sum()))).astype(np.int32)


def _collect(bits: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 1 << 20):
            doc, place = features(part.column(3).to_pylist(), bits)
            keys = np.unique((doc << bits) | place)
            stops = np.searchsorted(keys, np.arange(1, part.num_rows) << bits)
            rows = [encoded(x & ((1 << bits) - 1)) for x in np.split(keys, stops)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.binary())], ["label", "weight", "draw", "places"])

    return run


@dataclass
class Weights:
    places: np.ndarray
    values: np.ndarray
    bias: float
    bits: int


def ftrl(rows: list[tuple[np.ndarray, int, float]], bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 6, seed: int = 7) -> Weights:
    """FTRL-proximal over presence features of (places, label, weight); the bias is not penalised."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            at, y, weight = rows[k]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = weight * (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y)
            step = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at], n[at] = za + g - step * w, na + g * g
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b, nb + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    places = np.flatnonzero(w)
    return Weights(places, w[places], float(-zb / ((beta + np.sqrt(nb)) / alpha)) if nb else 0.0, bits)


def loss(rows: list[tuple[np.ndarray, int, float]], weights: Weights) -> float:
    """The weighted log loss of some rows."""
    dense = np.zeros(1 << weights.bits)
    dense[weights.places] = weights.values
    margin = np.array([dense[at].sum() + weights.bias for at, *_ in rows])
    y, weight = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    return float((weight * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", cap: int = 4000, bits: int = 18, most_bytes: int = 24 << 20, settings: tuple = ((0.3, 8.0), (1.0, 8.0), (1.0, 16.0)), **options) -> Weights:
    """Weights from at most cap documents a label value, and most_bytes of features; docs and labels: the rows to learn from."""
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, cap).select(F.col("label").cast("int").alias("label"), "weight", "draw", "text")
    found = bounded_rows(sample.mapInArrow(_collect(bits), "label int, weight double, draw long, places binary"), "toxicity-sample", most_bytes)
    rows = [(decoded(r["places"]), r["label"], weight) for r, weight in found]
    del found
    train, apart = [r for k, r in enumerate(rows) if k % 3 != 2], rows[2::3]
    best = dict(zip(("alpha", "l1"), settings[0], strict=True))
    if len(settings) > 1 and apart and len({y for _, y, _ in train}) > 1:
        tried = {(alpha, l1): loss(apart, ftrl(train, bits, **{**options, "alpha": alpha, "l1": l1, "epochs": 2})) for alpha, l1 in settings}
        best = dict(zip(("alpha", "l1"), min(tried, key=tried.get), strict=True))
    return ftrl(rows, bits, **(best | options))


def probabilities(texts: list[str | None], weights: Weights, dense: np.ndarray) -> np.ndarray:
    doc, place = features(texts, weights.bits)
    hit = dense[place] != 0
    keys = np.unique((doc[hit] << weights.bits) | place[hit])
    margin = weights.bias + total(keys >> weights.bits, dense[keys & ((1 << weights.bits) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score(df: DataFrame, weights: Weights, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of df (or those in keep) and the score of each text."""
    held = df.sparkSession.sparkContext.broadcast(weights)

    def make() -> callable:
        w = held.value
        dense = np.zeros(1 << w.bits)
        dense[w.places] = w.values
        return lambda texts: [pa.array(probabilities(texts, w, dense))]

    return appended(df, text_col, make, f"{name} double", keep)


def predicted(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
