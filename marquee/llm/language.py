"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Characters other than letters count as one blank, letters in lower case; n-grams of one to three
characters are hashed into 2**bits places. Document frequencies are counted over all documents that may be
learned from. Training follows the regularised leader (FTRL) with an elastic net, on a bounded sample of
``cap`` documents a language and ``most_bytes`` of features at most (documented bounds; weights restore the whole
table's mix of languages; a drawn document gives at most its 6,128 most frequent n-grams, so that each of up to
MOST_LABELS languages has its share, and more languages are an error); a fourth of the sample is kept apart for the temperature that calibrates the scores. A term's weight is its share of the text's n-grams times its
inverse document frequency, so a text's logits are sums over its n-grams and whole texts of any length are
scored in one map.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if
nothing can be learned from; equal scores go to the language first in order; repeated rows give repeated
rows; an empty table gives an empty one; a null id is told like any other and never learned from; columns named
lang_pred or lang_score are replaced, and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import MOST_LABELS, TWICE, Characters, appended, bounded_rows, labelled_sample, mix, ready, slices, total

SCALE, BLANK = 50.0, 32
_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    """The lower case of each letter's code point, a blank for all others."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.full(0x110000, BLANK, dtype=np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                _LOWER[c] = ord(low) if len(low := s.lower()) == 1 else c
    return _LOWER


def grams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place) of every n-gram that holds a letter, and whether each text has a letter."""
    held = Characters(texts)
    c, doc = _lower()[held.points].astype(np.uint64), held.doc
    letter = c != BLANK
    docs, places = [], []
    code, any_letter = np.zeros(len(c), dtype=np.uint64), np.zeros(len(c), dtype=bool)
    for n in (1, 2, 3):
        end = len(c) - n + 1
        if end <= 0:
            break
        code, any_letter = code[:end] * np.uint64(0x1FFFFF) + c[n - 1 :], any_letter[:end] | letter[n - 1 :]
        fine = any_letter & (doc[:end] == doc[n - 1 :])
        docs.append(doc[:end][fine])
        places.append((mix(code[fine] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(places), total(doc, letter, len(texts)) > 0


def _frequencies(bits: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(1 << bits, dtype=np.int64), 0
        for part in slices(batches, 256, 1 << 20):
            doc, place, _ = grams(part.column(0).to_pylist(), bits)
            order = np.argsort(doc, kind="stable")
            stops = np.searchsorted(doc[order], np.arange(1, part.num_rows))
            for own in np.split(place[order], stops):
                flags = np.zeros(1 << bits, dtype=bool)
                flags[own] = True
                held += flags
            documents += part.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*held[at].tolist(), documents], pa.int64())], ["place", "documents"])

    return run


def _examples(bits: int, most: int) -> callable:
    """Each text's places and counts, of the ``most`` frequent ones (the lesser place of equals)."""

    def frequent(place: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
        if len(place) > most:
            kept = np.sort(np.lexsort((place, -count))[:most])
            place, count = place[kept], count[kept]
        return place.tobytes(), count.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 1 << 20):
            doc, place, _ = grams(part.column(3).to_pylist(), bits)
            keys, counts = np.unique((doc << bits) | place, return_counts=True)
            stops = np.searchsorted(keys, np.arange(1, part.num_rows) << bits)
            rows = [frequent(*r) for r in zip(*(np.split(x, stops) for x in ((keys & ((1 << bits) - 1)).astype("<i4"), counts.astype("<i4"))), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], ["label", "weight", "draw", "places", "counts"])

    return run


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # place x language: weight times inverse document frequency
    bias: np.ndarray
    temperature: float
    bits: int


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, float]], size: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal with L1 and L2 penalties, of (places, values, class, weight); the bias is not penalised."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    zb, nb = np.zeros(classes), np.full(classes, 1e-9)

    def solve(z, n, l1=l1, l2=l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            at, x, y, weight = rows[k]
            za, na = z[at], n[at]
            w, b = solve(za, na), solve(zb, nb, 0.0, 0.0)
            g = _softmax(x @ w + b)
            g[y] -= 1
            g *= weight
            each = x[:, None] * g
            z[at], n[at] = za + each - (np.sqrt(na + each * each) - np.sqrt(na)) / alpha * w, na + each * each
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b, nb + g * g
    return solve(z, n), solve(zb, nb, 0.0, 0.0)


def fit(docs: DataFrame, cap: int = 800, bits: int = 16, most_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """docs: the rows to learn from. Frequencies cover all of them, training at most cap a language and most_bytes of features."""
    ready(docs.sparkSession)
    docs = docs.where(F.col(lang_col).isNotNull())
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(bits), "place int, documents long").groupBy("place").agg(F.sum("documents").alias("n")).collect()  # a row a place
    held = {r["place"]: r["n"] for r in counted}
    known = docs.select(id_col, text_col, lang_col)
    sample = labelled_sample(known, known, lang_col, cap, id_col, text_col)
    found = bounded_rows(sample.mapInArrow(_examples(bits, max(64, most_bytes // MOST_LABELS // (8 * TWICE) - 16)), "label string, weight double, draw long, places binary, counts binary"), "language-sample", most_bytes)
    rows = [(r["places"], r["counts"], r["label"], weight) for r, weight in found if r["places"]]
    if not rows:
        return None
    documents = held.pop(-1)
    idf = np.full(1 << bits, np.log(documents + 1) + 1)
    idf[list(held)] = np.log((documents + 1) / (np.array(list(held.values())) + 1)) + 1
    languages = sorted({r[2] for r in rows})
    examples = []
    for p, c, label, weight in rows:
        at, count = np.frombuffer(p, dtype="<i4"), np.frombuffer(c, dtype="<i4")
        examples.append((at, SCALE * count / count.sum() * idf[at], languages.index(label), weight))
    apart = examples[3::4] if len(examples) >= 16 else examples
    w, bias = ftrl([x for k, x in enumerate(examples) if k % 4 != 3] if len(examples) >= 16 else examples, 1 << bits, len(languages))
    logits = np.array([x @ w[at] + bias for at, x, *_ in apart])
    truth, shares = np.array([y for *_, y, _ in apart]), np.array([weight for *_, weight in apart])
    losses = {t: -(shares * np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))).mean() for t in np.geomspace(0.2, 8, 75).tolist()}
    return Model(languages, (w * idf[:, None]).astype(np.float32), bias, min(losses, key=losses.get), bits)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    doc, place, letters = grams(texts, model.bits)
    each = np.maximum(total(doc, None, len(texts)), 1)
    sums = np.stack([total(doc, column[place], len(texts)) for column in np.ascontiguousarray(model.table.T)], axis=1)
    p = _softmax((SCALE * sums / each[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    return [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, p[np.arange(len(texts)), best], 0.0).tolist()


def identify(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of df (or those in keep), with lang_pred and lang_score."""
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**bits places for each language

    def make() -> callable:
        def told(texts: list[str | None]) -> list[pa.Array]:
            languages, scores = predict(texts, held.value)
            return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]

        return told

    return appended(df, text_col, make, "lang_pred string, lang_score double", keep)
