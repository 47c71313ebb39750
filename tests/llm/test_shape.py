"""Shards, whitening and collocations against plain versions, on odd rows and empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import sharding, whitening

DOCS = "doc_id long, text string, source string, size string, Shard int"


def _plain_shards(rows, shards, seed=7):
    """(id, size, crc, shard, slot) by sorting everything at once."""
    number = lambda *parts, digits=15: int(hashlib.md5("|".join(parts).encode()).hexdigest()[:digits], 16)
    known = []
    for i, t, source in rows:
        data = (t or "").encode()
        draw = number(str(seed), "" if i is None else str(i), str(zlib.crc32(data)))
        known.append(("" if source is None else "s" + source, draw, (i is not None, i or 0), zlib.crc32(data), len(data) + 1, i))
    of = {}
    for r in sorted(known):
        of.setdefault(r[0], []).append(r)
    every = []
    for name, held in of.items():
        u = number(str(seed), name, digits=13) / 16.0**13
        every += [((rank + u) / len(held), *r) for rank, r in enumerate(held)]
    every.sort()
    out, n, before = [], len(every), Counter()
    for place, r in enumerate(every):
        shard = place * shards // n
        out.append((r[-1], r[-2], r[-3], shard, before[shard]))
        before[shard] += 1
    return out


def test_shards_equal_a_plain_sort_and_hold_the_mixture(spark):
    draw = np.random.default_rng(3)
    rows = [(i, "x" * int(draw.integers(0, 40)) + "é" * (i % 3), f"s{i % 7 if i % 3 else 0}") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", None), (5002, "long " * 200_000, "s1"), (None, "no id", "s2"), (None, None, None), (7, rows[7][1], "s0"), (7, rows[7][1], "s0")]
    rows += [(6000 + k, "only", f"single{k}") for k in range(40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    got = sharding.interleave(df, keep=["source", "size"]).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == Counter(_plain_shards(rows, 8))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    total, held = Counter(r["source"] for r in got), Counter((r["source"], r["shard"]) for r in got)
    assert all(abs(held[s, k] - total[s] / 8) < 2 for s in total for k in range(8))
    # Sources of one row each don't meet in a shard.
    assert len({r["shard"] for r in got if (r["source"] or "").startswith("single")}) == 8


def test_shards_of_a_row_that_most_repeat_and_of_few_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("one").alias("source"))
    got = sharding.interleave(df, shards=3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [1333, 1333, 1334]
    assert sorted(Counter(r["shard"] for r in got if r["doc_id"] == 1).values())[0] > 800
    for k in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(Counter(r["shard"] for r in got)[k]))
    few = sharding.interleave(df.where("doc_id in (3000, 3001, 3002)")).collect()
    assert len(few) == 3 and {r["slot"] for r in few} == {0} and len({r["shard"] for r in few}) == 3
    assert sharding.interleave(df.where("false")).count() == 0
    with_seed = lambda s: {(r["doc_id"], r["shard"]) for r in sharding.interleave(df.where("doc_id > 1"), seed=s).collect()}
    assert with_seed(1) == with_seed(1) != with_seed(2)


VECTORS = "vec_id long, embedding array<float>, n string, Component int"


def _check_whitening(spark, rows, components):
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], VECTORS).repartition(3)
    got = whitening.whiten(df).collect()
    size = Counter(len(v) for _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)).most_common(1)[0][0]
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    assert len(got) == n * components
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, k + 1) for i, _ in good for k in range(components))
    deviation = {}
    for (i, _), row in zip(good, x.tolist(), strict=True):
        deviation.setdefault(i, set()).add(sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True)))
    assert all(r["deviation"] in deviation[r["vec_id"]] and r["n"] == n for r in got)
    for k in range(components):
        mine = [r for r in got if r["component"] == k + 1]
        assert all(abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9 for r in mine)
        want = y @ vectors[:, k] / np.sqrt(e[k])
        of = {}
        for (i, _), w in zip(good, want, strict=True):
            of.setdefault(i, []).append(w)
        same = [of[r["vec_id"]] for r in mine]
        sign = np.sign(np.dot([s[0] for s in same], [r["whitened"] for r in mine]))
        assert all(min(abs(sign * r["whitened"] - w) for w in s) < 1e-6 for r, s in zip(mine, same, strict=True))
        white = np.array([r["whitened"] for r in mine])
        assert abs(white.mean()) < 1e-9 and abs(white.std() - 1) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    return got


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(c) for c in draw.normal(size=12) @ np.diag(2.0 ** -np.arange(12)) + 3]) for i in range(400)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    _check_whitening(spark, [*rows, *odd, (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])], 8)


def test_whitening_of_very_unequal_and_dependent_dimensions(spark):
    draw = np.random.default_rng(6)
    rows = []
    for i in range(300):
        a, b, c = draw.normal(size=3)
        rows.append((i, [float(v) for v in (1000 * a, b, c / 30, 0.25, 1000 * a, b)]))
    # One dimension is constant and two repeat others: three components have variance.
    _check_whitening(spark, rows, 3)
    assert whitening.whiten(spark.createDataFrame([(i, v, "", 0) for i, v in rows[:1]], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, rows[0][1], "", 0) for i in range(5)], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_deviations_that_pass_64_bits_raise():
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[10**6]]), np.array([0]), 10**6)
