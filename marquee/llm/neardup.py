"""Near-duplicate groups by Fast Similarity Sketching, banding and exact verification.

A text's set is its distinct k-word shingles. The sketch has ``coordinates`` bins: in each of the first
``coordinates`` rounds every shingle is thrown into one hashed bin with the round's number before its hash,
in as many further rounds into the bin of the round's own number, and each bin keeps the least value. So
every bin is filled, and two sketches agree in a share of their bins that is concentrated about the
similarity of the sets. Texts with equal sets are one class; a class's bins are read in bands, and classes
that share a band are candidates.

No band expands into all its pairs. (1) Every class of a band is verified against the band's least class,
its hub, on full sets, and links give components. (2) The classes that share a band with a hub of another
component are that component's outsiders: they are queried against all classes that share a band with the
component and whose size lets them be similar, in blocks bounded by rows and by shingles; hashed sets meet
there, texts don't, and only the links come out. So every link of two texts that share a band counts. A pair at
the threshold of 0.8 shares none of 42 bands of 6 with a probability of 3e-6.

Copies: classes are found by aggregation, so a third of all rows being one text makes one class; joins on
hubs and classes read written tables on both sides, so that adaptive execution can split them.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and form a
component of their own; a text with fewer than k words is one shingle, the whole sequence; repeated rows
give repeated rows; a row of a null id is linked only to texts of an equal set, whose component it takes, else
its component is null and it is kept; of a component's rows those of its least id are kept, all of them where
that id repeats; texts of any length are sketched whole; an empty table gives an empty one; other columns are left out.
Ids are what tells documents apart: give rows with one id and different texts a number each before (the pipeline does).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Words, mix, ready, slices, spread, written
from marquee.operators.graph import components, joined
from marquee.tables import tidy

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct k-word shingles, A-Z lower-cased."""
    words = Words(texts)
    h, first = words.hashes, words.first
    n = len(h) - k + 1
    folded = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k):
        if n > 0:
            folded = mix(folded * np.uint64(3) + h[i : i + n] + _STEP)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(folded[a : b - k + 1]))
        else:
            whole = np.zeros(1, dtype=np.uint64)
            for i in range(a, b):
                whole = mix(whole * np.uint64(3) + h[i : i + 1] + _STEP)
            out.append(whole[: min(1, b - a)])
    return out


class Sketch:
    """Fast similarity sketches of sets of 64-bit hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.t = bands, rows, bands * rows
        self.salts = mix(np.arange(1, 2 * self.t + 1, dtype=np.uint64) * _STEP)

    def bins(self, items: np.ndarray) -> np.ndarray:
        t, low = self.t, np.uint64(0xFFFFFFFF)
        bins = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
        at, block = 0, int(min(t, max(1, np.ceil(t * (np.log(t) + 1) / len(items)))))
        while at < t and (at == 0 or (bins == np.iinfo(np.uint64).max).any()):
            rounds = np.arange(at, min(t, at + block), dtype=np.uint64)
            h = mix(items[None, :] ^ self.salts[at : at + len(rounds), None])
            where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            np.minimum.at(bins, where.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (h & low)).ravel())
            at += len(rounds)
        for b in np.flatnonzero(bins == np.iinfo(np.uint64).max).tolist():  # the rounds that fill a bin for certain
            h = mix(items ^ self.salts[t + b])
            bins[b] = (np.uint64(t + b) << np.uint64(32)) | (h & low).min()
        return bins

    def keys(self, items: np.ndarray) -> np.ndarray:
        rows = self.bins(items).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _STEP
        for i in range(self.rows):
            key = mix(key * np.uint64(3) + rows[:, i] + _STEP)
        return key.view(np.int64)


def _sketches(k: int, bands: int, rows: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bands, rows)
        for part in slices(batches, 256, 1 << 20):
            sets = shingle_sets(part.column(1).to_pylist(), k)
            with np.errstate(over="ignore"):
                first = [int(np.bitwise_xor.reduce(mix(s + _STEP)).view(np.int64)) if len(s) else None for s in sets]
                second = [int(np.add.reduce(mix(s ^ _STEP)).view(np.int64)) if len(s) else None for s in sets]
            keys = pa.array([sketch.keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), keys], ["id", "n_shingles", "k1", "k2", "bands"])

    return run


def _shared(k: int) -> callable:
    """How many shingles the two texts of a pair share; a side that comes again and again is taken apart once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 2 << 20):
            left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
            distinct = list(dict.fromkeys([*left, *right]))
            sets = dict(zip(distinct, shingle_sets(distinct, k), strict=True))
            both = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64())], ["u", "v", "shared"])

    return run


def _sets(k: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 1 << 20):
            items = [x.tobytes() for x in shingle_sets(part.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["id", "items"])

    return run


def shared_counts(own: list[np.ndarray], other: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of own how many items it shares with each of other; memory is that of other's items."""
    owner = np.repeat(np.arange(len(other)), [len(s) for s in other])
    items = np.concatenate(other)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    for s in own:
        low = np.searchsorted(items, s)
        yield np.bincount(owner[spread(low, np.searchsorted(items, s, "right") - low)], minlength=len(other))


def _block_links(percent: int) -> callable:
    """Links between the two sides of each block; rows come ordered by block."""

    def links(rows: list[tuple]) -> Iterator[tuple]:
        left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not left or not right:
            return
        own, other = ([np.frombuffer(r[3], dtype=np.uint64) for r in side] for side in (left, right))
        sizes = np.array([len(s) for s in other])
        for u, s, shared in zip(left, own, shared_counts(own, other), strict=True):
            for j in np.flatnonzero(100 * shared >= percent * (len(s) + sizes - shared)).tolist():
                v = right[j]
                if u[2] != v[2]:
                    yield max(u[1], v[1]), min(u[1], v[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, kind = [], None, None
        for part in slices(batches, 256, 2 << 20):
            kind, found = part.schema.field(5).type, []
            for *key, role, i, component, items in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != block:
                    found += links(held)
                    held, block = [], key
                held.append((role, i, component, items))
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kind) for n in (0, 1)], ["u", "v"])
        if held:
            found = list(links(held))
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kind) for n in (0, 1)], ["u", "v"])

    return run


def _between(groups: DataFrame, texts: DataFrame, k: int, percent: int, kind: str, left: int = 128, right: int = 512, left_items: int = 1 << 18, right_items: int = 1 << 20) -> DataFrame:
    """Links of the outsiders of each group (g, id, part, n) with its members of like size, in blocks of about
    left x right sets and left_items x right_items shingles."""
    # Similar sets are of one size class or of neighbouring ones (the width is rounded up).
    width = float(np.log(100 / percent)) * 1.0001 if percent < 100 else 1.0
    groups = groups.withColumns({"out": F.col("part") != F.col("g"), "c": F.floor(F.log("n") / width).cast("int")})
    mine = groups.where("out")
    rest = groups.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    blocks_of = lambda df, name, most, items: df.groupBy("g", "c").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / items)).cast("int").alias(name))
    sizes = written(blocks_of(mine, "bu", left, left_items).join(blocks_of(rest, "bv", right, right_items), ["g", "c"]), "block-sizes")
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int").alias(n)
    mine = mine.join(sizes, ["g", "c"]).select("g", "c", own("bu", 0), spread_over("bv"), F.lit(True).alias("role"), "id", "part")
    rest = rest.join(sizes, ["g", "c"]).select("g", "c", spread_over("bu"), own("bv", 1), F.lit(False).alias("role"), "id", "part")
    rows = mine.union(rest)
    needed = groups.join(sizes.select("g").distinct(), "g", "left_semi").select("id").distinct()
    items = texts.join(needed, "id", "left_semi").mapInArrow(_sets(k), f"id {kind}, items binary")
    blocks = rows.join(items, "id").select("g", "c", "bu", "bv", "role", "id", "part", "items")
    return blocks.repartition("g", "c", "bu", "bv").sortWithinPartitions("g", "c", "bu", "bv").mapInArrow(_block_links(percent), f"u {kind}, v {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, kind: str) -> DataFrame:
    """pairs (u, v, n_u, n_v) with the number of shared shingles."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(_shared(k), f"u {kind}, v {kind}, shared long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): links are 100 * intersection >= percent * union; kept is each component's least id."""
    ready(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(docs.mapInArrow(_sketches(k, bands, rows), f"id {kind}, n_shingles long, k1 long, k2 long, bands array<long>"), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.where("rep IS NOT NULL"), "classes")

    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("held")).where("held > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("n_hub"), "held")
    members = written(joined(banded, hubs, "key", classes.count() * bands).where("rep <> hub"), "members")
    # Sizes alone rule out a link: the intersection has at most the smaller set, the union at least the larger.
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    stars = written(members.where(fits(F.col("n"), F.col("n_hub"))).groupBy(F.col("rep").alias("u"), F.col("hub").alias("v")).agg(F.first("n").alias("n_u"), F.first("n_hub").alias("n_v")), "stars")
    needed = members.select(F.col("rep").alias("id")).union(members.select("hub")).distinct()
    texts = written(docs.join(needed, "id", "left_semi"), "texts")

    tidy(df.sparkSession)
    counted = written(stars.join(_verified(stars, texts, k, kind), ["u", "v"]), "star-links")
    linked = F.expr(f"100 * shared >= {percent} * (n_u + n_v - shared)")
    found = counted.where(linked).select("u", "v")
    parts = written(components(found), "parts")

    of = lambda df, column, name: df.join(parts.select(F.col("id").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))
    groups = written(of(of(members.select("rep", "hub", "n").distinct(), "rep", "part"), "hub", "g").select("g", F.col("rep").alias("id"), "part", "n").distinct(), "groups")
    more = written(_between(groups, texts, k, percent, kind).distinct(), "more-links")
    if more.take(1):
        parts = written(components(found.union(more)), "parts")

    # Classes whose component isn't that of the row's own id: those with links, and those with copies.
    moved = of(classes.select("k1", "k2", "rep"), "rep", "part").select("k1", "k2", F.col("part").alias("component"))
    moved = written(moved, "class-parts")
    result = sketched.select("id", "n_shingles", "k1", "k2").join(moved, ["k1", "k2"], "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return result.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
