"""What the operators of this subpackage share: folds, samples, columns made in Arrow batches, word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.tables import new_path, ready, written  # noqa: F401

#: The white space of the word contracts, x20 and x09 to x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """df's columns but for these names, in any case: an operator's results replace columns of the same name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def appended(df: DataFrame, text_col: str, make: Callable, ddl: str, keep: Iterable[str] | None = None, rows: int = 256, most_bytes: int = 1 << 20) -> DataFrame:
    """The columns of df (or those in keep) and the new ones of ddl, made of the text in Arrow batches.

    make() is called once a task and gives a function from a list of texts to a list of Arrow arrays. A column
    of df with a new one's name is replaced. The text comes back only if it is among the columns kept."""
    ready(df.sparkSession)
    new = T.StructType.fromDDL(ddl)
    names = without(df if keep is None else df.select([quoted(c) for c in keep]), new.names)
    known = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([T.StructField(c, known[c], True) for c in names] + [T.StructField(f.name, f.dataType, True) for f in new.fields])
    held = names.index(text_col) if text_col in names else None
    given = df.select([quoted(c) for c in names] + ([quoted(text_col)] if held is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in slices(batches, rows, most_bytes):
            texts = part.column(len(names) if held is None else held).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *function(texts)], out.names)

    return given.mapInArrow(run, out)


def slices(batches: Iterator, rows: int = 512, most_bytes: int = 16 << 20) -> Iterator:
    """Arrow record batches in pieces of few rows and bytes, which bounds what Python holds at once."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes / batch.num_rows * rows > most_bytes:
            step = max(1, int(most_bytes / (batch.nbytes / batch.num_rows)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... (lengths[i] of each), one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Lookup:
    """token -> value with two generations: holds at most about 2 * limit tokens, keeps those in use."""

    def __init__(self, make_many: Callable[[list], list], limit: int = 250_000):
        self.young: dict = {}
        self.old: dict = {}
        self.make_many, self.limit = make_many, limit

    def fill(self, tokens: set) -> dict:
        """A dictionary that has all of tokens."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new = []
        for t in tokens.difference(self.young):
            v = self.old.get(t)
            if v is None:
                new.append(t)
            else:
                self.young[t] = v
        if new:
            self.young.update(zip(new, self.make_many(new), strict=True))
        return self.young


# --- word arrays -----------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of them."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)

        def table(base: int) -> np.ndarray:
            out, step = np.ones(size, dtype=np.uint64), 1
            while step < size:
                out[step : 2 * step] = out[:step] * np.uint64(pow(base, step, 1 << 64))
                step *= 2
            return out

        _POW, _INV = table(_BASE), table(inverse)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts as arrays. hashes: 64 bits a word; doc: the text of each word; first: each text's first word, and the end.

    Over UTF-8 bytes: white space and A-Z are single bytes there. strip: further bytes that part words."""

    def __init__(self, texts: list[str | None], lower: bool = True, strip: bytes = b""):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        if lower:
            joined = joined.lower()
        if strip:
            joined = joined.translate(bytes.maketrans(strip, b" " * len(strip)))
        self.bytes = buf = np.frombuffer(joined, dtype=np.uint8)
        blank = SPACE[buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2][: len(edge[0::2])]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        powers, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=self.sums[1:])
        self.hashes = mix((self.sums[self.end] - self.sums[self.start]) * self.inverse[self.start])

    def __len__(self) -> int:
        return len(self.start)


class Characters:
    """The code points of some texts, each text closed by a newline. doc: the text of each; blank: white space."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "") + "\n" for t in texts]
        self.points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        self.blank = (self.points == 32) | (self.points >= 9) & (self.points <= 13)


def total(doc: np.ndarray, weights: np.ndarray | None, docs: int) -> np.ndarray:
    """The sum of weights (None: the count) for each text."""
    return np.bincount(doc, weights, docs)


def draw_below(cap: int, n: int) -> int:
    """A bound on a uniform signed 64-bit hash that about 2 * cap + 64 of n rows keep to, all if n is no more."""
    return min((1 << 63) - 1, -(1 << 63) + ((2 * cap + 64) << 64) // max(1, n))


#: Label values that a training set may have: each is a row on the driver, and a column of a language model.
MOST_LABELS = 256
#: How often an id that many rows have counts in a training set.
TWICE = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, weight, draw, text) of cap ids a label value at most, those of the least hashes: the bound of a training set.

    weight tells how many labelled ids a drawn one stands for, scaled to a mean of one over all drawn, so that what is
    learned follows the whole table's mix of labels at every size. Of several labels for an id the largest counts, of
    several texts the one of the least hash, twice at most. The
    drawn ids, bounded by the cap, are broadcast. More than MOST_LABELS label values are an error: none is left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} values; map rare or malformed ones before learning from them")
    kind = labels.schema[label].dataType
    if not sizes:
        return docs.sparkSession.createDataFrame([], T.StructType().add("label", kind).add("weight", "double").add("draw", "long").add("text", "string"))
    by_label = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast(kind), F.lit(v))])[F.col("label")]
    drawn = {k: min(cap, n) for k, n in sizes.items()}
    scale = sum(drawn.values()) / sum(sizes.values())
    weight = by_label({k: n / drawn[k] * scale for k, n in sizes.items()})
    some = known.withColumn("draw", F.xxhash64("id", F.lit(17))).where(F.col("draw") <= by_label({k: draw_below(cap, n) for k, n in sizes.items()}))
    # At most about 2 * cap rows a label value are ranked.
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))).where(F.col("rank") <= cap)
    chosen = ranked.select("id", "label", "draw", weight.alias("weight"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # However many rows have an id, TWICE is the most that it counts.
    held = rows.groupBy("id", "label", "weight", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.least(F.count("*"), F.lit(TWICE)).cast("int").alias("held"))
    return held.select("label", "weight", "draw", "text", F.explode(F.sequence(F.lit(1), F.col("held"))).alias("copy")).drop("copy")


def bounded_rows(features: DataFrame, name: str, most_bytes: int) -> list:
    """Rows (label, weight, draw, and binary columns) on the driver: of each label value those of the least draws, within
    an equal share of most_bytes. They are written first, so nothing is computed twice, and only the rows kept are sent.

    Rows left out by the bound pass their weight on to the label's others. A label whose first row alone passes its share
    is an error, not left out: operators bound a row's features so that none does."""
    held = written(features, name)
    binary = [f.name for f in held.schema.fields if isinstance(f.dataType, T.BinaryType)]
    # Numbers alone are ranked; the features stay where they are until those kept are sent.
    sizes = held.select("label", "draw", "weight", sum((F.length(c) for c in binary), F.lit(64)).cast("long").alias("size")).groupBy("label", "draw").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    total = F.sum("size").over(Window.partitionBy("label").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    labels = max(1, held.select("label").distinct().count())
    cut = sizes.withColumn("total", total).groupBy("label").agg(F.max(F.when(F.col("total") <= most_bytes // labels, F.col("draw"))).alias("last"), F.sum("weight").alias("every"))
    lost = cut.where("last IS NULL").select("label").take(1)
    if lost:
        raise ValueError(f"the first row of label {lost[0]['label']!r} has more than {most_bytes // labels} bytes of features; raise most_bytes")
    rows = held.join(F.broadcast(cut), "label").where("draw <= last").collect()  # cut: a row a label
    rows.sort(key=lambda r: (r["draw"], str(r["label"]), *(r[c] for c in binary)))
    share = {}
    for r in rows:
        share[r["label"]] = share.get(r["label"], 0.0) + r["weight"]
    return [(r, r["weight"] * r["every"] / share[r["label"]]) for r in rows]
