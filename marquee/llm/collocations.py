"""Phrase collocations from a weighted de Bruijn graph.

Texts are cut into pieces at signs, pieces into words. Every position of a piece begins an edge: its five words, from the
node of the first four to that of the last four; near a piece's end, where fewer follow, what begins there ends early.
Edges are the only thing counted from the texts:

1. Tasks gather a few megabytes of text, number their words in the order of their bytes, and add up equal edges.
2. The edges are cut into ranges of their order (by language, then word by word), whose bounds are quantiles of a sample
   of positions. A range is one task's; a frequent word or pair, whatever its share, simply spans several ranges.
3. A task merges its sorted edges. Edges of a common node lie together, and so do nodes of common first words: the flow out
   of a node, with the piece ends at it, is the node's own count, and sums of nodes give the counts of three, two and
   one words (and none: the language's words). Nodes that only one edge leaves, without an end, and likewise shorter
   phrases that only one node continues, are unary paths: a path is one row with the lengths it stands for.
4. Rows of fewer than ``least`` occurrences end there, but for the paths at a range's two ends, whose counts go on in the
   next range; one small aggregation adds these up.

Then candidates are cut, scored in exact decimals and held against the longer ones that contain them.

Defined results: null texts have no words, null languages are ``und``; a text of any length is read in segments that share
four words, so its phrases are whole; repeated rows count as often as they are there; equal scores are ranked by count,
then phrase, in the order of bytes; an empty table gives an empty one; other columns are left out."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import ready, slices, written

#: Kinds of bytes: 1 between words, 2 between pieces.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 3

#: Words of the longest phrase, bytes of text that a task gathers before it adds up, and bytes of text to a range.
LONGEST, GATHERED, TO_RANGE = 5, 5 << 20, 8 << 20
#: Sampled positions a range; parts in which a language's phrases are ranked before the last ranking.
SAMPLED, PARTS = 64, 32
#: Ranges at most, each a bound on the driver: from 8 TB of text on, ranges grow instead (at 100 TB to 95 MB, some 1.5 GB a task).
MOST_RANGES = 1 << 20
_BLOB = "range int, lang string, words binary, ids binary, counts binary, edges long"


class Pieces:
    """The words of some texts. start, end: bytes of each; piece: its number; text: the text it is of."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        kinds = _KINDS[self.data]
        blank = kinds > 0
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kinds & 2), self.start)
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.text = np.searchsorted(ends, self.start, "right")

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> pa.Array:
        lengths = self.end - self.start
        flags = np.zeros(len(self.data) + 1, dtype=np.int8)
        flags[self.start] = 1
        flags[self.end] -= 1
        data = self.data[np.cumsum(flags[:-1], dtype=np.int8) > 0]
        cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(data)])

    def followed(self, codes: np.ndarray) -> np.ndarray:
        """For each position its word and the next four of its piece; 0 where the piece has ended."""
        out = np.zeros((len(codes), LONGEST), dtype=np.int32)
        for k in range(LONGEST):
            n = max(len(codes) - k, 0)
            out[:n, k] = np.where(self.piece[k:] == self.piece[:n], codes[k:], 0)
        return out


def segments(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of their positions are counted): a text in parts of about ``most`` bytes that share their last words."""
    at, size = 0, most
    while len(text) - at > size:
        part = Pieces([text[at : at + size]])
        # The last word may go on, and the four before it (in its piece or not) lack words that follow.
        keep = max(len(part) - LONGEST, 0)
        if keep == 0:
            size *= 2  # words of a segment's length
            continue
        yield text[at : at + size], keep
        at, size = at + int(part.start[keep]), most
    yield text[at:], -1


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Languages, texts in small letters and counted positions (-1: all), some megabytes at a time."""
    langs, raw, counted, size = [], [], [], 0
    for part in slices(batches, 512, 4 << 20):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for data, keep in segments(text.encode("utf-8", "surrogatepass").lower(), most // 2):
                langs.append(lang)
                raw.append(data)
                counted.append(keep)
                size += len(data)
                if size >= most:
                    yield langs, raw, counted
                    langs, raw, counted, size = [], [], [], 0
    if raw:
        yield langs, raw, counted


def _counted(pieces: Pieces, counted: list[int]) -> np.ndarray:
    """Which positions are counted here, and not in the segment that follows."""
    limits = np.array([np.iinfo(np.int64).max if k < 0 else k for k in counted])
    first = np.searchsorted(pieces.text, np.arange(len(counted)))
    return np.arange(len(pieces)) - first[pieces.text] < limits[pieces.text]


def _sampled(step: int, gathered: int) -> callable:
    """(lang, words): every step-th position's edge, from a place that differs from gathering to gathering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, raw, counted in _gathered(batches, gathered):
            pieces = Pieces(raw)
            known = np.flatnonzero(_counted(pieces, counted))
            picked = known[zlib.crc32(raw[0]) % step :: step] if len(known) else known
            rows = []
            for i in picked.tolist():
                own = [j for j in range(i, min(i + LONGEST, len(pieces))) if pieces.piece[j] == pieces.piece[i]]
                rows.append((langs[pieces.text[i]], [pieces.data[pieces.start[j] : pieces.end[j]].tobytes() for j in own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["lang", "words"])

    return run


def _order(columns: list[np.ndarray], most: int) -> np.ndarray:
    """The order of rows by columns of numbers up to most: several share a key of 63 bits."""
    bits, keys = max(1, most.bit_length()), []
    for k in range(0, len(columns), 63 // bits):
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for column in columns[k : k + 63 // bits]:
            key = key << bits | column
        keys.append(key)
    return np.lexsort(keys[::-1])


def _places(bounds: list, langs: list[str], words: list[bytes], columns: list[np.ndarray]) -> list[int]:
    """For each bound, how many of the sorted edges (language and five words) lie before it."""
    out = []
    for bound in bounds:
        lo, hi = 0, len(columns[0])
        for column, name, names, first in zip(columns, bound, [langs, *[words] * LONGEST], [0, *[1] * LONGEST], strict=True):
            at = bisect_left(names, name) if name or not first else -1
            exact = at < 0 or at < len(names) and names[at] == name
            least, above = np.searchsorted(column[lo:hi], [at + first, at + first + 1])
            lo, hi = lo + int(least), lo + int(above) if exact else lo + int(least)
            if not exact:
                break
        out.append(lo)
    return out


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers as so few bytes each as the largest takes, compressed. The first byte tells how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + pa.compress(np.ascontiguousarray(values.astype(kind)).tobytes(), "zstd", asbytes=True)


def _wide(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype(f"u{data[0]}")
    return np.frombuffer(pa.decompress(data[1:], n * kind.itemsize, "zstd", asbytes=True), dtype=kind)


def _edges(bounds: list, gathered: int) -> callable:
    """Rows of _BLOB: a task's edges by range and language, sorted and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, raw, counted in _gathered(batches, gathered):
            pieces = Pieces(raw)
            here = _counted(pieces, counted)
            if not here.any():
                continue
            coded = pieces.words().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            words = coded.dictionary.take(pa.array(order)).to_pylist()
            ids = pieces.followed(rank[coded.indices.to_numpy()])
            langs = sorted(set(given), key=str.encode)
            lang = np.array([bisect_left(langs, g) for g in given], dtype=np.int32)[pieces.text]
            columns = [lang[here], *ids[here].T]
            del pieces, coded, ids
            order = _order(columns, max(len(words), len(langs)))
            columns = [c[order] for c in columns]
            change = np.concatenate([[True], np.zeros(len(order) - 1, dtype=bool)])
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            new = np.flatnonzero(change)
            counts, columns = np.diff(new, append=len(order)), [c[new] for c in columns]
            lang, ids = columns[0], np.stack(columns[1:], axis=1)
            cuts = np.array([0, *_places(bounds, langs, words, columns), len(new)])
            own = np.concatenate([[0], np.flatnonzero(np.diff(lang)) + 1, [len(lang)]])
            rows = []
            for a, b in zip((every := np.unique(np.concatenate([cuts, own])))[:-1].tolist(), every[1:].tolist(), strict=True):
                used, renamed = np.unique(ids[a:b], return_inverse=True)
                used, renamed = (used[1:], renamed) if used[0] == 0 else (used, renamed + 1)
                names = pa.compress(b" ".join([words[u - 1] for u in used.tolist()]), "zstd", asbytes=True)
                size = sum(len(words[u - 1]) + 1 for u in used.tolist()) - 1
                place = int(np.searchsorted(cuts, a, "right")) - 1
                rows.append((min(place, len(bounds)), langs[int(lang[a])], size.to_bytes(8, "little") + names, _narrow(renamed.reshape(-1, LONGEST).T), _narrow(counts[a:b]), b - a))
            kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split(" ")[0] for f in _BLOB.split(", ")])

    return run


def _merged(blobs: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of some sorted edges, the edges (ids from 1 in the words' order, 0: ended) and their weights."""
    names, parts, weights = [], [], []
    for words, ids, counts, n in zip(*(blobs.column(c).to_pylist() for c in ("words", "ids", "counts", "edges")), strict=True):
        names.append(pa.array(pa.decompress(words[8:], int.from_bytes(words[:8], "little"), "zstd", asbytes=True).split(b" "), pa.binary()))
        parts.append(_wide(ids, n * LONGEST).reshape(LONGEST, n))
        weights.append(_wide(counts, n).astype(np.int64))
    coded = pa.chunked_array(names).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes, at = rank[coded.indices.to_numpy()], 0
    for k, (held, part) in enumerate(zip(names, parts, strict=True)):
        known = np.concatenate([[0], codes[at : at + len(held)]]).astype(np.int32)
        parts[k], at = known[part], at + len(held)
    ids, counts = np.concatenate(parts, axis=1), np.concatenate(weights)
    by = _order(list(ids), len(order))
    return coded.dictionary.take(pa.array(order)).to_pylist(), ids[:, by], counts[by]


def _paths(least: int) -> callable:
    """(lang, words, low, high, n): the counts of a range's phrases. A row stands for its prefixes of low to high words."""

    def run(blobs: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(blobs.column("lang")).to_pylist():
            words, ids, weights = _merged(blobs.filter(pc.equal(blobs.column("lang"), lang)))
            n = ids.shape[1]
            new = np.zeros(n, dtype=bool)
            new[0] = True
            out.append((lang, [], 0, 0, int(weights.sum())))
            levels, parent = [], np.zeros(n, dtype=np.int64)
            for k in range(LONGEST):
                new = new | np.concatenate([[True], ids[k, 1:] != ids[k, :-1]])
                start = np.flatnonzero(new)
                flow = np.add.reduceat(weights, start)
                inner = np.ones(len(start), dtype=bool)
                inner[[0, -1]] = False  # a phrase at the range's end may go on in the next
                real = ids[k, start] > 0
                low = np.full(len(start), k + 1)
                if levels:
                    before = levels[-1]
                    alone = inner & real & before["inner"][parent[start]] & (flow == before["flow"][parent[start]])
                    low = np.where(alone, before["low"][parent[start]], low)
                    before["shown"][parent[start][alone]] = False
                levels.append({"start": start, "flow": flow, "inner": inner, "low": low, "shown": real & ((flow >= least) | ~inner)})
                parent = np.cumsum(new) - 1
            for k, level in enumerate(levels):
                for i in np.flatnonzero(level["shown"]).tolist():
                    s = int(level["start"][i])
                    out.append((lang, [words[w - 1].decode("utf-8", "surrogatepass") for w in ids[: k + 1, s].tolist()], int(level["low"][i]), k + 1, int(level["flow"][i])))
        kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64()]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["lang", "words", "low", "high", "n"])

    return run


def phrase_counts(df: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", gathered: int = GATHERED, to_range: int = TO_RANGE) -> DataFrame:
    """(lang, words array, k, a): how often each phrase of 1 to 5 words occurs, if ``least`` times or more; k = 0: all words."""
    spark = df.sparkSession
    ready(spark)
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // to_range, MOST_RANGES))
    step = max(1, size // 6 // (ranges * SAMPLED))  # about six bytes a word
    sample = rows.mapInArrow(_sampled(step, gathered), "lang string, words array<binary>")
    # As one text whose order is that of words: a byte below all others parts them, and an ended piece comes first.
    parts = written(sample.select("lang", "words", F.concat_ws("\x00", "lang", F.concat_ws("\x00", F.transform("words", lambda w: w.cast("string")))).alias("key")), "collocation-sample")
    first = parts.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min_by(F.struct("lang", "words"), "key").alias("first"))
    found = sorted((r["first"]["lang"], *[bytes(w) for w in r["first"]["words"]]) for r in first.collect())  # a row a range
    bounds = [(f[0], *(*f[1:], *[b""] * LONGEST)[:LONGEST]) for f in found[1:]]
    blobs = rows.mapInArrow(_edges(bounds, gathered), _BLOB)
    paths = blobs.groupBy("range").applyInArrow(_paths(least), "lang string, words array<string>, low int, high int, n long")
    each = paths.select("lang", "words", F.explode(F.sequence("low", "high")).alias("k"), "n").select("lang", F.slice("words", 1, F.col("k")).alias("words"), "k", "n")
    return each.groupBy("lang", "words", "k").agg(F.sum("n").alias("a")).where((F.col("a") >= least) | (F.col("k") == 0))


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)")


def strongest(counts: DataFrame, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) out of phrase_counts: each language's ``top`` phrases of two words and more."""
    counts = counts.withColumn("phrase", F.concat_ws(" ", "words"))
    many = counts.where("k > 1")
    # A phrase that a longer one contains as often is contained as often in one with a word more on either side.
    inner = many.where("k > 2").select("lang", "a", F.explode(F.array(F.slice("words", 1, F.col("k") - 1), F.slice("words", 2, F.col("k") - 1))).alias("inner"))
    within = inner.groupBy("lang", F.concat_ws(" ", "inner").alias("phrase")).agg(F.max("a").alias("longest"))
    kept = many.join(within, ["lang", "phrase"], "left").where("longest is null or longest < a").select("lang", "words", "phrase", "k", "a")
    cut = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    part = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    cut = cut.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda phrase, count: counts.where("k > 0").select("lang", F.col("phrase").alias(phrase), F.col("a").alias(count))
    total = counts.where("k = 0").select("lang", F.col("a").alias("n"))
    cut = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    product = (_exact("a") * _exact("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = cut.withColumn("_over", product).withColumn("_under", (_exact("l") * _exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("_over div _under"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    found = lowest.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # What is among a language's first is among those of its part, so no task ranks more than a few times as many.
    first = lambda df, part, name: df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col(name) <= top)
    parted = first(found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), ["lang", "part"], "within")
    ranked = first(parted, ["lang"], "rank")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases of 2 to 5 words with ``least`` occurrences, but for those that a longer one contains as often."""
    return strongest(written(phrase_counts(df, least, lang_col, text_col), "collocation-counts"), top)
