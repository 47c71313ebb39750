"""Packing token sequences into fixed windows by non-negative least squares.

Every document is tokenised once (its ids and the end id), and the ids go into a table in the shared
folder. Whole windows are cut off first; what is left of a document is one piece of a length below the
window. The histogram of lengths has at most ``window`` rows whatever the corpus, so it alone goes to the
driver: there the shallow combinations of lengths that fill a window exactly are enumerated (k times one
length, with up to two others), their repeat counts are solved as a non-negative least-squares fit to the
histogram, rounded down, and topped up greedily. The pieces of no combination are packed greedily one
after another, longest first, cut where a window ends; the last window falls into powers of two. So
nothing is padded.

Which document takes which place follows from its rank among the documents of its length. Ranks are taken
over (length, bucket) with the buckets' own counts before them, so that a length held by a third of all
documents is ranked by many tasks. The plan has a row for each length and combination used, a bound set by
the window alone.

Defined results: null and empty texts are one piece with the end id alone; repeated rows (or ids) are
packed as rows of their own; a text of any length is tokenised whole and cut into windows; among documents of one length
the order, and so who is packed with whom, follows the rows' numbers; an empty table gives an empty one; other columns
are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import ready, slices, spread, written

#: Largest multiplicity of one length in a combination, and how many frequent lengths serve as its second.
MOST_TIMES, SECONDS = 64, 8

#: Kinds of bytes: 1 blank or newline, 2 letter, 4 closing sign, 8 the end of an accented letter.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[10, 32]] = 1
_KINDS[[*range(65, 91), *range(97, 123)]] = 2
_KINDS[np.frombuffer(b".,!#$%&*|", dtype=np.uint8)] = 4
_KINDS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = 8  # after 0xC3: a letter of Latin-1


def _is_small(word: str) -> bool:
    """Whether a word is of composed Latin letters that are small already."""
    return word.isalpha() and max(word) < "\u0250" and word.lower() == word and unicodedata.is_normalized("NFC", word)


class WordTokens:
    """Whole-text ids of a vocabulary that drops white space, word by word: blanks and newlines always part its words.

    Words are found on the bytes of a whole batch, plain closing signs parted from letters before them; only
    distinct words are looked up, and their ids are gathered by position. Words that a batch repeats stay known."""

    def __init__(self, path: str, limit: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.limit = Tokenizer.from_file(path), limit
        #: For words of small composed letters, which the vocabulary's own normalisation and splitting leave as they are.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Ids fit 16 bits, which halves what is written and shuffled.
        self.kind = np.dtype("<u2" if len(self.ends) <= 65536 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.lengths = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)

    @staticmethod
    def _encode(library: object, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has. Words of small letters share a call."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        plain = [i for i, (w, t) in enumerate(zip(words, texts, strict=True)) if w.isalpha() and w.islower() or _is_small(t)]
        parts, order, lengths = [], [], []
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        single = set(range(len(words))).difference(plain)
        for group, ids in zip(groups, self._encode(self.plain, [" ".join([texts[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, dtype=self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                parts.append(ids)
                order += group
                lengths.append(np.diff(stops, prepend=0))
            else:  # a word has more parts than one; then each goes by itself
                single.update(group)
        rest = sorted(single)
        held = self._encode(self.library, [texts[i] for i in rest])
        parts.append(np.array([i for ids in held for i in ids], dtype=self.kind))
        lengths.append(np.array([len(ids) for ids in held], dtype=np.int64))
        lengths, ids = np.concatenate(lengths).astype(np.int64), np.concatenate(parts)
        back = np.empty(len(words), dtype=np.int64)
        back[np.array([*order, *rest], dtype=np.int64)] = np.arange(len(words))
        starts = np.cumsum(lengths) - lengths
        return ids[spread(starts[back], lengths[back])], lengths[back]

    def _words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, and how many stand before the end of each text.

        A word of ASCII letters is put in small letters; closing signs after a Latin letter are a word of their
        own, since a letter and such a sign are never one token."""
        newline, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        closed = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), newline, none).cast(pa.large_binary())
        offsets = np.frombuffer(closed.buffers()[1], dtype=np.int64)[closed.offset : closed.offset + len(closed) + 1]
        data = np.frombuffer(closed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        kinds = _KINDS[data]
        gap = np.flatnonzero(kinds & 1)
        start, end = np.concatenate([[0], gap[:-1] + 1]), gap
        inner = np.where(kinds & 4, 0, np.arange(len(data), dtype=np.int32))  # the last position that is no closing sign
        np.maximum.accumulate(inner, out=inner)
        stop = np.maximum(inner[np.maximum(end - 1, 0)] + 1, start)
        split = (stop > start) & (stop < end)
        final = stop[split] - 1
        accented = (kinds[final] & 8 > 0) & (data[np.maximum(final - 1, 0)] == 0xC3)
        split[split] = (kinds[final] & 2 > 0) | accented
        stop = np.where(split, stop, end)
        letters = np.concatenate([[0], np.cumsum(kinds >> 1 & 1, dtype=np.int32)])
        small = np.zeros(len(data) + 1, dtype=np.int8)
        plain = (letters[stop] - letters[start] == stop - start) & (stop > start)
        small[start[plain]] += 1
        small[stop[plain]] -= 1
        data = data | (np.cumsum(small[:-1], dtype=np.int8).astype(np.uint8) << 5)  # sets the bit of small letters
        kept = data[kinds & 1 == 0]
        ends = end - np.arange(len(end))  # with the gaps taken out
        cuts = np.sort(np.concatenate([[0], ends, (ends - (end - stop))[split]])).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
        last = np.searchsorted(gap, offsets[1:] - offsets[0] - 1)  # the newline that closes each text
        return words.dictionary_encode(), (np.arange(1, len(end) + 1) + np.cumsum(split))[last]

    def __call__(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text (null: empty) and end_id, as little-endian integers of ``kind``."""
        if not len(texts):
            return pa.array([], pa.binary())
        words, before = self._words(texts)
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        at = np.array(list(map(self.place.get, distinct, repeat(-1))), dtype=np.int64)
        unknown = np.flatnonzero(at < 0)
        ids, lengths = self._new([distinct[i] for i in unknown.tolist()])
        at[unknown] = len(self.lengths) + np.arange(len(unknown))
        known = len(self.lengths)
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        starts = np.cumsum(self.lengths) - self.lengths
        # A text's end is one more word.
        pool, size = np.append(self.ids, self.kind.type(end_id)), np.append(self.lengths, 1)
        order = np.insert(at[codes], before, len(self.lengths))
        out = pool[spread(np.append(starts, len(self.ids))[order], size[order])]
        bounds = np.concatenate([[0], np.cumsum(size[order])[before + np.arange(len(before))]]) * self.kind.itemsize
        least = 0 if len(self.place) < self.limit // 2 else 1
        again = np.flatnonzero(np.bincount(codes, minlength=len(distinct))[unknown] > least)
        self.place.update((distinct[unknown[k]], known + j) for j, k in enumerate(again.tolist()))
        fresh = spread(starts[known + again], lengths[again])
        self.ids, self.lengths = np.concatenate([self.ids[: len(self.ids) - len(ids)], self.ids[fresh]]), np.concatenate([self.lengths[:known], lengths[again]])
        if len(self.place) > self.limit:
            self._forget()
        return pa.Array.from_buffers(pa.large_binary(), len(before), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


_HELD: dict[str, WordTokens] = {}


def _tokenise(tokenizer: str, end_id: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _HELD:
            _HELD[tokenizer] = WordTokens(tokenizer)
        tokens = _HELD[tokenizer]
        for part in slices(batches, 1024, 1 << 20):
            ids = tokens(part.column(1), end_id)
            yield pa.RecordBatch.from_arrays([part.column(0), pc.divide(pc.binary_length(ids).cast(pa.int64()), tokens.kind.itemsize), ids], ["id", "doc_tokens", "ids"])

    return run


# --- the plan, over the histogram alone ---------------------------------------------------------


def combinations(counts: np.ndarray, window: int) -> list[tuple[tuple[int, int], ...]]:
    """The shallow combinations ((length, times), ...) of lengths with counts that sum to the window."""
    have = [int(a) for a in np.flatnonzero(counts) if 0 < a < window]
    top = sorted(have, key=lambda a: (-counts[a], a))[:SECONDS]
    found = set()

    def add(*parts: tuple[int, int]) -> None:
        times: dict[int, int] = {}
        for a, k in parts:
            times[a] = times.get(a, 0) + k
        if all(counts[a] >= k for a, k in times.items()):
            found.add(tuple(sorted(times.items(), reverse=True)))

    for a in have:
        for k in range(1, min(MOST_TIMES, window // a, int(counts[a])) + 1):
            b = window - k * a
            if b == 0:
                add((a, k))
            elif counts[b]:
                add((a, k), (b, 1))
            if k <= 2:
                for t in top:
                    if (c := b - t) > 0 and counts[c]:
                        add((a, k), (t, 1), (c, 1))
    return sorted(found, reverse=True)


def nnls(combos: list, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared error of their lengths against the histogram (accelerated projected gradient)."""
    if not combos:
        return np.zeros(0)
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row, times = (np.array([p[i] for c in combos for p in c]) for i in (0, 1))
    norm = np.sqrt(np.bincount(column, times**2.0))
    value, size = times / norm[column], len(counts)
    forward = lambda x: np.bincount(row, value * x[column], size)
    back = lambda y: np.bincount(column, value * y[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(forward(v))
        v /= (steep := np.linalg.norm(v)) or 1
    steep = max(steep * 1.05, 1e-9)
    target = counts.astype(float)
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(forward(z) - target) / steep)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / s * (new - x), new, s
    return x / norm


class Plan:
    """Where the piece of a length and rank goes. All arrays are bounded by the window, not by the corpus."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window, left = window, counts.astype(np.int64).copy()
        left[0] = 0
        whole, left[window] = int(left[window]), 0
        combos = combinations(left, window)
        repeats = np.floor(nnls(combos, left) + 1e-6).astype(np.int64)
        used = np.zeros(len(combos), dtype=np.int64)
        for wanted in (repeats, None):  # rounded solution first, then greedily what still fits
            for j, c in enumerate(combos):
                n = min(int(left[a]) // k for a, k in c)
                n = n if wanted is None else min(n, int(wanted[j]))
                if n > 0:
                    used[j] += n
                    for a, k in c:
                        left[a] -= n * k
        rows, taken, sequence = [(window, 0, whole, 1, 0, 0)] if whole else [], np.zeros(window + 1, dtype=np.int64), whole
        for c, n in zip(combos, used.tolist(), strict=True):
            if n:
                offset = 0
                for a, k in c:
                    rows.append((a, int(taken[a]), int(taken[a]) + n * k, k, sequence, offset))
                    taken[a], offset = taken[a] + n * k, offset + a * k
                sequence += n
        rows.sort()
        self.length, self.low, self.high, self.times, self.sequence, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(6))
        self.fitted, self.stream = taken, sequence
        order = np.arange(window, -1, -1)
        tokens = left[order] * order
        self.base = np.zeros(window + 1, dtype=np.int64)
        self.base[order] = np.cumsum(tokens) - tokens
        total = int(tokens.sum())
        # Ends of the stream's last sequences: the windows, and the powers of two of what remains.
        self.cuts, at = [], total // window * window
        self.last = at
        for bit in range(window.bit_length() - 1, -1, -1):
            if total % window >> bit & 1:
                self.cuts.append((at, at + (1 << bit)))
                at += 1 << bit

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the piece's parts, in order."""
        if length == self.window or rank < self.fitted[length]:
            lo, hi = np.searchsorted(self.length, [length, length + 1])
            i = lo + int(np.searchsorted(self.low[lo:hi], rank, "right")) - 1
            q = rank - int(self.low[i])
            return [(int(self.sequence[i]) + q // int(self.times[i]), int(self.offset[i]) + q % int(self.times[i]) * length, length)]
        at, out = int(self.base[length]) + (rank - int(self.fitted[length])) * length, []
        while length:
            if at < self.last:
                number, begin, end = at // self.window, at // self.window * self.window, (at // self.window + 1) * self.window
            else:
                k = next(k for k, (b, e) in enumerate(self.cuts) if b <= at < e)
                number, (begin, end) = self.last // self.window + k, self.cuts[k]
            n = min(length, end - at)
            out.append((self.stream + number, at - begin, n))
            at, length = at + n, length - n
        return out


def _pieces(plan: Plan, narrow: bool) -> callable:
    window = plan.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, 4 << 20):
            docs, rows = [], []
            for k, (tokens, ids, whole_rank, rank) in enumerate(zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                data = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if narrow else ids
                at = 0
                for w in range(tokens // window):
                    docs.append(k)
                    rows.append((at, window, data[4 * at : 4 * (at + window)], tokens, *plan.place(window, whole_rank + w)[0][:2]))
                    at += window
                for sequence, offset, n in plan.place(tokens % window, rank) if tokens % window else ():
                    docs.append(k)
                    rows.append((at, n, data[4 * at : 4 * (at + n)], tokens, sequence, offset))
                    at += n
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), *columns], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def _ranked(items: DataFrame, buckets: int) -> DataFrame:
    """row, length, rank: how many items of that length stand before the row's n."""
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.sum("n").alias("held"))
    before = sizes.select("length", "bucket", (F.sum("held").over(Window.partitionBy("length").orderBy("bucket")) - F.col("held")).alias("before"))
    within = dealt.select("row", "length", "bucket", (F.sum("n").over(Window.partitionBy("length", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("within"))
    return within.join(before, ["length", "bucket"]).select("row", "length", (F.col("before") + F.col("within")).alias("rank"))


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Pieces (id_col, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit integers."""
    spark = df.sparkSession
    ready(spark)
    kind = df.schema[id_col].dataType.simpleString()
    tokens = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_tokenise(tokenizer, end_id), f"id {kind}, doc_tokens long, ids binary")
    tokens = written(tokens.withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    rest = F.col("doc_tokens") % window
    items = tokens.select("row", F.explode(F.array(F.struct(rest.alias("length"), (rest > 0).cast("long").alias("n")), F.struct(F.lit(window).cast("long").alias("length"), F.floor(F.col("doc_tokens") / window).alias("n")))).alias("item")).select("row", "item.length", "item.n").where("n > 0")
    found = items.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row a length: at most `window`
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in found:
        counts[r["length"]] = r["n"]
    plan = Plan(counts, window)
    ranks = _ranked(items, max(32, sum(r["rows"] for r in found) // rows_per_bucket))
    whole = F.col("length") == window
    ranks = ranks.groupBy("row").agg(F.max(F.when(whole, F.col("rank"))).alias("whole_rank"), F.max(F.when(~whole, F.col("rank"))).alias("rank"))
    narrow = _narrow(tokenizer)
    placed = tokens.join(ranks, "row").select("id", "doc_tokens", "ids", F.coalesce("whole_rank", F.lit(0)).alias("whole_rank"), F.coalesce("rank", F.lit(0)).alias("rank"))
    out = placed.mapInArrow(_pieces(plan, narrow), f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def _narrow(tokenizer: str) -> bool:
    """Whether ids fit 16 bits, which halves what is written and shuffled."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        held = json.load(f)
    return max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])]) < 65536
