"""Encoding and decoding for merge-type (BPE) sentencepiece vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. The best-scored pair of neighbours that forms a
vocabulary piece merges first (ties: the leftmost), until none is left; symbols outside the vocabulary
fall back to bytes. No piece of such a vocabulary has a symbol followed by a space mark, so a text splits
exactly into units, each a run of space marks and what follows up to the next; equal units are merged once
and looked up afterwards. Units are split further where no piece holds the two characters side by side.

Every unit is checked against the sentencepiece library when it first occurs, in one call an Arrow
batch; where the two differ the library's ids stand and the row's ``n_corrected`` says so. Texts that hold
the space mark itself, or start with a form the units don't cover, take the same road (the mark is a
blank to the model).

Defined results: null and empty texts have the begin and end ids alone and decode to the empty string;
repeated rows give repeated rows; of pairs with equal scores the leftmost merges first; texts of any length are encoded
whole; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Lookup, ready, slices

MARK = "▁"
#: Signs that often close a word; a unit is split before them where the vocabulary allows.
CLOSING = ".,;:!?#$%&*|)\"'"


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Agenda:
    """Merges by the model's scores."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids, cost, self.beside = {}, {}, set()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                self.ids[piece], cost[piece] = i, -sp.get_score(i)
                self.beside.update(zip(piece, piece[1:], strict=False))
        if any(b == MARK and a != MARK for a, b in self.beside) or any("\n" in p for p in self.ids):
            raise ValueError("pieces of this vocabulary cross words")
        places = {c: r for r, c in enumerate(sorted(set(cost.values())))}
        self.rank = {piece: places[c] for piece, c in cost.items()}
        self.cores = Lookup(lambda units: [self.merge(u) for u in units])
        self.corrected = 0

    def merge(self, unit: str) -> bytes:
        """The ids of one unit, as little-endian 16- or 32-bit integers."""
        # An agenda entry is a pair's rank by score and its place, in one number; equal scores have equal ranks.
        rank, symbols, n = self.rank.get, list(unit), len(unit)
        bits = n.bit_length()
        low = (1 << bits) - 1
        agenda = [(r << bits) | i for i, p in enumerate(map(add, symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & low
            j = after[i]
            if j >= n or not symbols[i] or rank(pair := symbols[i] + symbols[j]) != entry >> bits:
                continue  # one of the two has merged with another meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (r << bits) | i)
            if (k := before[i]) >= 0 and (r := rank(symbols[k] + pair)) is not None:
                heapq.heappush(agenda, (r << bits) | k)
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else [self.bytes[b] for b in s.encode()])
        return _packed(out)

    def units(self, tokens: list[str]) -> list[bytes]:
        """Ids of units as Lookup keys them: with the mark where a space stands before, else led by a newline."""
        beside, split, parts = self.beside, [], set()
        for t in tokens:
            core = t.rstrip(CLOSING)
            if core and core != t and (core[-1], t[len(core)]) not in beside:
                split.append((core, t[len(core) :]))
            else:
                split.append((t, ""))
            parts.update(split[-1])
        cores = self.cores.fill(parts)
        own = [cores[a] + cores[b] for a, b in split]
        checkable = [k for k, t in enumerate(tokens) if t[:1] == MARK and t != MARK]
        theirs = self.library.encode([tokens[k][1:] for k in checkable], num_threads=1)
        for k, ids in zip(checkable, theirs, strict=True):
            data = _packed(ids)
            if data != own[k]:
                own[k], self.corrected = data, self.corrected + 1
        rest = [k for k, t in enumerate(tokens) if t[:1] != MARK or t == MARK]
        lead = len(self.library.encode("x"))
        for k, ids in zip(rest, self.library.encode(["x" + tokens[k] for k in rest], num_threads=1), strict=True):
            data = _packed(ids[lead:])  # x stays by itself before a newline or a blank
            if data != own[k]:
                own[k], self.corrected = data, self.corrected + 1
        return own


_RUN = re.compile(f"\n?{MARK}*[^{MARK}\n]+|\n?{MARK}+|\n")


def cut(text: str) -> list[str]:
    """The units of a text, the leading blank of the model included; a newline starts a unit of its own."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] in " \n" or text[-1] == " " or " \n" in text or "\n " in text or "\n\n" in text:
        return _RUN.findall(MARK + text.replace(" ", MARK))
    first, *lines = text.split("\n")
    out = [MARK + w for w in first.split(" ")]
    for line in lines:
        head, *more = line.split(" ")
        out.append("\n" + head)
        out.extend([MARK + w for w in more])
    return out


_HELD: dict[str, tuple[Agenda, Lookup]] = {}


def _agenda(model: str) -> tuple[Agenda, Lookup]:
    if model not in _HELD:
        agenda = Agenda(model)
        _HELD[model] = agenda, Lookup(agenda.units)
    return _HELD[model]


SCHEMA = "n_tokens long, ids binary, decoded string, n_corrected long"


def _rows(model: str, digests: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda, lookup = _agenda(model)
        sp = agenda.library
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        for part in slices(batches, 256, 4 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            units = [cut(t) for t in texts]
            before = agenda.corrected
            held = lookup.fill(set().union(*units))
            fixed = agenda.corrected - before
            ids = [begin + b"".join(map(held.__getitem__, u)) + end for u in units]
            del units
            decoded = sp.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids], num_threads=1)
            out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digests:
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                out += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            out.append(pa.array([fixed] * len(ids), pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names[digests])

    names = {False: ["id", "n_tokens", "ids", "decoded", "n_corrected"], True: ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]}
    return run


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col with n_tokens, ids (little-endian unsigned 32-bit) and decoded text; digests: SHA-256 of both in their stead.

    n_corrected: units of the row's batch in which the library overruled the agenda (0 is expected).
    A map without a shuffle: each row goes out from the task that read it."""
    ready(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    value = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows(model, digests), f"id {kind}, n_tokens long, {value}, n_corrected long")
    return out.withColumnRenamed("id", id_col)
