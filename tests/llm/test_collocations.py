"""Phrase counts and collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from marquee.llm import collocations as C


def _plain_counts(rows):
    found = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        small = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            for i in range(len(words)):
                found[lang, ()] += 1
                for k in range(1, min(5, len(words) - i) + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return found


def _plain_strongest(found, least, top):
    many = {key: a for key, a in found.items() if a >= least and len(key[1]) > 1}
    dropped = set()
    for (lang, words), a in many.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if a >= found[lang, words[i : i + k]]:
                    dropped.add((lang, words[i : i + k]))
    out = []
    for (lang, words), a in many.items():
        if (lang, words) not in dropped:
            n = found[lang, ()]
            score, k = min((1000 * a * n // (found[lang, words[:k]] * found[lang, words[k:]]), k) for k in range(1, len(words)))
            out.append((lang, -score, -a, " ".join(words).encode("utf-8", "surrogatepass"), found[lang, words[:k]], found[lang, words[k:]], n))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode("utf-8", "surrogatepass"), -a, left, right, n, -score))
    return ranked


def _rows():
    draw = np.random.default_rng(11)
    words = ["a", "b", "B", "ab", "a\x00", "é", "É", "z\x01y", "-", " ", "日本", "x" * 300]
    gaps, share = [" ", "  ", "\t", ". ", "\n", "!?", ",", "\r\n"], [0.7, 0.08, 0.05, 0.05, 0.04, 0.04, 0.02, 0.02]
    rows = []
    for i in range(150):
        n = int(draw.integers(0, 60))
        text = "".join(w + g for w, g in zip(draw.choice(words, n), draw.choice(gaps, n, p=share), strict=True))
        rows.append((text, [None, "en", "de", "EN", "é"][i % 5]))
    # A pair that a third of all positions begin, a passage that many rows share, and texts of many segments.
    rows += [(" ".join(f"hot pair {draw.choice(words)}" for _ in range(40)), "en") for _ in range(30)]
    rows += [("start " + "one two three four five six seven. " * 2 + str(i), "en") for i in range(60)]
    rows += [("long run of words " * 2000 + "end", "de"), ("y" * 5000, "de"), (("q" * 700 + " r ") * 12, "de"), (None, None), (None, "en"), ("", "fr"), (" .\n", "fr")]
    return rows


@pytest.mark.parametrize(("gathered", "to_range"), [(1 << 20, 1 << 20), (400, 700), (3000, 300)])
def test_counts_and_collocations_equal_a_plain_count(spark, gathered, to_range):
    """With one range and gathering, and with so many that phrases span ranges and texts are cut in segments."""
    rows = _rows()
    df = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, words string").repartition(3)
    found = _plain_counts(rows)
    counts = C.phrase_counts(df, 5, gathered=gathered, to_range=to_range)
    got = counts.collect()
    assert {(r["lang"], tuple(r["words"])): r["a"] for r in got} == {k: a for k, a in found.items() if a >= 5 or not k[1]}
    assert len(got) == len({(r["lang"], tuple(r["words"])) for r in got})
    out = C.strongest(counts, 40).collect()
    assert sorted(tuple(r) for r in out) == sorted(_plain_strongest(found, 5, 40))


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right, n = 3_000_000_019, 3_000_000_037, 5_000_000_029, 7_000_000_000_000_003
    rows = [("en", ["x", "y"], 2, a), ("en", ["x"], 1, left), ("en", ["y"], 1, right), ("en", [], 0, n), ("de", ["x", "y"], 2, 1), ("de", ["x"], 1, 1), ("de", ["y"], 1, 1), ("de", [], 0, 9 * 10**15)]
    got = {r["lang"]: r["score"] for r in C.strongest(spark.createDataFrame(rows, "lang string, words array<string>, k int, a long")).collect()}
    assert got == {"en": 1000 * a * n // (left * right), "de": 9 * 10**18}


def test_collocations_of_empty_tables_and_texts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en"), (" \n", "en")], "text string, lang string")).count() == 0
    one = C.phrase_counts(spark.createDataFrame([("One two", None)], "text string, lang string"), 1).collect()
    assert {(r["lang"], tuple(r["words"]), r["a"]) for r in one} == {("und", (), 2), ("und", ("one",), 1), ("und", ("two",), 1), ("und", ("one", "two"), 1)}


def test_segments_count_every_position_once():
    text = ("alpha beta, gamma " * 50 + "w" * 300 + " x y z. ").encode() * 3
    parts = list(C.segments(text, 100))
    whole = C.Pieces([text])
    counted = [int(np.sum(C._counted(C.Pieces([data]), [keep]))) for data, keep in parts]
    assert len(parts) > 5 and sum(counted) == len(whole)
