"""Learned operators against plain versions: one number at a time, over features of single texts."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import common, language, quality, secrets, toxicity

WORDS = "rain tea lamp moon cat dog road sea idiot hill wood iron".split()


def _texts(n=60):
    draw = np.random.default_rng(2)
    return [(i, " ".join(draw.choice(WORDS, 6 + i % 5)), ["en", "de", "fr"][i % 3], i % 2) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    return docs, docs.select("doc_id", F.col("y").alias("toxic"), F.col("y").alias("quality"))


def _drawn(docs, names):
    """Rows in the order of training: by the hash of their ids."""
    return sorted(docs.withColumn("draw", F.xxhash64("doc_id", F.lit(17))).collect(), key=lambda r: (r["draw"], *(str(r[n]) for n in names)))


def _plain_ftrl(rows, alpha, beta, l1, l2, epochs, seed):
    """Two classes, features present or not; dictionaries of numbers."""
    z, n, zb, nb, order = {}, {}, 0.0, 0.0, np.random.default_rng(seed)

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            at, y = rows[k]
            w, b = {i: weight(i) for i in at}, -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in at:
                had = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * w[i]
                n[i] = had + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b, nb + g * g
    return {i: w for i in z if (w := weight(i))}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_toxicity_weights_and_scores_equal_plain_ftrl(spark, tables):
    docs, labels = tables
    rows = [(sorted(set(toxicity.features([r["text"]], 12)[1].tolist())), r["y"]) for r in _drawn(docs, ["y"])]
    want, bias = _plain_ftrl(rows, 0.3, 1.0, 0.5, 1.0, 4, 7)
    model = toxicity.fit(docs, labels, bits=12, settings=((0.3, 0.5),), epochs=4)
    assert dict(zip(model.places.tolist(), model.values.tolist(), strict=True)) == pytest.approx(want, abs=1e-9) and model.bias == pytest.approx(bias, abs=1e-9)
    assert want
    for r in toxicity.score(docs, model).collect():
        margin = bias + sum(want.get(i, 0.0) for i in set(toxicity.features([r["text"]], 12)[1].tolist()))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def _plain_sgd(rows, bits, width, rate, epochs, seed):
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (2 << bits, width)).tolist()
    layer, bias, done, steps = [[0.0, 0.0] for _ in range(width)], [0.0, 0.0], 0, epochs * len(rows)
    for _ in range(epochs):
        for k in draw.permutation(len(rows)).tolist():
            share, y = rows[k]
            lr = rate * (1 - done / steps)
            mean = [sum(s * vectors[i][d] for i, s in share.items()) for d in range(width)]
            out = [sum(mean[d] * layer[d][c] for d in range(width)) + bias[c] for c in (0, 1)]
            e = [math.exp(o - max(out)) for o in out]
            g = [v / sum(e) - (c == y) for c, v in enumerate(e)]
            back = [layer[d][0] * g[0] + layer[d][1] * g[1] for d in range(width)]
            for d in range(width):
                for c in (0, 1):
                    layer[d][c] -= lr * mean[d] * g[c]
            bias = [b - lr * v for b, v in zip(bias, g, strict=True)]
            for i, s in share.items():
                for d in range(width):
                    vectors[i][d] -= lr * min(1, 40 * s) * back[d]
            done += 1
    return [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(width)) for v in vectors], bias[1] - bias[0]


def test_quality_vectors_and_scores_equal_plain_descent(spark, tables):
    docs, labels = tables

    def shares(text):
        found = quality.features([text], 10)[1].tolist()
        return {i: found.count(i) / len(found) for i in sorted(set(found))}

    want, bias = _plain_sgd([(shares(r["text"]), r["y"]) for r in _drawn(docs, ["y"])], 10, 4, 0.5, 3, 3)
    model = quality.fit(docs, labels, bits=10, width=4, epochs=3)
    assert model.places == pytest.approx(np.array(want), abs=2e-4) and model.bias == pytest.approx(bias, abs=2e-4)
    for r in quality.score(docs, model).collect():
        margin = bias + sum(s * want[i] for i, s in shares(r["text"]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-4)


def test_heavy_rows_keep_their_weight_in_the_mix():
    """Steps get shorter together; no row's weight is cut against the others'."""
    at, share = np.array([3]), np.array([1.0], dtype=np.float32)
    balanced = quality.sgd([(at, share, 1, 1.0)] + [(at, share, 0, 1.0)] * 12, 4, epochs=60)
    weighed = quality.sgd([(at, share, 1, 12.0), (at, share, 0, 12.0)], 4, epochs=60)
    heavy = quality.sgd([(at, share, 1, 12.0)] + [(at, share, 0, 1.0)] * 12, 4, epochs=60)
    margin = lambda m: m.bias + m.places[3]
    assert margin(balanced) < -1.5 and abs(margin(weighed)) < 0.7 and abs(margin(heavy)) < 0.7


def _plain_language(rows, documents, bits, languages, alpha=0.3, beta=1.0, l1=0.05, l2=0.01, epochs=3, seed=5):
    size = len(languages)
    seen = {}
    for place, _ in documents:
        for i in set(place):
            seen[i] = seen.get(i, 0) + 1
    idf = lambda i: math.log((len(documents) + 1) / (seen.get(i, 0) + 1)) + 1
    examples = [({i: language.SCALE * place.count(i) / len(place) * idf(i) for i in sorted(set(place))}, languages.index(y)) for place, y in rows]
    train = [x for k, x in enumerate(examples) if k % 4 != 3]
    z, n, zb, nb, order = {}, {}, [0.0] * size, [1e-9] * size, np.random.default_rng(seed)

    def weight(i, c):
        s = z.get((i, c), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    bias = lambda c: -zb[c] / ((beta + math.sqrt(nb[c])) / alpha)
    for _ in range(epochs):
        for k in order.permutation(len(train)).tolist():
            x, y = train[k]
            w, b = {(i, c): weight(i, c) for i in x for c in range(size)}, [bias(c) for c in range(size)]
            out = [sum(v * w[i, c] for i, v in x.items()) + b[c] for c in range(size)]
            e = [math.exp(o - max(out)) for o in out]
            for c in range(size):
                g = e[c] / sum(e) - (c == y)
                for i, v in x.items():
                    had, step = n.get((i, c), 0.0), v * g
                    z[i, c] = z.get((i, c), 0.0) + step - (math.sqrt(had + step * step) - math.sqrt(had)) / alpha * w[i, c]
                    n[i, c] = had + step * step
                zb[c], nb[c] = zb[c] + g - (math.sqrt(nb[c] + g * g) - math.sqrt(nb[c])) / alpha * b[c], nb[c] + g * g
    return {key: v * idf(key[0]) for key in z if (v := weight(*key))}, [bias(c) for c in range(size)]


def test_language_weights_equal_plain_ftrl(spark, tables):
    docs, _ = tables
    place = lambda t: language.grams([t], 10)[1].tolist()
    rows = [(place(r["text"]), r["lang"]) for r in _drawn(docs, ["lang"])]
    want, bias = _plain_language(rows, rows, 10, ["de", "en", "fr"])
    model = language.fit(docs, bits=10)
    assert model.languages == ["de", "en", "fr"] and model.bias == pytest.approx(np.array(bias), abs=1e-6)
    got = {(i, c): float(model.table[i, c]) for i, c in zip(*np.nonzero(model.table), strict=True)}
    assert got == pytest.approx(want, rel=1e-4, abs=1e-5)
    for r in language.identify(docs, model).collect():
        p = place(r["text"])
        out = [(language.SCALE * sum(want.get((i, c), 0.0) for i in p) / len(p) + bias[c]) / model.temperature for c in range(3)]
        e = np.exp(np.array(out) - max(out))
        assert r["lang_score"] == pytest.approx(float(e.max() / e.sum()), abs=1e-4) and r["lang_pred"] == model.languages[int(e.argmax())]


def test_many_languages_with_long_texts_are_all_learned(spark):
    """Each of 200 languages has texts whose features alone would fill the bound many times over; beyond 256 it is an error."""
    draw = np.random.default_rng(4)
    rows = []
    for k in range(200):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(2 * k + j, "".join(draw.choice(letters, 3000 if k % 20 == 0 else 40)), f"l{k:03d}") for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, bits=12, most_bytes=400_000)
    assert len(model.languages) == 200
    told = language.identify(df, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.9
    many = spark.range(300).select("id", F.lit("a b c").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    with pytest.raises(ValueError, match="256"):
        language.fit(many, id_col="id")


def test_a_labelled_id_that_many_rows_have_counts_twice_at_most(spark):
    docs = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y")).distinct()
    got = {r["label"]: r["count"] for r in common.labelled_sample(docs, labels, "y", 500).groupBy("label").count().collect()}
    assert got == {0: 100 + 2, 1: 100}


# --- secrets ---------------------------------------------------------------------------------------


def _plain_novel(text, base, novelty, threshold):
    """The rules of novel spans, by looking at every base span and every sensitive word for each candidate."""
    words = [m.end() for m in secrets._SENSITIVE.finditer(text)]
    begun = min((m.start() for m in secrets._SENSITIVE.finditer(text)), default=None)
    out, near, missed = [], None, 0
    for m in secrets._CANDIDATE.finditer(text, max(0, begun - 64)) if begun is not None else ():
        start, end = m.span()
        chained = near is not None and secrets._BETWEEN.fullmatch(text[near:start]) is not None
        if not chained and not any(0 <= start - w <= secrets.CONTEXT for w in words):
            near = None
            continue
        held = [(a, b) for a, b, _ in base if a < end and b > start]
        rest = "".join(c for i, c in enumerate(text[start:end], start) if not any(a <= i < b for a, b in held))
        if not rest:
            near, missed = end, 0
            continue
        if novelty(text, start, end) >= secrets.bar(rest, threshold, chained, bool(held)):
            out.append((start, end, "novel"))
            near, missed = end, 0
        else:
            missed += 1
            near = end if chained and missed <= secrets.MISSES else None
    return out


def test_novel_spans_equal_a_plain_scan():
    draw, novelty = np.random.default_rng(8), secrets.Novelty()
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    parts = ["token = ", "the private key ", "password: abc123def ", "0123456789abcdef0123456789abcdef", "configuration_handler", " and ", "\n", ".", "-- ", "AKIA" + "Q7" * 10, "session "]
    found = 0
    for _ in range(60):
        text = "".join(str(draw.choice(parts)) if draw.random() < 0.6 else "".join(draw.choice(letters, int(draw.integers(8, 40)))) for _ in range(25))
        base = secrets.base_spans(text)
        want = _plain_novel(text, base, novelty, 0.85)
        assert secrets.novel_spans(text, base, novelty, 0.85) == want
        found += len(want)
    assert found > 30


def test_long_texts_take_time_by_their_length_and_chains_survive_misses():
    draw, novelty = np.random.default_rng(9), secrets.Novelty()
    hexes = ["".join(draw.choice(list("0123456789abcdef"), 32)) for _ in range(12_000)]
    one = "secret key: " + "Z".join(hexes) + " end"  # a candidate of 400 KB that holds 12,000 base spans
    many = "secret key: " + "\n".join(hexes) + " end"
    began = time.time()
    assert len(secrets.scan(one, novelty)[0]) >= 12_000 and len(secrets.scan(many, novelty)[0]) >= 12_000
    assert time.time() - began < 20
    upper = ["".join(draw.choice(list("0123456789ABCDEF"), 32)) for _ in range(3000)]
    spans = secrets.scan("private keys follow: " + "\n".join(upper), novelty)[1]
    assert len(spans) > 2400
