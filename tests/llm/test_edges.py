"""Ids of any kind among images, near copies and long texts in the pipeline's stages."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import media, neardup


def test_images_of_negative_large_and_null_ids(spark):
    draw = np.random.default_rng(3)
    ids = [-(2**63), -7, -1, 0, 3, 2**63 - 1, None, None]
    vectors = spark.createDataFrame([(i, [float(c) for c in draw.normal(size=8)]) for i in ids], "vec_id long, embedding array<float>")
    images = media.images_of(vectors, share=1, changes=("crop",))
    rows = images.select("image_id", "vec_id", "change").collect()
    assert len({r["image_id"] for r in rows if r["vec_id"] is not None}) == len([r for r in rows if r["vec_id"] is not None])
    assert all(r["image_id"] == r["vec_id"] * 5 + media.CHANGES.index(r["change"]) for r in rows if r["vec_id"] is not None)
    assert sum(r["vec_id"] is None for r in rows) == 2 and {r["change"] for r in rows if r["vec_id"] is None} == {"none"}
    every = media.images_of(vectors, share=2, changes=("crop", "edit"))
    got = media.copies(every, "image_id").collect()
    assert len(got) == every.count() and sum(r["image_id"] is None for r in got) == 2
    assert all(r["n_links"] == 0 for r in got if r["image_id"] is None)
    pairs = {r["vec_id"]: r["image_id"] for r in every.where("change <> 'none'").collect()}
    group = {r["image_id"]: r["group_id"] for r in got}
    assert pairs and np.mean([group[i] == v * 5 for v, i in pairs.items()]) >= 0.5


def _stage_rows(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_the_pipeline_keeps_one_of_near_copies_with_an_edited_word(spark):
    draw = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    texts, copies = [], []
    for _ in range(60):
        text = draw.choice(words, 30).tolist()
        edited = list(text)
        edited[int(draw.integers(0, 30))] = "changed"
        texts.append(" ".join(text))
        copies.append(" ".join(edited))
    long = " ".join(draw.choice(words, 60_000))
    rows = _stage_rows([*texts, *copies, long, long + " more", None, ""])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    # A word edited in thirty leaves 27 of 31 pairs or more; null and empty texts are no copies of each other.
    assert kept == {*range(60), 120, 122, 123}


def test_a_very_long_text_passes_the_secret_stage_whole(spark):
    text = "a plain word " * 100_000 + "password: hunter2hunter2 " + "and more words " * 50_000
    docs = spark.createDataFrame(_stage_rows([text, None]), "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_stage(spark, docs, "").collect()}
    assert "hunter2" not in out[0] and out[0].endswith("and more words ") and out[1] is None


def test_an_id_with_two_texts_is_numbered_before(spark):
    """What the docstring of near_duplicates asks of its callers, the pipeline does."""
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 1), (1, "alpha beta gamma delta epsilon", "en", "s", 1), (2, "one two three four five six", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"][:3]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [(1, "alp"), (1, "one")]
    assert neardup.near_duplicates(docs.where(F.lit(False))).count() == 0
