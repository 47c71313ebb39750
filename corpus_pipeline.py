"""The corpus pipeline: toxicity, language, near-duplicates, secrets, packing.

Each stage works on all that its predecessor kept, and each is written as Parquet and read again. Models
are learned from the labelled rows of the stage's own input.

Defined results: a stage takes the columns of documents by name and leaves others out; an empty table gives an
empty one; rows of a null id are treated like any other, though nothing is learned from them; without labelled
rows no document is toxic; null texts and texts without a letter have no language and go there; repeated rows
are copies, of which one stays; of equal copies that of the least id stays; texts of any length pass every stage whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import language, neardup, packing, queries, secrets, toxicity
from marquee.llm.common import fold
from marquee.tables import new_path, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score more than 0.5, or 0.5 where there was something to learn."""
    labels = queries.table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0), "toxic")
    toxic = (F.col("toxic_score") >= 0.5) if len(weights.places) else F.col("toxic_score") > 0.5
    return toxicity.score(docs, weights, name="toxic_score", keep=COLUMNS).where(~toxic).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and those told with confidence to be in another than they claim.

    A document that claims none takes what is found; if there is nothing to learn from, those that claim one stay."""
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    if model is None:
        return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = language.identify(docs, model, keep=COLUMNS)
    wrong = F.coalesce((F.col("lang") != F.col("lang_pred")) & (F.col("lang_score") >= 0.9), F.lit(False))
    return found.where((F.col("lang_pred") != "und") & ~wrong).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the least id: similarity 0.8 on the shingles of two words that the
    operator's contract names (with five, an edited word of a short text changes so many that its copy is missed).

    Rows are told apart by a number of their own, so that repeated rows count as copies and null ids as rows."""
    rows = written(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(rows, k=2, percent=80, id_col="row").select("row", F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = written(groups.join(rows.select("doc_id", "row"), "row"), "grouped")
    first = groups.groupBy("group").agg(F.min(order)["row"].alias("row"))
    # What goes is far less than what stays: numbers alone, and small enough to be broadcast for most inputs.
    dropped = written(groups.select("row").join(first, "row", "left_anti"), "dropped")
    return rows.join(dropped, "row", "left_anti").select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no document goes."""
    found = secrets.find_secrets(docs, keep=[c for c in COLUMNS if c != "text"])
    text = F.col("found.redacted")
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("found.spans") != "", F.char_length(text).cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows of 4096 tokens."""
    out = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Learned models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what the stage itself writes goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
