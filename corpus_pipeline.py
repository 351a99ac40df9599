"""A corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing. Each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winfleet.llm import language_id, mixing, order_minhash, packing, recompression
from winfleet.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected that is surely less than half as like its language as the language's own documents are on average.
#: Documents of a learned language are mostly at 0.8 to 1.2, those of an unlearned one at 0.2 to 0.4, random letters below 0.1.
MIN_FIT = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null and letterless texts go, and what is surely not in any learned one; short texts stay."""
    model = language_id.learn(docs.where(~language_id.held_out()).select("lang", "text"))
    return language_id.predicted(docs.select(COLUMNS), model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("fit") >= MIN_FIT)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has. Texts that lose nothing stay as they are, with their white space."""
    cut = recompression.without_repeats(docs.select(COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    rows = cut.where(~changed | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return rows.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rates = mixing.mixed(docs).groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rates = written(rates.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "copies"), "mix-copies")
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("__text"))
    chosen = marked.join(rates, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__mark")))
    # Rows that repeat exactly are counted together, so one of them carries the copies of all.
    return chosen.dropDuplicates(["doc_id", "__text"]).select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows go through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL can state these stages; tests hold each against a brute-force version.
ORACLE_SQL = None
