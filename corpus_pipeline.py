"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents,
except the last, which returns token ids. It needs the training-data operators and does not run without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import jaccard, language, mixing, pieces, prefix_free, q_quality, q_tokens
from canlake.llm.common import WORD, table, written
from canlake.llm.spans import KEY, counted, placed

#: SQL can't express these stages; tests/llm/test_pipeline.py runs them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it as their label.

    Texts that are null or have no letter go, and so do those whose score is below language.least_score: the model sees
    in them none of the languages that it learned. Without a labelled text to learn from, every text with a letter stays
    as it is.
    """
    model = q_quality.language_model(docs)
    if model is None:
        return language.with_letters(docs)
    told = language.identify(docs, model, pred="_told", score="_score")
    kept = told.where((F.col("_told") != language.UNKNOWN) & (F.col("_score") >= language.least_score(model)))
    return kept.withColumn("lang", F.col("_told").cast(docs.schema["lang"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 100 bytes; a document that has no word left goes.

    Bytes of a code point that was cut through go too, and n_chars is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = prefix_free.remove_repeated_strings(docs, keep=[*others, "n_chars"])
    shown = cut.select("doc_id", "n_removed", F.col("kept_text").alias("text"), "extra").where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_removed") == 0, F.col("extra.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return shown.select("doc_id", "text", length.alias("n_chars"), *[F.col(f"extra.{c}").alias(c) for c in others]).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all."""
    rows = placed(docs, "doc_id", "text", docs.columns, by=docs.columns)  # equal keys are equal rows
    sized = rows.select(*KEY, F.col("extra.source").alias("source"), mixing.words_in(F.col("text")).alias("size"))
    times = mixing.mix(sized, doc_id="tie").where("times > 0").groupBy(*KEY).agg(F.sum("times").alias("times"))
    once = counted(rows).join(written(times, "times"), KEY)
    return once.select(F.explode(F.sequence(F.lit(1).cast("long"), "times")), "extra").select("extra.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, as piece ids."""
    return pieces.sample_encodings(docs, q_tokens.model(spark), samples=2)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
