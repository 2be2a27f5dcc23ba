"""Queries that turn texts into tokens: SentencePiece encoding and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canlake.llm import pieces, token_counts
from canlake.llm.common import table

#: The setting that names the folder of public tokenizers on the driver, where it is by default, and the model taken from it.
SETTING, TOKENIZERS, NAME = "spark.canlake.tokenizers", "/opt/tokenizers", "piece_bpe_32k.model"
MODEL = f"{TOKENIZERS}/{NAME}"
#: The tokenizer that counts, and the tokens above which a text is over its limit.
WORD_NAME, LIMIT = "word_bpe_49k.json", 2048


def model(spark: SparkSession) -> str:
    """The model's path; only the driver reads it."""
    return f"{spark.conf.get(SETTING, TOKENIZERS)}/{NAME}"


def word_model(spark: SparkSession) -> str:
    return f"{spark.conf.get(SETTING, TOKENIZERS)}/{WORD_NAME}"


def spread(docs: DataFrame) -> DataFrame:
    """docs in a part for each core, where its files give fewer parts: tokenising takes longer than moving the texts."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole text, with their piece ids."""
    return pieces.sample_encodings(spread(table(spark, sf_dir, "documents")), model(spark), samples=2)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text."""
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), word_model(spark), LIMIT)


QUERIES = {"op9_sentencepiece": op9_sentencepiece, "op12_token_counts": op12_token_counts}
ORACLES: dict = {}
