"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of byte n-grams (1 to 4 bytes, ASCII letters
lower-cased, digits and symbols read as blanks) that occur in both, divided by the geometric mean of their own counts.
A Nystrom approximation over landmark texts turns a text into its kernel values with the landmarks, and one-versus-rest
kernel ridge regression over them gives a score for each language. Both are products of a batch matrix with a small one.

N-grams are named by a hash into DIM places, so a text is a row of DIM presence bits whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canlake.llm.common import batches
from canlake.llm.text_arrays import LOWER, Texts

#: Places of n-gram names, longest n-gram, bound on the training texts of a language, landmarks, and ridge.
DIM, LONGEST, PER_LANGUAGE, LANDMARKS, RIDGE = 1 << 14, 4, 400, 192, 1e-3
#: Texts scored by one matrix product, and how sharply scores become probabilities.
BATCH, SHARPNESS = 256, 6.0
UNKNOWN = "und"
#: Slices of a language's keys that are ordered apart from each other.
SLICES = 16
#: A text whose score is less than this share of the way from an even share of the languages to 1 is in none of them.
LEAST_LEAD = 0.125
#: Letters, and bytes of letters outside ASCII, count; everything else is a blank.
_READ = np.where((np.arange(256) >= 128) | np.isin(LOWER, np.frombuffer(bytes(range(97, 123)), np.uint8)), LOWER, 32).astype(np.uint32)
_MULTIPLIER = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - DIM.bit_length() + 1)


def presence(texts: Texts) -> np.ndarray:
    """A row of 0 and 1 for each text: which n-gram names occur in it."""
    out = np.zeros((texts.n, DIM), np.float32)
    flat = out.reshape(-1)
    read = _READ[texts.data]
    size = texts.offsets[1:] - texts.offsets[:-1]
    row = np.repeat(np.arange(texts.n, dtype=np.int64) * DIM, size)
    last = np.repeat(texts.offsets[1:], size)
    code = np.zeros(len(read), np.uint32)
    for n in range(1, LONGEST + 1):
        places = len(read) - n + 1
        if places <= 0:
            break
        code = (code[:places] << np.uint32(8)) | read[n - 1 :]
        whole = np.arange(n, len(read) + 1) <= last[:places]
        name = ((code ^ np.uint32(n * 0x01000193)) * _MULTIPLIER) >> _SHIFT
        flat[(row[:places] + name)[whole]] = 1
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel between the rows of two presence matrices."""
    size = np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(b.sum(axis=1), 1))[None, :]
    return (a @ b.T) / size


@dataclass
class Model:
    """Landmark presence bits (packed), the weights of each language over the landmarks, and the languages."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1)[:, :DIM].astype(np.float32)
        return kernel(rows, marks) @ self.weights


def packed_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows, 1 << 20):
        for first in range(0, b.num_rows, BATCH):
            part = b.slice(first, BATCH)
            bits = np.packbits(presence(Texts(part.column(1))) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model fitted on at most `per_language` texts of each language, those with the smallest hash of their key.

    Only presence bits (DIM / 8 bytes a text) reach the driver. Rows without text or language aren't used; without any
    such row there is no model.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(key)).alias("lot"))
    # each language's bound comes from the keys alone, so only the chosen texts are moved; equal keys give one text
    order = Window.partitionBy("lang").orderBy("lot")
    # the smallest of each slice first, so that no task orders all keys of a language
    slices = Window.partitionBy("lang", F.pmod("lot", F.lit(SLICES))).orderBy("lot")
    least = rows.select("lang", "lot").distinct().withColumn("at", F.row_number().over(slices)).where(F.col("at") <= per_language).drop("at")
    bounds = least.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language).groupBy("lang").agg(F.max("lot").alias("bound"))
    near = rows.join(F.broadcast(bounds), "lang").where(F.col("lot") <= F.col("bound"))  # a row for each language
    chosen = near.groupBy("lang", "lot").agg(F.min("text").alias("text")).select("lang", "text")
    sample = chosen.mapInArrow(packed_rows, "lang string, bits binary").toPandas()
    if sample.empty:
        return None
    bits = np.frombuffer(b"".join(sample.bits), np.uint8).reshape(len(sample), -1)
    order = np.lexsort((*bits.T[:8], sample.lang.to_numpy().astype(str)))
    bits, names = bits[order], sample.lang.to_numpy().astype(str)[order]
    languages = sorted(set(names))
    rng = np.random.default_rng(7)
    share = max(landmarks // len(languages), 1)
    chosen_rows = np.concatenate([rng.permutation(np.flatnonzero(names == x))[:share] for x in languages])
    every, marks = np.unpackbits(bits, axis=1)[:, :DIM].astype(np.float32), bits[chosen_rows]
    near = kernel(every, np.unpackbits(marks, axis=1)[:, :DIM].astype(np.float32)).astype(np.float64)
    among = near[chosen_rows]
    goal = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = 1.0 / np.array([(names == x).sum() for x in names])[:, None] * len(names) / len(languages)
    left = near.T @ (near * balance) + ridge * len(names) * (among + 1e-6 * np.eye(len(among)))
    weights = np.linalg.lstsq(left, near.T @ (goal * balance), rcond=None)[0]
    return Model(languages, marks, weights.astype(np.float32))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, column=text):
            column = b.column(b.schema.get_field_index(text))
            yield b.filter(pa.array([has_letter(t.as_py()) for t in column], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def least_score(model: Model) -> float:
    """The score below which no learned language is told: LEAST_LEAD of the way from an even share to 1; 0 with one language."""
    n = len(model.languages)
    return 1 / n + LEAST_LEAD * (1 - 1 / n) if n > 1 else 0.0


def identify(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a predicted language and a score from 0 to 1, from the whole text alone.

    Null texts, texts without a letter, and all texts where there is no model get `und` and score 0. Equal texts get equal
    answers; columns named like an output are replaced; an empty table stays empty.
    """
    docs = docs.drop(pred, score)
    keep = docs.columns
    told = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: landmarks x DIM bits and a row of weights each

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for whole in batches(rows, 1 << 20, text):
            for first in range(0, whole.num_rows, BATCH):
                b = whole.slice(first, BATCH)
                column = b.column(b.schema.get_field_index(text))
                names, top = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
                if model:
                    s = model.scores(presence(Texts(column)))
                    e = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
                    best, sure = s.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
                    for i, t in enumerate(column):
                        value = t.as_py()
                        if has_letter(value):
                            names[i], top[i] = model.languages[best[i]], min(float(sure[i]), 1.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(top)], [*keep, pred, score])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{pred}` string, `{score}` double"])
    return docs.mapInArrow(run, schema)
