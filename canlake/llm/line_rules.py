"""Quality rules by cross-document line frequency: lines that many documents of one host share are boilerplate.

Each document's lines are normalised (ASCII letters lower-cased, digits read as 0, white space collapsed) and hashed;
documents are counted for each (host, line). Lines in more documents than the host's limit are removed, and a document
that keeps less than a share of its words is rejected as depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake.llm.common import batches, on, written
from canlake.llm.text_arrays import FOLDED, ONE, STARTS, SPACE, Texts, covered, mix, repeated, word_names

#: A line is removed where more documents of its host have it than both of these: a number, and a share of the host's documents.
LIMIT_DOCS, LIMIT_SHARE = 20, 0.01
#: A document is depleted if less than this share of its words stays.
LEAST_SHARE = 0.5
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def _digest(texts: Texts) -> list[pa.Array]:
    data, n = texts.data, texts.n
    first, end, of = texts.words()
    prefix = ONE.prefix(ONE.bytes[data])
    words = word_names(data, first, end, prefix)
    n_words = np.bincount(of, minlength=n)
    salt = mix(of.astype(np.uint64) + np.uint64(1))

    repeat = np.zeros(n, np.int64)
    if len(of) > 2:
        within = of[2:] == of[:-2]
        triples = ONE.windows(ONE.prefix(words), 3)[within] ^ salt[:-2][within]
        more, _ = repeated(triples)
        repeat = np.bincount(of[covered(np.flatnonzero(within)[more], 3, len(of))], minlength=n)

    at, stop, line_of = texts.lines()
    words_before, words_upto = np.searchsorted(first, at), np.searchsorted(first, stop)
    has = words_upto > words_before
    at, stop, line_of, words_before, words_upto = (x[has] for x in (at, stop, line_of, words_before, words_upto))
    line_salt = mix(line_of.astype(np.uint64) + np.uint64(1))
    _, later = repeated(word_names(data, at, stop, prefix) ^ line_salt)
    dup = np.bincount(line_of[later], minlength=n)

    folded = word_names(FOLDED[data], first, end)
    names = ONE.spans(ONE.prefix(folded), words_before, words_upto)
    order = np.lexsort((names, line_of))
    names, line_of, size = names[order], line_of[order], (words_upto - words_before)[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (line_of[1:] != line_of[:-1])
    heads = np.flatnonzero(new)
    sizes = np.add.reduceat(size, heads) if len(heads) else np.zeros(0, np.int64)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(line_of[heads], minlength=n), out=ends[1:])
    items = pa.StructArray.from_arrays([pa.array(names[heads].view(np.int64)), pa.array(sizes.astype(np.int32))], ["line", "words"])
    chars = texts.per_text(STARTS[data] & ~SPACE[data])
    counts = [n_words, chars, texts.per_text(_SYMBOLS[data]), dup, repeat]
    return [*[pa.array(c.astype(np.int64)) for c in counts], pa.ListArray.from_arrays(pa.array(ends), items)]


def line_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the base counts of each whole text and its distinct normalised lines."""
    keep = [c for c in docs.columns if c != text]
    names = [*keep, *[c.split()[0] for c in _DIGEST.split(", ")]]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, column=text):
            table = pa.Table.from_batches([b])
            made = _digest(Texts(b.column(b.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in keep], *made], names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], _DIGEST])
    return docs.mapInArrow(run, schema)


def judge_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each document: its id, base counts, words left after the removal of frequent lines, and `depleted`.

    A null text has no words and is not depleted; null hosts form one host; equal rows and equal ids count as separate
    documents; other columns are not read.
    """
    inner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).cast("string").alias("host"))
    digests = written(line_digests(inner).withColumn("_row", F.monotonically_increasing_id()), "lines")
    lines = digests.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.line", "l.words")
    hosts = digests.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    seen = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > limit_docs)
    frequent = written(seen.join(hosts.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n_docs") > limit_share * F.col("host_docs")).select("host", "line", "n_docs"), "frequent")
    gone = lines.alias("l").join(frequent.alias("f"), on(lines, frequent, ["host", "line"])).groupBy("l._row").agg(F.sum("l.words").alias("gone"))
    counted = digests.drop("lines").join(gone, "_row", "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return counted.withColumn("words_left", left).withColumn("depleted", F.col("words_left") < least_share * F.col("n_words")).drop("_row", "gone")
