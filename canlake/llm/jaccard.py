"""Exact n-gram Jaccard join by vertical partitioning, without pairs of copies.

Documents with equal shingle sets form a class, and classes are joined:

1. A class that can have a partner must find at least (prefix length - allowed misses) of its smallest shingle hashes in
   other classes too. One shuffle of these prefixes leaves few classes.
2. Their shingles get a global order: rare first, cut into fragments of that order (vertical partitions). Shingles
   of a single class come first of all and can't be matched, so they use up the misses that a class may have.
3. Classes that share a shingle of what is left of the prefix are candidates. Each shingle's list is first
   joined with its most central class only; components of the links found make most of the other pairs needless,
   and then just the pairs between different components are joined.
4. A candidate pair's overlap is bounded by outlines, token counts in a few parts by hash; if the bound leaves
   enough, it is counted fragment by fragment and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canlake.llm.common import batches, written
from canlake.llm.graphs import components
from canlake.llm.text_arrays import LOWER, ONE, Texts, mix, word_names

#: Parts by hash of a set's outline, which bounds overlaps before they are counted.
PARTS = 128
#: Tokens of a prefix that tell whether a pair has met before.
HEAD = 32
#: Share of a set that the first filter's prefix holds beyond the allowed misses.
EXTRA = 0.12
_SALT = np.uint64(0xA24BAED4963EE407)


#: Bits of the filter of classes that is sent to all tasks; a full one lets more through, which costs time and changes no result.
FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of `bits` bits in which those of the keys are set; keys must be well mixed longs. It comes as bitmaps of 4 KB each."""
    place = F.expr(f"pmod({column}, {bits}) + 1")
    maps = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # at most bits / 32768 rows
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.map), np.uint8)
    return out


def hits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys have their bit set."""
    place = keys % np.uint64(len(table) * 8)
    return ((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1) > 0


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, ordered by both, and the first row of each text (n + 1 values)."""
    first, end, of = texts.words()
    hashes = word_names(LOWER[texts.data], first, end)
    prefix = ONE.prefix(hashes)
    count = np.bincount(of, minlength=texts.n)
    heads = np.concatenate(([0], np.cumsum(count)))
    long = np.flatnonzero(of[words - 1 :] == of[: len(of) - words + 1]) if len(of) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    keys = np.concatenate((ONE.windows(prefix, words)[long], ONE.spans(prefix, heads[short], heads[short + 1])))
    number = np.concatenate((of[long], short))
    order = np.lexsort((keys, number))
    keys, number = keys[order], number[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])
    keys, number = keys[new], number[new]
    return number, keys, np.searchsorted(number, np.arange(texts.n + 1))


def _names(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set: the mixed sum of its members' mixed hashes and its size."""
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys ^ _SALT), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _SALT)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a set of n that a partner may lack."""
    return n - (percent * n + 99) // 100


def _first_prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in the first filter's prefix of a set of n, and how many of them the prefix of any partner must have too.

    A set that may lack nothing still links with a larger partner. Its prefix holds no more than the extra members, so
    a set whose least partner is of that kind asks for no more than these.
    """
    allowed, extra = _allowed(n, percent), lambda n: np.maximum((EXTRA * n).astype(np.int64), 1)
    upto, least = np.minimum(allowed + extra(n), n), n - allowed
    need = upto - allowed
    return upto, np.where(_allowed(least, percent) > 0, need, np.minimum(need, extra(least)))


def _once(names: np.ndarray) -> np.ndarray:
    """1 for the first set of each name in a batch, 0 for its copies."""
    out = np.zeros(len(names), np.int64)
    out[np.unique(names, return_index=True)[1]] = 1
    return out


def _within(at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Rows of the first `upto` members of each set."""
    total = np.cumsum(upto)
    start = np.repeat(at[:-1] - np.concatenate(([0], total[:-1])), upto)
    return start + np.arange(len(start))


def _overlap(sum_of_sizes: Column, percent: int) -> Column:
    """The smallest overlap with which two sets link: o >= p / (100 + p) * (n + m)."""
    return F.ceil(sum_of_sizes * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def links(spark: SparkSession, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(a, b, overlap): links between class names that connect all linked classes, though not every single link."""
    only_text = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def prefixes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            _, keys, at = shingle_sets(Texts(b.column(0)), words)
            n = np.diff(at)
            upto, need = _first_prefix(n, percent)
            names = _names(keys, at)
            upto = upto * _once(names)  # copies of a set in one batch count once
            rows_of = _within(at, upto)
            name = np.repeat(names, upto)
            yield pa.RecordBatch.from_arrays([_long(keys[rows_of]), _long(name), pa.array(np.repeat(need, upto).astype(np.int32))], ["token", "name", "need"])

    token = Window.partitionBy("token")
    found = only_text.mapInArrow(prefixes, "token long, name long, need int")
    shared = found.withColumn("low", F.min("name").over(token)).withColumn("high", F.max("name").over(token)).where("low <> high")
    seen = shared.select("token", "name", "need").groupBy("name", "token").agg(F.first("need").alias("need")).groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
    left = written(seen.where("hits >= need").select("name"), "classes")

    told = spark.sparkContext.broadcast(bit_filter(left, "name"))  # of fixed size

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            _, keys, at = shingle_sets(Texts(b.column(0)), words)
            names = _names(keys, at)
            hit = np.flatnonzero(hits(told.value, names) & (_once(names) > 0))
            n = np.diff(at)
            upto = np.zeros(len(n), np.int64)
            upto[hit] = n[hit]
            rows_of = _within(at, upto)
            ends = np.concatenate(([0], np.cumsum(n[hit]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_long(names[hit]), _long(n[hit]), pa.ListArray.from_arrays(pa.array(ends), _long(keys[rows_of]))], ["name", "n", "tokens"])

    kept = only_text.mapInArrow(sets, "name long, n long, tokens array<long>").join(left, "name", "left_semi")
    classes = written(kept.groupBy("name").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")

    # the global order: rare tokens first, in bands of frequency, by hash within; a band is a fragment
    tokens = classes.select("name", "n", F.explode("tokens").alias("token")).withColumn("f", F.count(F.lit(1)).over(token)).where("f > 1")
    tokens = tokens.withColumn("fragment", F.least(F.floor(F.log2("f")), F.lit(15)).cast("int"))
    segments = tokens.groupBy("name", "n", "fragment").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    upto_here = Window.partitionBy("name").orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("name")
    segments = segments.withColumn("before", F.coalesce(F.sum(F.size("tokens")).over(upto_here), F.lit(0)).cast("int"))
    segments = segments.withColumn("lone", F.col("n") - F.sum(F.size("tokens")).over(whole))
    spare = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100) - F.lit(1e-9)) - F.col("lone")
    segments = written(segments.withColumn("spare", spare.cast("int")).where("spare >= 0"), "segments")

    # the rest of the prefix: each token with its place in the set's order, and the first few of them
    reach = F.expr("greatest(0, least(size(tokens), spare + 1 - before))")
    heads = segments.select("name", "fragment", F.slice("tokens", F.lit(1), F.least(reach, F.lit(HEAD))).alias("part")).groupBy("name")
    head = heads.agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "part"))), lambda x: x["part"])), 1, HEAD).alias("head"))
    spread = segments.select("name", "n", "lone", "before", F.posexplode(F.slice("tokens", F.lit(1), reach)).alias("at", "token"))
    spread = spread.select("name", "token", F.struct("name", "n", "lone", (F.col("lone") + F.col("before") + F.col("at")).alias("place")).alias("set"))
    index = written(spread.join(head, "name").select("name", "token", F.struct("set.*", "head").alias("set")), "index")

    def may(a: str, b: str) -> Column:
        """Sizes, unmatched shingles and the token's places leave the pair enough overlap, and it has met at no earlier token."""
        each = lambda f: F.least(f(a), f(b))
        before, after = each(lambda x: F.col(f"{x}.place") - F.col(f"{x}.lone")), each(lambda x: F.col(f"{x}.n") - F.col(f"{x}.place"))
        met = F.try_element_at(F.array_intersect(F.col(f"{a}.head"), F.col(f"{b}.head")), F.lit(1))
        return (before + after >= _overlap(F.col(f"{a}.n") + F.col(f"{b}.n"), percent)) & F.coalesce(met == F.col("token"), F.lit(True))

    # how many matchable tokens of each class fall into each of a few parts by hash; the sum of the smaller counts bounds an overlap
    def counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            lists = b.column(1)
            tokens = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            part = owner * PARTS + (tokens % np.uint64(PARTS)).astype(np.int64)
            table = np.bincount(part, minlength=b.num_rows * PARTS).astype(np.int32)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * PARTS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(table))], ["name", "counts"])

    whole_sets = segments.groupBy("name").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    outlines = written(whole_sets.mapInArrow(counts, "name long, counts array<int>"), "outlines")

    def outlined(pairs: DataFrame) -> DataFrame:
        """The pairs whose outlines leave them enough overlap."""
        both = pairs.join(outlines.select(F.col("name").alias("a"), F.col("counts").alias("ca")), "a").join(outlines.select(F.col("name").alias("b"), F.col("counts").alias("cb")), "b")
        most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        return both.where(most >= _overlap(F.col("n") + F.col("m"), percent)).select("a", "b", "n", "m")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n, m) that link, by the sum of their overlaps in each fragment."""
        left_side = segments.select(F.col("name").alias("a"), "fragment", F.col("tokens").alias("ta"))
        right_side = segments.select(F.col("name").alias("b"), "fragment", F.col("tokens").alias("tb"))
        part = outlined(pairs).join(left_side, "a").join(right_side, ["b", "fragment"]).select("a", "b", "n", "m", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
        total = part.groupBy("a", "b", "n", "m").agg(F.sum("part").alias("overlap"))
        return total.where(F.col("overlap") * 100 >= percent * (F.col("n") + F.col("m") - F.col("overlap"))).select("a", "b", "overlap")

    def pair(a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.name").alias("a"), F.col(f"{b}.name").alias("b"), F.col(f"{a}.n").alias("n"), F.col(f"{b}.n").alias("m")]

    centre = index.groupBy("token").agg(F.min(F.struct("set.lone", "set.name", "set")).alias("c")).select("token", F.col("c.set").alias("c"))
    star = index.select("token", F.col("set").alias("i")).join(centre, "token").where((F.col("i.name") != F.col("c.name")) & may("i", "c"))
    nearest = star.select(*pair("i", "c")).groupBy("a").agg(F.min_by(F.struct("b", "n", "m"), F.struct(F.abs(F.col("n") - F.col("m")), "b")).alias("of")).select("a", "of.*")
    first = written(verified(nearest), "links")
    label = components(first).withColumnRenamed("node", "name")
    labelled = index.join(label, "name", "left").select("token", F.coalesce("component", "name").alias("component"), "set")
    # only pairs of different components are left; the largest component of a token isn't joined with itself
    sizes = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("components")).where("components > 1").drop("components")
    mixed = written(labelled.join(largest, "token").withColumn("is_largest", F.col("component") == F.col("largest")).drop("largest"), "labelled")
    one = mixed.where("not is_largest").select("token", F.col("component").alias("x"), F.col("set").alias("i"))
    two = mixed.select("token", F.col("component").alias("y"), "is_largest", F.col("set").alias("j"))
    apart = (F.col("x") != F.col("y")) & (F.col("is_largest") | (F.col("x") < F.col("y")))
    rest = verified(one.join(two, "token").where(apart & may("i", "j")).select(*pair("i", "j")).distinct())
    return written(first.union(rest), "links")


def classes_of(docs: DataFrame, text: str = "text", words: int = 4, keep_text: bool = False, size: str = "n_shingles", of: str = "class") -> DataFrame:
    """docs (without its text, unless asked for) with the size of its set and the name of its class (null without shingles)."""
    docs = docs.drop(size, of)
    keep = [c for c in docs.columns if c != text or keep_text]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, column=text):
            _, keys, at = shingle_sets(Texts(b.column(b.schema.get_field_index(text))), words)
            n = np.diff(at)
            name = pa.array(_names(keys, at).view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(n.astype(np.int64)), name], [*keep, size, of])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], f"`{size}` long, `{of}` long"])
    return docs.mapInArrow(run, schema)


def _components(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(class, component, component_id) of the members (doc_id, class) of docs (doc_id, text)."""
    label = components(links(docs.sparkSession, docs, "text", words, percent)).withColumnRenamed("node", "class")
    of = members.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    named = of.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.select("class", "component").join(ids, "component").select("class", "component", "component_id")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each document and the smallest id that links reach from it.

    ASCII letters are lower-cased. A text of fewer words is one shingle; a text without words, empty or null has none
    and links with nothing, so its component is its own id. Equal texts and repeated rows share a class. Ids that are
    null count last: a component has a null id only if all its ids are null. Other columns are not read. Shingles and
    classes are named by 64-bit hashes.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = written(classes_of(docs, "text", words), "members")
    told = _components(members, docs, words, percent).select("class", "component_id")
    return members.join(told, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, and all documents without shingles.

    Columns stay as they are. Of equal rows, and of rows with one id and equal shingles, one stays; null ids come last.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = written(classes_of(plain, "text", words), "members")
    told = _components(members, plain, words, percent)
    best = F.min_by(F.struct("doc_id", "class"), F.struct(F.col("doc_id").isNull(), "doc_id", "class")).alias("best")
    stay = written(members.join(told, "class").groupBy("component").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.class").alias("_class")), "stay")
    size, of, its_id, its_class = (_free(docs, c) for c in ("size", "class", "_id", "_class"))
    stay = stay.withColumnsRenamed({"_id": its_id, "_class": its_class})
    tagged = classes_of(docs, text, words, True, size, of)
    chosen = tagged.join(stay, F.col(doc_id).eqNullSafe(F.col(its_id)) & (F.col(of) == F.col(its_class)), "left_semi").dropDuplicates([doc_id, of])
    return chosen.unionByName(tagged.where(F.col(of).isNull())).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name like this that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
