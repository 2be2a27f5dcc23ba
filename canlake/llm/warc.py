"""WARC fixity audit by Merkle trees over records and ordered offset ranges.

Pages become WARC response records in files; a record's leaf is the SHA-256 of its bytes. A file's records are cut into
ranges of RANGE_BYTES of offsets; a range's node hashes its records' offsets and leaves in order. FANOUT neighbouring
nodes make the next level's node, first up to the file, then over files up to one root. Two replicas are compared root
first, and each level only looks at the children of nodes that differ, down to the records of the ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.llm.common import utf8, written

RANGE_BYTES, FANOUT = 1 << 18, 16
#: Files get about this many bytes; records are dealt to them by a hash.
FILE_BYTES = 1 << 28
#: Hex digits that name the part of a file: 256 of them.
PART_DIGITS = 2


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record: header, an empty line, the page, and two line ends. Nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return utf8(F.concat(head, body, F.lit("\r\n\r\n")))


def layout(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, length, copies, page_id, url, html): the records of the pages in their files.

    A record's file follows from the MD5 of its bytes, and its offset from the sizes of the records before it, in the
    order of these digests. Pages are moved once, in parts of files; where a part begins comes from the small table of
    part sizes. Equal rows make one record with their number in `copies`; rows that only differ in nulls and empty
    strings have one digest, and are ordered by those. An empty table has no files; other columns are not read.
    """
    total = pages.agg(F.sum(F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("long"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("lot", F.md5(record_bytes(F.col("page_id"), F.col("url"), F.col("html"))))
    digits = lambda first, n: F.conv(F.substring("lot", first, n), 16, 10).cast("long")
    rows = rows.withColumn("file", digits(1, 8) % files).withColumn("part", F.substring("lot", 1, PART_DIGITS))
    keys = ["file", "part"]
    dealt = rows.repartition(*keys).groupBy(*keys, "lot", "page_id", "url", "html").agg(F.count(F.lit(1)).alias("copies"))
    dealt = dealt.withColumn("length", F.octet_length(record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).cast("long"))
    order = Window.partitionBy(*keys).orderBy("lot", "page_id", "url", "html").rowsBetween(Window.unboundedPreceding, -1)
    inside = written(dealt.withColumn("inside", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("lot"), "records")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.groupBy(*keys).agg(F.sum("length").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return inside.join(starts, keys).select("file", (F.col("start") + F.col("inside")).alias("offset"), "length", "copies", "page_id", "url", "html")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, leaf): a hash of each record's bytes and its number of copies."""
    body = F.concat(record_bytes(F.col("page_id"), F.col("url"), F.col("html")), utf8(F.concat(F.lit("copies "), F.col("copies").cast("string"))))
    return records.select("file", "offset", "length", "page_id", F.sha2(body, 256).alias("leaf"))


class Tree:
    """The levels of a replica's Merkle tree, each a table (node, hash), ranges first and the root last."""

    def __init__(self, records: DataFrame, height: int, files_height: int, range_bytes: int, fanout: int) -> None:
        self.width = fanout**height
        self.fanout = fanout
        self.records = records.withColumn("node", F.col("file") * self.width + F.floor(F.col("offset") / range_bytes).cast("long"))
        inside = F.array_sort(F.collect_list(F.concat_ws(" ", F.lpad(F.col("offset").cast("string"), 20, "0"), "leaf")))
        self.levels = [written(self.records.groupBy("node").agg(F.sha2(F.concat_ws("\n", inside), 256).alias("hash")), "ranges")]
        for _ in range(height + files_height):
            children = F.array_sort(F.collect_list(F.concat_ws(" ", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")))
            parent = F.floor(F.col("node") / fanout).cast("long")
            self.levels.append(written(self.levels[-1].groupBy(parent.alias("parent")).agg(F.sha2(F.concat_ws("\n", children), 256).alias("hash")).withColumnRenamed("parent", "node"), "level"))


def _height(count: int, fanout: int) -> int:
    height = 0
    while fanout**height < count:
        height += 1
    return height


def grow(replicas: list[DataFrame], range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[Tree]:
    """Trees of the same shape over the replicas' leaves, which are written once."""
    replicas = [written(r, "leaves") for r in replicas]
    ends = [r.agg(F.max("offset"), F.max("file")).first() for r in replicas]
    height = _height(max(((e[0] or 0) // range_bytes) + 1 for e in ends), fanout)
    files = _height(max((e[1] or 0) + 1 for e in ends), fanout)
    return [Tree(r, height, files, range_bytes, fanout) for r in replicas]


def audit(left: Tree, right: Tree) -> DataFrame:
    """(file, offset, page_id, length, kind) of the records in which the right replica differs from the left.

    kind is altered, missing or extra; a record with a lost or added copy is altered. Nulls count as empty. Equal roots end the audit at once; otherwise each level joins only the children of
    the nodes that differ, so the records of ranges that agree are never compared.
    """
    suspects: DataFrame | None = None
    for level in range(len(left.levels) - 1, -1, -1):
        sides = []
        for tree in (left, right):
            nodes = tree.levels[level]
            if suspects is not None:
                nodes = nodes.withColumn("up", F.floor(F.col("node") / tree.fanout).cast("long")).join(suspects, F.col("up") == F.col("suspect"), "left_semi").drop("up")
            sides.append(nodes)
        joined = sides[0].withColumnRenamed("hash", "one").join(sides[1].withColumnRenamed("hash", "two"), "node", "full_outer")
        suspects = written(joined.where(~F.col("one").eqNullSafe(F.col("two"))).select(F.col("node").alias("suspect")), "suspects")
        if not suspects.limit(1).count():
            break
    of = [t.records.join(suspects, F.col("node") == F.col("suspect"), "left_semi").select("file", "offset", "page_id", "length", "leaf") for t in (left, right)]
    a, b = of[0].alias("a"), of[1].alias("b")
    both = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.offset") == F.col("b.offset")), "full_outer")
    kind = F.when(F.col("b.leaf").isNull(), "missing").when(F.col("a.leaf").isNull(), "extra").otherwise("altered")
    told = both.where(~F.col("a.leaf").eqNullSafe(F.col("b.leaf")))
    return told.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("file", "offset", "page_id", "length")], kind.alias("kind"))
