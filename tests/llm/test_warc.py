import hashlib

from pyspark.sql import functions as F

from canlake.llm import warc


def pages(spark, n=300):
    rows = [(i, f"http://h{i % 7}/{i}", "x" * (i * 37 % 900)) for i in range(n)]
    rows += [(None, None, None), (5, "http://twice", "é"), (5, "http://twice", "é"), (n, None, ""), (n + 1, "u", "y" * 50000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))


def test_layout_is_gapless_and_leaves_are_hashes(spark):
    records = warc.layout(pages(spark), file_bytes=40000).collect()
    assert len(records) == 304 and {r.copies for r in records} == {1, 2}
    by_file = {}
    for r in records:
        by_file.setdefault(r.file, []).append(r)
    assert len(by_file) > 2
    for rows in by_file.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    for r in warc.leaves(warc.layout(pages(spark)).where("page_id = 5 and copies = 2")).collect():
        body = "é".encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://twice\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        assert r.leaf == hashlib.sha256(head + body + b"\r\n\r\n" + b"copies 2").hexdigest() and r.length == len(head + body) + 4


def test_a_lost_copy_is_found(spark):
    records = warc.layout(pages(spark), file_bytes=30000).cache()
    replica = records.withColumn("copies", F.when(F.col("url") == "http://twice", 1).otherwise(F.col("copies")).cast("long"))
    found = warc.audit(*warc.grow([warc.leaves(records), warc.leaves(replica)], range_bytes=1000, fanout=3)).collect()
    place = records.where("url = 'http://twice'").first()
    assert [(r.kind, r.page_id, r.file, r.offset) for r in found] == [("altered", 5, place.file, place.offset)]


def test_audit_finds_exactly_the_damage(spark):
    records = warc.layout(pages(spark), file_bytes=30000).cache()
    replica = records.where("page_id is null or page_id not in (11, 250)").withColumn("html", F.when(F.col("page_id").isin(3, 77), F.lit("z")).otherwise(F.col("html")))
    extra = spark.createDataFrame([(1, 10**7, 5, 1, 9999, "u", "h")], records.schema)
    trees = warc.grow([warc.leaves(records), warc.leaves(replica.union(extra))], range_bytes=1000, fanout=3)
    got = sorted((r.kind, r.page_id) for r in warc.audit(*trees).collect())
    assert got == [("altered", 3), ("altered", 77), ("extra", 9999), ("missing", 11), ("missing", 250)]
    same = warc.grow([warc.leaves(records), warc.leaves(records)], range_bytes=1000, fanout=3)
    assert warc.audit(*same).count() == 0 and same[0].levels[-1].count() == 1


def test_empty(spark):
    none = warc.leaves(warc.layout(pages(spark).limit(0)))
    assert warc.audit(*warc.grow([none, none])).count() == 0
