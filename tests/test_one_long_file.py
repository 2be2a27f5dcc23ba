"""The lines of one long file are read by all tasks: what its header says is sent to them."""

import pytest
from pyspark.sql import functions as F

from canlake.sources import asc, csv_log, trc

LOGS = {
    "trc": (trc.trc, [";$FILEVERSION=2.1", ";$STARTTIME=45292", ";$COLUMNS=N,O,T,B,I,d,R,L,D", "1 0.001 DT 1 0103 Rx - 2 0A 0B"]),
    "csv": (csv_log.csv, ["timestamp,channel,id,dlc,data", "1.5,can1,0x103,2,0a0b"]),
    "asc": (asc.asc, ["base hex  timestamps absolute", "0.001000 1 103 Rx d 2 0A 0B"]),
}


@pytest.mark.parametrize("name", sorted(LOGS))
def test_lines_are_not_dealt_by_file(spark, name):
    read, text = LOGS[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = read(spark.createDataFrame(list(enumerate(text)), "seq long, line string"))
        assert [(r.data, r.rejected) for r in found.select(F.hex("data").alias("data"), "rejected").collect()] == [("0A0B", False)]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hex_data_of_any_writing_is_read_as_before(spark):
    cells = {"0a0b": "0A0B", "0A 0B": "0A0B", "0x0A-0x0B": "0A0B", "CgsM": "0A0B", "zz!": None, "": ""}
    lines = ["timestamp,id,dlc,data"] + [f"1.5,103,{0 if not c else 2},{c}" for c in cells]
    found = csv_log.csv(spark.createDataFrame(list(enumerate(lines)), "seq long, line string")).orderBy("seq")
    assert [r.data for r in found.select(F.hex("data").alias("data")).collect()] == list(cells.values())
