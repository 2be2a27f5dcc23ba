from dataclasses import replace

from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import dbc, dbc_checks
from canlake.functions.dbc import Database, Message, Scope, Signal
from canlake.operators import decode

TEXT = '''VERSION ""
BU_: A B
BO_ 256 One: 8 A
 SG_ Mode M : 0|8@1+ (1,0) [0|255] "" A,B
 SG_ X m0 : 8|16@1- (0.5,-1) [0|0] "km" Vector__XXX
 SG_ Y m1 : 8|8@1+ (1,0) [0|0] "" B
BO_ 2566844672 Two: 8 Vector__XXX
 SG_ Level : 7|16@0+ (1,0) [0|0] "" A
EV_ Knob: 0 [0|1] "" 0 1 DUMMY_NODE_VECTOR0 A;
BA_DEF_ "BusType" STRING ;
BA_DEF_ BO_ "Cycle" INT 0 1000;
BA_DEF_ SG_ "Start" FLOAT 0 10;
BA_DEF_ BO_ "VFrameFormat" ENUM "StandardCAN","ExtendedCAN","J1939PG";
BA_DEF_DEF_ "BusType" "";
BA_DEF_DEF_ "Cycle" 100;
BA_DEF_DEF_ "VFrameFormat" "StandardCAN";
BA_ "BusType" "CAN";
BA_ "Cycle" BO_ 256 20;
BA_ "Start" SG_ 256 X 1.5;
BA_ "VFrameFormat" BO_ 2566844672 2;
'''


def test_attributes_receivers_and_environment_stay():
    d = dbc.read(TEXT)
    one, two = d.messages
    assert one.signals[0].receivers == ("A", "B") and one.signals[1].receivers == () and two.j1939
    assert d.attribute_definitions == (("", "BusType", "STRING", '""'), ("BO_", "Cycle", "INT 0 1000", "100"), ("SG_", "Start", "FLOAT 0 10", ""))
    assert [(a.name, a.kind, a.owner, a.value) for a in d.attributes] == [("BusType", "", "", '"CAN"'), ("Cycle", "BO_", "256", "20"), ("Start", "SG_", "256 X", "1.5")]
    assert len(d.environment) == 1 and dbc.read(dbc.write(d)) == d
    scopes = [Scope(d, 1), Scope(Database())]
    assert dbc_checks.from_json(dbc_checks.to_json(scopes)) == scopes
    assert dbc_checks.from_json('[{"database": {"messages": [{"id": 1, "name": "M", "size": 8}]}}]') == [Scope(Database((Message(1, "M", 8),)))]


def test_owners_and_problems():
    one = dbc.read(TEXT).messages[0]
    owners = dbc_checks.bit_owners(one, 24)
    assert owners[0] == "Mode" and owners[8] == "X" and owners[16] == "X"
    assert dbc_checks.bit_owners(one, 24, 1)[8:] == ["Y"] * 8 + [None] * 8 and dbc_checks.bit_owners(None, 3) == [None] * 3
    assert dbc_checks.problems(dbc.read(TEXT)) == []
    bad = Message(0x800, "no name", 9, signals=(Signal("a", 0, 8), Signal("a", 4, 8), Signal("b", 60, 16), Signal("c", 32, 16, kind="float32", factor=0.0), Signal("d", 40, 4, mux_value=1)))
    found = dbc_checks.problems(Database((bad, replace(bad, signals=()))))
    for text in ("not a name", "ID out of range", "no frame has 9 bytes", "no name.a: name used twice", "no name.a: over a", "no name.b: outside", "a float of 16", "factor 0", "pages without", "ID used twice"):
        assert any(text in line for line in found), text


def test_overridden_messages():
    group = schema.EXTENDED_ID | 0x18FEF100
    first = Scope(Database((Message(1, "A", 8), Message(group | 5, "J", 8, j1939=True))), 0)
    second = Scope(Database((Message(1, "B", 8), Message(2, "C", 8), Message(group | 6, "K", 8, j1939=True), Message(group | 7, "L", 8))), None)
    other_bus = Scope(Database((Message(1, "D", 8),)), 3)
    assert dbc_checks.overridden([first, second, other_bus]) == [{}, {1: 0, group | 6: 0}, {1: 1}]


def test_labels_of_large_numbers_and_a_factor_of_zero(spark):
    signal = dbc.Signal("State", 0, 32, "little", "unsigned", 1.0, 0.0, labels=((0xFFFFFFFF, "not available"), (5, "on")))
    message = dbc.Message(0x100, "M", 8, signals=(signal,))
    rows = [(0, 0, bytearray(b"\xff\xff\xff\xff")), (1, 1, bytearray(b"\x05\0\0\0")), (2, 2, bytearray(b"\0\0\0\x80"))]
    frames = spark.createDataFrame(rows, "seq long, ts_ns long, data binary").selectExpr("*", "0 channel", "256L id", "256L key", "0 flags", "'data' kind")
    got = decode.labelled(frames, [dbc.Scope(dbc.Database((message,)))], 256, "State").orderBy("seq").collect()
    assert [(r.value, r.label) for r in got] == [(4294967295.0, "not available"), (5.0, "on"), (2147483648.0, None)]
    numbers = spark.createDataFrame([(2.0,), (1.0,), (-3.0,), (float("nan"),)], "x double")
    for kind, want in (("unsigned", [-1, 0, 0, 0]), ("signed", [(1 << 63) - 1, 0, -(1 << 63), 0])):
        flat = dbc.Signal("Flat", 0, 16, "little", kind, 0.0, 1.0)
        assert [r.raw for r in numbers.select(decode.raw_for(F.col("x"), flat).alias("raw")).collect()] == want
