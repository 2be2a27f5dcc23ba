"""The database that describes the frames of the events table, as DBC text."""

from __future__ import annotations

from canlake.functions import dbc

_SIGNALS = """ SG_ Counter : 0|8@1+ (1,0) [0|255] "" Vector__XXX
 SG_ Code M : 8|8@1+ (1,0) [0|4] "" Vector__XXX
 SG_ Value : 16|16@1+ (0.01,0) [0|655.35] "" Vector__XXX
 SG_ ValueBig : 23|16@0- (1,0) [0|0] "" Vector__XXX
 SG_ Nibbles : 12|8@1- (0.5,-10) [0|0] "" Vector__XXX
 SG_ WhenBuying m2 : 32|8@1+ (1,0) [0|255] "" Vector__XXX
 SG_ WhenViewing m4 : 40|16@1+ (2,1) [0|0] "" Vector__XXX
 SG_ Sum : 56|8@1+ (1,0) [0|255] "" Vector__XXX
"""

TEXT = (
    "".join(f"BO_ {i} STREAM_{i}: 8 Vector__XXX\n{_SIGNALS}\n" for i in range(256, 266))
    + 'BO_ 2566844740 CRUISE: 8 Vector__XXX\n SG_ Level : 0|8@1+ (1,0) [0|250] "" Vector__XXX\n SG_ Word : 16|16@1+ (0.5,0) [0|0] "" Vector__XXX\n\n'
    + 'VAL_ 256 Code 1 "click" 2 "purchase" 3 "signup" 4 "view" ;\n'
    + 'BA_DEF_ BO_ "VFrameFormat" ENUM "StandardCAN","ExtendedCAN","J1939PG";\nBA_DEF_DEF_ "VFrameFormat" "StandardCAN";\nBA_ "VFrameFormat" BO_ 2566844740 2;\n'
)


def database() -> dbc.Database:
    return dbc.read(TEXT)
