"""The frame: the one fact row of a CAN log, and the constants of its columns."""

from __future__ import annotations

# Bits of an arbitration ID and of a frame's flags.
EXTENDED_ID, ERROR_ID = 1 << 31, 1 << 29
FD, BRS, ESI, REMOTE, ERROR, TX, REASSEMBLED = 1, 2, 4, 8, 16, 32, 64

# Payload length of each data length code of CAN FD.
DLC_LENGTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64]

#: Time order of a log: time in ns, then the order of the file.
ORDER = ["ts_ns", "seq"]

FRAME_DDL = "seq long, ts_ns long, channel int, id long, key long, flags int, kind string, len int, remote_dlc int, data binary"
