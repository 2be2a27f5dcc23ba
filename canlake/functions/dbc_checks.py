"""Checks of databases and lookups in them; databases are small and stay on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import asdict

from canlake import schema
from canlake.functions import bits
from canlake.functions.dbc import Attribute, Database, Message, Scope, Signal

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def signal_bits(signal: Signal) -> list[int]:
    """The payload bits of a signal as byte * 8 + bit, from the least significant on."""
    return [b * 8 + bit for b, bit in bits.positions(signal.start, signal.size, signal.order)]


def bit_owners(message: Message | None, count: int, page: int | None = None) -> list[str | None]:
    """For each of the first bits of a payload the first signal that covers it; with a page, signals of other pages don't count."""
    owners: list[str | None] = [None] * count
    for s in message.signals if message else ():
        if page is None or s.mux_value is None or s.mux_value == page:
            for b in signal_bits(s):
                if 0 <= b < count and owners[b] is None:
                    owners[b] = s.name
    return owners


def can_share_bits(a: Signal, b: Signal) -> bool:
    """Signals of different pages of a multiplexor may use the same bits."""
    return a.mux_value is not None and b.mux_value is not None and a.mux_value != b.mux_value


def problems(database: Database) -> list[str]:
    """What is wrong with a database: names, sizes, fields outside their payload, and signals over each other's bits."""
    out: list[str] = []
    seen_ids: set[int] = set()
    seen_names: set[str] = set()
    for m in database.messages:
        if not _NAME.fullmatch(m.name):
            out.append(f"{m.name}: not a name")
        if m.name in seen_names:
            out.append(f"{m.name}: name used twice")
        if m.id in seen_ids:
            out.append(f"{m.name}: ID used twice")
        if (m.id & 0x1FFFFFFF) > (0x1FFFFFFF if m.id & schema.EXTENDED_ID else 0x7FF):
            out.append(f"{m.name}: ID out of range")
        if m.size > 8 and not m.j1939 and m.size not in schema.DLC_LENGTHS:
            out.append(f"{m.name}: no frame has {m.size} bytes")
        seen_ids.add(m.id)
        seen_names.add(m.name)
        names: set[str] = set()
        for i, s in enumerate(m.signals):
            where = f"{m.name}.{s.name}"
            if not _NAME.fullmatch(s.name):
                out.append(f"{where}: not a name")
            if s.name in names:
                out.append(f"{where}: name used twice")
            names.add(s.name)
            if not bits.fits(s.start, s.size, s.order, m.size):
                out.append(f"{where}: outside the payload")
            if s.kind == "float32" and s.size != 32 or s.kind == "float64" and s.size != 64:
                out.append(f"{where}: a float of {s.size} bits")
            if s.factor == 0:
                out.append(f"{where}: factor 0")
            for other in m.signals[:i]:
                if not can_share_bits(s, other) and set(signal_bits(s)) & set(signal_bits(other)):
                    out.append(f"{where}: over {other.name}")
        if any(s.mux_value is not None for s in m.signals) and not any(s.is_multiplexor for s in m.signals):
            out.append(f"{m.name}: pages without a multiplexor")
    return out


def _group(id_: int) -> int:
    number = id_ >> 8 & 0x3FFFF
    return number & 0x3FF00 if number >> 8 & 0xFF < 240 else number


def _decoder(scopes: list[Scope], id_: int) -> tuple[int, Message] | None:
    """The scope and message that decode an ID: an exact one in any scope, or else the first of its J1939 group that fits."""
    for n, s in enumerate(scopes):
        for m in s.database.messages:
            if m.id == id_:
                return n, m
    own = id_ >> 16 & 0xFF in (239, 255)
    for n, s in enumerate(scopes):
        fits = [m for m in s.database.messages if m.j1939 and id_ & schema.EXTENDED_ID and _group(m.id) == _group(id_) and (not own or m.id & 0xFF == id_ & 0xFF)]
        rank = lambda m: 0 if (m.id ^ id_) & 0x83FFFFFF == 0 else 1 if m.id & 0xFF == id_ & 0xFF else 2
        if fits:
            return n, min(fits, key=rank)
    return None


def overridden(scopes: list[Scope]) -> list[dict[int, int]]:
    """For each scope, in lookup order, its messages' IDs that an earlier scope of the same bus decodes instead, with that scope."""
    out: list[dict[int, int]] = []
    for n, scope in enumerate(scopes):
        earlier = [(i, s) for i, s in enumerate(scopes[:n]) if s.channel is None or scope.channel is None or s.channel == scope.channel]
        lost: dict[int, int] = {}
        for m in scope.database.messages:
            winner = _decoder([s for _, s in earlier], m.id)
            if winner and (winner[1].id == m.id or m.j1939):
                lost[m.id] = earlier[winner[0]][0]
        out.append(lost)
    return out


def to_json(scopes: list[Scope]) -> str:
    """Scopes in lookup order as a JSON array of databases, each with its channel or null."""
    return json.dumps([{"channel": s.channel, "database": asdict(s.database)} for s in scopes])


def _tuples(value: object) -> object:
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def from_json(text: str) -> list[Scope]:
    """Scopes from such an array; fields that are left out have their defaults."""
    out = []
    for item in json.loads(text):
        d = item["database"]
        messages = tuple(Message(**{k: v for k, v in m.items() if k != "signals"}, signals=tuple(Signal(**{k: _tuples(v) for k, v in s.items()}) for s in m.get("signals", []))) for m in d.get("messages", []))
        rest = {k: _tuples(v) for k, v in d.items() if k not in ("messages", "attributes")}
        attributes = tuple(Attribute(**a) for a in d.get("attributes", []))
        out.append(Scope(Database(messages, attributes=attributes, **rest), item.get("channel")))  # type: ignore[arg-type]
    return out
