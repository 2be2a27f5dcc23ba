"""DBC databases: a small reader of the text format, run on the driver, into plain definitions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from canlake.schema import EXTENDED_ID


@dataclass(frozen=True)
class Signal:
    name: str
    start: int
    size: int
    order: str = "little"
    kind: str = "unsigned"
    factor: float = 1.0
    offset: float = 0.0
    minimum: float = 0.0
    maximum: float = 0.0
    unit: str = ""
    is_multiplexor: bool = False
    mux_value: int | None = None
    mux_switch: tuple[str, tuple[tuple[int, int], ...]] | None = None
    labels: tuple[tuple[int, str], ...] = ()
    comment: str | None = None
    receivers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Attribute:
    """An attribute's value, as the file has it, of the network or of an object: its kind (BU_, BO_, SG_ or EV_) and name."""

    name: str
    value: str
    kind: str = ""
    owner: str = ""


@dataclass(frozen=True)
class Message:
    id: int
    name: str
    size: int
    transmitter: str | None = None
    signals: tuple[Signal, ...] = ()
    j1939: bool = False
    fd: bool = False
    comment: str | None = None


@dataclass(frozen=True)
class Database:
    messages: tuple[Message, ...] = ()
    nodes: tuple[str, ...] = ()
    value_tables: tuple[tuple[str, tuple[tuple[int, str], ...]], ...] = ()
    #: Definitions as (kind, name, type, default), all as the file has them; frame formats are kept in the messages.
    attribute_definitions: tuple[tuple[str, str, str, str], ...] = ()
    attributes: tuple[Attribute, ...] = ()
    #: Environment variables, as the file has them.
    environment: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scope:
    """A database for one bus, or for all of them; earlier scopes win."""

    database: Database
    channel: int | None = None


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_MESSAGE = re.compile(r"BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)")
_SIGNAL = re.compile(rf'SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(({_NUMBER}),({_NUMBER})\)\s*\[({_NUMBER})\|({_NUMBER})\]\s*"([^"]*)"\s*(.*)')
_DEFINITION = re.compile(r'BA_DEF_\s+(?:(BU_|BO_|SG_|EV_)\s+)?"(\w+)"\s+(.*?)\s*;', re.S)
_DEFAULT = re.compile(r'BA_DEF_DEF_\s+"(\w+)"\s+(.*?)\s*;', re.S)
_ATTRIBUTE = re.compile(r'BA_\s+"(\w+)"\s+(?:(BU_|BO_|EV_)\s+(\w+)\s+|(SG_)\s+(\d+\s+\w+)\s+)?(.*?)\s*;$', re.S)
_FORMAT = "VFrameFormat"
_LABEL = re.compile(r'(-?\d+)\s+"((?:[^"\\]|\\.)*)"')


def decoded(data: bytes) -> str:
    """UTF-8, or else Windows-1252."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def read(text: str | bytes) -> Database:
    """A database from DBC text. Of messages with one ID the first stays; unused signals' pseudo message goes."""
    text = decoded(text) if isinstance(text, bytes) else text
    messages: dict[int, Message] = {}
    signals: dict[tuple[int, str], Signal] = {}
    order: dict[int, list[str]] = {}
    nodes: tuple[str, ...] = ()
    tables: list = []
    here: int | None = None
    defaults: dict[str, str] = {}
    choices: dict[str, list[str]] = {}
    formats: dict[int, str] = {}
    network: dict[str, str] = {}
    definitions: dict[str, tuple[str, str]] = {}
    given: dict[str, str] = {}
    attributes: list[Attribute] = []
    environment: list[str] = []
    for line in re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: m[0].replace("\n", "\x00"), text).splitlines():
        line = line.strip().replace("\x00", "\n")
        if m := _DEFINITION.match(line):
            definitions[m[2]] = (m[1] or "", m[3])
        elif m := _DEFAULT.match(line):
            given[m[1]] = m[2]
        elif m := _ATTRIBUTE.match(line):
            attributes.append(Attribute(m[1], m[6], m[2] or m[4] or "", m[3] or m[5] or ""))
        elif line.startswith("EV_ "):
            environment.append(line)
        if m := _MESSAGE.match(line):
            number = int(m[1])
            here = None if m[2] == "VECTOR__INDEPENDENT_SIG_MSG" or number in messages else number
            if here is not None:
                messages[number] = Message(number, m[2], int(m[3]), None if m[4] == "Vector__XXX" else m[4])
                order[number] = []
        elif m := _SIGNAL.match(line):
            if here is None:
                continue
            mux = m[2] or ""
            value = re.match(r"m(\d+)", mux)
            signals[here, m[1]] = Signal(m[1], int(m[3]), int(m[4]), "little" if m[5] == "1" else "big", "signed" if m[6] == "-" else "unsigned", float(m[7]), float(m[8]), float(m[9]), float(m[10]), m[11], mux.endswith("M"), int(value[1]) if value else None, receivers=tuple(r for r in re.split(r"[\s,]+", m[12].strip()) if r and r != "Vector__XXX"))
            order[here].append(m[1])
        elif line.startswith("BU_:"):
            nodes = tuple(line[4:].split())
        elif m := re.match(r"VAL_TABLE_\s+(\w+)\s+(.*)", line, re.S):
            tables.append((m[1], tuple((int(a), b) for a, b in _LABEL.findall(m[2]))))
        elif m := re.match(r"VAL_\s+(\d+)\s+(\w+)\s+(.*)", line, re.S):
            if (k := (int(m[1]), m[2])) in signals:
                signals[k] = replace(signals[k], labels=tuple((int(a), b) for a, b in _LABEL.findall(m[3])))
        elif m := re.match(r"SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:?\s*([123])", line):
            if (k := (int(m[1]), m[2])) in signals and m[3] != "3":
                signals[k] = replace(signals[k], kind="float32" if m[3] == "1" else "float64")
        elif m := re.match(r"SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+(.*?);", line):
            if (k := (int(m[1]), m[2])) in signals:
                ranges = tuple((int(a), int(b)) for a, b in re.findall(r"(\d+)-(\d+)", m[4]))
                signals[k] = replace(signals[k], mux_switch=(m[3], ranges))
        elif m := re.match(r'CM_\s+BO_\s+(\d+)\s+"(.*)"', line, re.S):
            if int(m[1]) in messages:
                messages[int(m[1])] = replace(messages[int(m[1])], comment=m[2])
        elif m := re.match(r'CM_\s+SG_\s+(\d+)\s+(\w+)\s+"(.*)"', line, re.S):
            if (k := (int(m[1]), m[2])) in signals:
                signals[k] = replace(signals[k], comment=m[3])
        elif m := re.match(r'BA_DEF_DEF_\s+"(\w+)"\s+"?([^";]*)"?;', line):
            defaults[m[1]] = m[2]
        elif m := re.match(r'BA_DEF_\s+(?:BO_\s+)?"(\w+)"\s+ENUM\s+(.*);', line):
            choices[m[1]] = re.findall(r'"([^"]*)"', m[2])
        elif m := re.match(r'BA_\s+"VFrameFormat"\s+BO_\s+(\d+)\s+"?([^";]*)"?;', line):
            formats[int(m[1])] = m[2]
        elif m := re.match(r'BA_\s+"(\w+)"\s+"?([^";]*)"?;', line):
            network[m[1]] = m[2]
    all_j1939 = network.get("ProtocolType", "").upper() == "J1939"
    names = choices.get("VFrameFormat", [])
    out = []
    for number, message in messages.items():
        named = formats.get(number, defaults.get("VFrameFormat", ""))
        named = names[int(named)] if named.isdigit() and int(named) < len(names) else named
        extended = bool(number & EXTENDED_ID)
        out.append(replace(message, signals=tuple(signals[number, s] for s in order[number]), j1939=extended and (named == "J1939PG" or (all_j1939 and number not in formats)), fd="FD" in named))
    defined = tuple((kind, name, type_, given.get(name, "")) for name, (kind, type_) in definitions.items() if name != _FORMAT)
    return Database(tuple(out), nodes, tuple(tables), defined, tuple(a for a in attributes if a.name != _FORMAT), tuple(environment))


def write(database: Database) -> str:
    """DBC text of a database: messages, signals, multiplexing, value types, labels, comments, attributes and frame formats."""
    lines = ['VERSION ""', "", "BU_: " + " ".join(database.nodes), ""]
    lines += [f"VAL_TABLE_ {n} " + " ".join(f'{v} "{t}"' for v, t in rows) + " ;" for n, rows in database.value_tables]
    tail: list[str] = []
    formats = ["StandardCAN", "ExtendedCAN", "J1939PG", "StandardCAN_FD", "ExtendedCAN_FD"]
    for m in database.messages:
        lines.append(f"BO_ {m.id} {m.name}: {m.size} {m.transmitter or 'Vector__XXX'}")
        for s in m.signals:
            mux = (f" m{s.mux_value}" if s.mux_value is not None else " " if s.is_multiplexor else "") + ("M" if s.is_multiplexor else "")
            lines.append(f' SG_ {s.name}{mux} : {s.start}|{s.size}@{int(s.order == "little")}{"-" if s.kind == "signed" else "+"} ({s.factor!r},{s.offset!r}) [{s.minimum!r}|{s.maximum!r}] "{s.unit}" {",".join(s.receivers) or "Vector__XXX"}')
            if s.mux_switch:
                tail.append(f"SG_MUL_VAL_ {m.id} {s.name} {s.mux_switch[0]} " + ", ".join(f"{a}-{b}" for a, b in s.mux_switch[1]) + ";")
            if s.kind.startswith("float"):
                tail.append(f"SIG_VALTYPE_ {m.id} {s.name} : {1 if s.kind == 'float32' else 2};")
            if s.labels:
                tail.append(f"VAL_ {m.id} {s.name} " + " ".join(f'{v} "{t}"' for v, t in s.labels) + " ;")
            if s.comment is not None:
                tail.append(f'CM_ SG_ {m.id} {s.name} "{s.comment}";')
        if m.comment is not None:
            tail.append(f'CM_ BO_ {m.id} "{m.comment}";')
        lines.append("")
    tail += database.environment
    tail += [" ".join(x for x in ("BA_DEF_", kind, f'"{name}"', type_) if x) + ";" for kind, name, type_, _ in database.attribute_definitions]
    tail.append('BA_DEF_ BO_ "VFrameFormat" ENUM ' + ",".join(f'"{f}"' for f in formats) + ";")
    tail += [f'BA_DEF_DEF_ "{name}" {default};' for _, name, _, default in database.attribute_definitions if default]
    tail.append('BA_DEF_DEF_ "VFrameFormat" "StandardCAN";')
    tail += [" ".join(x for x in ("BA_", f'"{a.name}"', a.kind, a.owner, a.value) if x) + ";" for a in database.attributes]
    for m in database.messages:
        number = 2 if m.j1939 else (3 if m.fd else 0) + bool(m.id & EXTENDED_ID)
        if number:
            tail.append(f'BA_ "VFrameFormat" BO_ {m.id} {number};')
    return "\n".join([*lines, *tail]) + "\n"
