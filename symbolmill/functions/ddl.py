"""Reading one SQL schema statement into changes (a small helper for Spark tasks).

A statement becomes tokens (comments are dropped) and is read by the grammar of schema
statements. ``statement_changes(text)`` gives its changes in the order in which they apply:

level ``table``:  ``set`` (CREATE), ``clear`` (DROP, or the source of a rename) and
``move`` (the target of a rename, ``other`` being the source);
level ``column``: ``set``, ``clear``, ``move`` likewise (``field`` of a clear is ``drop`` for
DROP COLUMN only), and ``touch`` (a new ``type``, ``default`` or ``nullable``, named by
``field``, for a column if it exists);
level ``key``: ``set`` and ``clear`` of a foreign key, ``column_name`` being its identity: its
constraint name, else its columns and target; ``other`` is the target table.

A rename of the table inside an ALTER is put after the statement's other operations:
it changes no column, and so they all keep the name the statement begins with.
Statements of any other kind (data, indexes, views) give nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?:\s+|--[^\r\n]*|/\*.*?(?:\*/|\Z))*+(?:(?P<word>[\w$]+)|(?P<sign>::|[^\w\s`\"'\[])|(?P<text>'(?:[^'\\]|''|\\.)*')|(?P<quoted>`[^`]+`|\"[^\"]+\"|\[[^\]]+\])|(?P<other>\S)|(?P<end>\Z))", re.S
)
_SCHEMA = re.compile(r"(?:\s|--[^\r\n]*|/\*.*?\*/)*(?:create|alter|drop|rename)\b", re.I | re.S)
_OUTER = re.compile(r"^[`\"\[\]]+|[`\"\[\]]+$")


def normalise(name: str) -> str:
    parts = (_OUTER.sub("", p.strip()).strip().lower() for p in _OUTER.sub("", name.strip()).split("."))
    return ".".join(p for p in parts if p)


class Change(NamedTuple):
    level: str
    op: str
    table_name: str
    column_name: str | None = None
    other: str | None = None
    data_type: str | None = None
    is_nullable: bool | None = None
    default_value: str | None = None
    field: str | None = None
    source_columns: list[str] | None = None
    target_columns: list[str] | None = None
    line: int = 0


class Tokens:
    """A cursor over the tokens of a statement; ``low`` is a word in lower case, or a sign, else empty."""

    def __init__(self, text: str):
        self.source = text
        self.parts = [(m[m.lastgroup], m.lastgroup, m.start(m.lastgroup), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "end"]
        while self.parts and self.parts[-1][0] == ";":
            self.parts.pop()
        self.lows = [t.lower() if kind == "word" else t if kind in ("sign", "other") else "" for t, kind, _, _ in self.parts]
        self.at, self.end = 0, len(self.parts)

    def low(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.lows[i] if i < self.end else ""

    def take(self, *words: str) -> bool:
        """Goes past ``words`` if they come next."""
        if all(self.low(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def take_any(self, *words: str) -> str:
        if self.at < self.end and self.low() in words:
            self.at += 1
            return self.lows[self.at - 1]
        return ""

    @property
    def done(self) -> bool:
        return self.at >= self.end

    def name(self) -> str | None:
        """A normalised name with its dots, null if none comes next."""
        start, parts = self.at, []
        while self.at < self.end and self.parts[self.at][1] in ("word", "quoted"):
            parts.append(self.parts[self.at][0])
            self.at += 1
            if self.low() != ".":
                break
            self.at += 1
        self.at = self.at if parts else start
        return normalise(".".join(parts)) if parts else None

    def closing(self) -> int:
        """Index of the partner of the parenthesis that comes next."""
        depth = 0
        for i in range(self.at, self.end):
            depth += {"(": 1, ")": -1}.get(self.lows[i], 0)
            if not depth:
                return i
        return self.end

    def inside(self) -> list[Tokens]:
        """The parts between commas of the parenthesis that comes next; goes past it."""
        stop = self.closing()
        parts = self.between(self.at + 1, stop)
        self.at = min(self.end, stop + 1)
        return parts

    def between(self, start: int, stop: int) -> list[Tokens]:
        out, depth, first = [], 0, start
        for i in range(start, stop + 1):
            low = self.lows[i] if i < stop else ","
            depth += {"(": 1, ")": -1}.get(low, 0) if i < stop else -depth
            if low == "," and depth == 0:
                if i > first:
                    out.append(self.part(first, i))
                first = i + 1
        return out

    def part(self, start: int, stop: int) -> Tokens:
        t = object.__new__(Tokens)
        t.source, t.parts, t.lows, t.at, t.end = self.source, self.parts, self.lows, start, stop
        return t

    def text(self, start: int, stop: int) -> str:
        """What is written from one token to before another."""
        return self.source[self.parts[start][2] : self.parts[stop - 1][3]] if stop > start else ""

    def line(self) -> int:
        """Line of the next token in the statement, from 0."""
        return len(re.findall(r"\r\n|\r|\n", self.source[: self.parts[self.at][2]])) if self.at < self.end else 0


# --- columns and keys

#: Words that go on with the name of a type, and those that come with a time.
_TYPE_WORDS = frozenset(("precision", "varying", "unsigned", "signed", "zerofill", "large", "object"))
_INTERVAL = frozenset(("year", "month", "day", "hour", "minute", "second", "to"))


def _type(t: Tokens) -> str | None:
    """The type that comes next, in lower case without white space: its name, arguments, array signs."""
    parts: list[str] = []
    while not t.done:
        low, kind = t.low(), t.parts[t.at][1]
        if low == "(" and parts:
            stop = min(t.end, t.closing() + 1)
            parts.append(t.text(t.at, stop))
            t.at = stop
        elif parts and (low in ("[", "]") or (kind == "quoted" and re.fullmatch(r"\[\s*\d*\s*\]", t.parts[t.at][0]))):
            parts.append(t.parts[t.at][0])
            t.at += 1
        elif parts and low in ("with", "without") and "time" in (t.low(1), t.low(2)):
            stop = t.at + (3 if t.low(1) == "time" else 4)
            parts += t.lows[t.at : min(stop, t.end)]
            t.at = min(stop, t.end)
        elif not parts or low in _TYPE_WORDS or (parts[0] == "interval" and low in _INTERVAL) or low == "." or parts[-1] == ".":
            if not parts and kind not in ("word", "quoted"):
                return None
            parts.append(low or t.parts[t.at][0])
            t.at += 1
        else:
            break
    return re.sub(r"\s+", "", "".join(parts)).lower() or None


def _operand(t: Tokens) -> str:
    """The expression of a DEFAULT: a signed literal, a name with or without arguments, or what parentheses hold, with its casts."""
    start = t.at
    while t.take_any("+", "-"):
        pass
    if t.low() == "(":
        t.at = min(t.end, t.closing() + 1)
    else:
        t.at = min(t.end, t.at + 1)
        while t.low() == "." and not t.done:
            t.at = min(t.end, t.at + 2)
        if t.low() == "(":
            t.at = min(t.end, t.closing() + 1)
    while t.take("::"):
        _type(t)
    return t.text(start, t.at)


def _key(t: Tokens, table: str, constraint: str | None, columns: list[str]) -> Change | None:
    """A foreign key, behind the word REFERENCES."""
    line, target = t.line(), t.name()
    if not target:
        return None
    targets = [n for p in t.inside() if (n := p.name())] if t.low() == "(" else []
    identity = f"constraint:{constraint}" if constraint else "->".join((",".join(columns), target, ",".join(targets)))
    return Change("key", "set", table, identity, target, field=constraint, source_columns=columns, target_columns=targets, line=line)


def _column(t: Tokens, table: str) -> list[Change]:
    """A column definition: its ``set`` and the keys declared with it."""
    line, name = t.line(), t.name()
    if not name:
        return []
    kind = _type(t)
    nullable, default, keys, constraint = True, None, [], None
    while not t.done:
        if t.take("not", "null"):
            nullable = False
        elif t.take("default"):
            default = _operand(t)
        elif t.take("constraint"):
            constraint = t.name()
        elif t.take("references"):
            key = _key(t, table, constraint, [name])
            keys += [key] if key else []
            constraint = None
        elif t.low() == "(":
            t.at = min(t.end, t.closing() + 1)
        else:
            t.at += 1
    return [Change("column", "set", table, name, None, kind, nullable, default, line=line), *keys]


def _element(t: Tokens, table: str) -> list[Change]:
    """What one part of CREATE TABLE (...) or of ADD declares."""
    constraint = None
    if t.take("constraint"):
        constraint = t.name() if not (t.low() in ("foreign", "primary", "unique", "check")) else None
    if t.take("foreign", "key"):
        if t.low() != "(":
            t.name()
        columns = [n for p in t.inside() if (n := p.name())] if t.low() == "(" else []
        key = _key(t, table, constraint, columns) if t.take("references") else None
        return [key] if key else []
    other = t.low() in ("unique", "check", "exclude", "like") or (t.low(), t.low(1)) == ("primary", "key")
    index = t.low() in ("index", "key", "fulltext", "spatial") and not t.done
    return [] if constraint is not None or other or index else _column(t, table)


def _moved(level: str, old: str | None, new: str | None, table: str = "") -> list[Change]:
    if old is None or new is None or old == new:
        return []
    if level == "table":
        return [Change("table", "move", new, None, old), Change("table", "clear", old)]
    return [Change("column", "move", table, new, old), Change("column", "clear", table, old)]


def _last_name(t: Tokens) -> str | None:
    """A name, if it ends the part."""
    name = t.name()
    return name if t.done else None


def _alter(t: Tokens, table: str) -> list[Change]:
    """The changes of one operation of ALTER TABLE, but for a rename of the table."""
    line = t.line()
    if t.take("add"):
        if t.take("column"):
            t.take("if", "not", "exists")
            return _column(t, table)
        t.take("if", "not", "exists")
        return _element(t, table)
    if t.take("modify"):
        t.take("column")
        t.take("if", "exists")
        return _column(t, table)
    if t.take("change"):
        t.take("column")
        old, made = t.name(), _column(t, table)
        gone = [Change("column", "clear", table, old)] if old and (not made or made[0].column_name != old) else []
        return gone + made
    if t.take("drop"):
        if t.take("foreign", "key") or t.take("constraint"):
            t.take("if", "exists")
            name = _last_name(t)
            return [Change("key", "clear", table, f"constraint:{name}", line=line)] if name else []
        if t.low() in ("primary", "index", "key", "check") and t.at + 1 < t.end:
            return []
        t.take("column")
        t.take("if", "exists")
        name = _last_name(t)
        return [Change("column", "clear", table, name, field="drop", line=line)] if name else []
    if t.take("alter"):
        t.take("column")
        name = t.name()
        if not name:
            return []
        touch = Change("column", "touch", table, name, line=line)
        if t.take("set", "default"):
            return [touch._replace(field="default", default_value=t.text(t.at, t.end).strip())] if not t.done else []
        if t.take("drop", "default"):
            return [touch._replace(field="default")]
        if t.take("set", "not", "null") or t.take("drop", "not", "null"):
            return [touch._replace(field="nullable", is_nullable=t.lows[t.at - 3] == "drop")]
        if t.take("set", "data", "type") or t.take("type"):
            return [touch._replace(field="type", data_type=_type(t))]
        return []
    if t.take("rename", "column"):
        old = t.name()
        return _moved("column", old, _last_name(t) if t.take("to") else None, table)
    return []


def statement_changes(text: str | None) -> list[Change]:
    """Changes of one statement; nothing for null, blank or other statements."""
    if not text or not _SCHEMA.match(text):
        return []
    t = Tokens(text)
    if t.take("create"):
        t.take_any("global", "local")
        t.take_any("temp", "temporary", "unlogged")
        if not t.take("table"):
            return []
        t.take("if", "not", "exists")
        line, table = t.line(), t.name()
        if not table or t.low() != "(":
            return []
        return [Change("table", "set", table, line=line), *(c for p in t.inside() for c in _element(p, table))]
    if t.take("drop", "table"):
        t.take("if", "exists")
        table = t.name()
        return [Change("table", "clear", table)] if table else []
    if t.take("rename", "table"):
        old = t.name()
        return _moved("table", old, _last_name(t) if t.take("to") else None)
    if not t.take("alter", "table"):
        return []
    t.take("if", "exists")
    t.take("only")
    current = table = t.name()
    if not table:
        return []
    out: list[Change] = []
    renames: list[Change] = []
    for op in t.between(t.at, t.end):
        if op.take("rename", "to"):
            new = _last_name(op)
            renames += _moved("table", current, new)
            current = new or current
        else:
            out += _alter(op, table)
    return out + renames


Event = tuple[str, str, str, str | None, str | None, str | None]


def schema_events(text: str | None) -> list[Event]:
    """(level, op, table, column, other, data_type) of the changes to tables, columns and types."""
    return [tuple(c[:6]) for c in statement_changes(text) if c.level != "key" and (c.op != "touch" or c.field == "type")]


def split_top(text: str) -> list[str]:
    """Parts between commas outside parentheses and quotes."""
    t = Tokens(text)
    return [p.text(p.at, p.end) for p in t.between(0, t.end)]
