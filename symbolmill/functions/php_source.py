"""Declarations and references of one PHP source text (a helper for Spark tasks, E1-E9).

Comments and strings are blanked in place, so offsets and lines stay; nested bodies are
blanked for what belongs to an outer level only. Names follow the index: ``Ns\\Name``,
``Class::method``, ``Class::CONSTANT``, ``Class::$property``. Braced namespaces are not
entered, group imports keep their last segment as alias; of several properties or constants
in one statement the first is read. Exceptions count where they stand in code, not in a
comment or literal. Metadata that does not apply or is empty is missing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_BLANK = re.compile(
    r"//[^\r\n]*|\#(?!\[)[^\r\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    r"|<<<[ \t]*([\"']?)([^\W\d]\w*)\1[ \t]*(?:\r\n|\r|\n)(?:.*?[\r\n])??[ \t]*\2\b",
    re.S,
)
_MODS = r"(?P<mods>(?:(?:public|protected|private|static|abstract|final|readonly|var)\s+)*)"
_TYPE = r"[?\w\\|&() ]+?"
_CLASS = re.compile(r"\b(?<![$>:\\])(?P<mods>(?:(?:abstract|final|readonly)\s+)*)(?P<kind>class|interface|trait|enum)\s+(?P<name>[^\W\d]\w*)(?P<head>[^{};]*)\{", re.I)
_FUNCTION = re.compile(rf"\b(?<![$>:\\]){_MODS}function\s+&?\s*(?P<name>[^\W\d]\w*)\s*\(", re.I)
_PROPERTY = re.compile(rf"\b(?<![$>:\\(,])(?P<mods>(?:(?:public|protected|private|static|readonly|var)\s+)+)(?P<type>{_TYPE})?\s*\$(?P<name>\w+)", re.I)
_CONSTANT = re.compile(rf"\b(?<![$>:\\]){_MODS}const\s+(?:{_TYPE}\s+)?(?P<name>[^\W\d]\w*)\s*=", re.I)
_PROMOTED = re.compile(rf"(?P<mods>(?:(?:public|protected|private|readonly)\s+)+)(?P<type>{_TYPE})?\s*(?:\.\.\.)?&?\$(?P<name>\w+)", re.I)
_NAMESPACE = re.compile(r"\b(?<![$>:\\])namespace\s+([\w\\]+)\s*;", re.I)
_USE = re.compile(r"\b(?<![$>:\\])use\s+(?!function\b|const\b)([\w\\][\w\\\s,]*(?:\{[^}]*\})?)\s*;", re.I)
_TRAITS = re.compile(r"\b(?<![$>:\\)])use\s+([\w\\\s,]+)[;{]", re.I)
_BUILTIN = frozenset("array bool callable false float int iterable mixed never null object parent self static string true void resource".split())
_NEW = re.compile(r"\bnew\s+(\\?[^\W\d][\w\\]*)")
_STATIC = re.compile(r"(?<![\w$>])(\\?[^\W\d][\w\\]*)::(\$?\w+)\s*(\()?")
_SELF_CALL = re.compile(r"\$this->(\w+)\s*\(")
_THROW = re.compile(r"\bthrow\s+new\s+(\\?[^\W\d][\w\\]*)", re.I)
_CATCH = re.compile(r"\bcatch\s*\(([^)$]+)(?:\$\w+\s*)?\)", re.I)
_THROWS = re.compile(r"@throws\s+([^\s*]+)")
_CONTEXT = re.compile(r"\$this->(args|params)\[['\"]([^'\"]+)['\"]\]")
_ATTRIBUTES = re.compile(r"\s*(?:#\[.*\]\s*)?", re.S)
_NAMES = re.compile(r"\\?[^\W\d][\w\\]*")


class Symbol(NamedTuple):
    kind: str
    name: str
    qualified_name: str
    parent: str | None
    visibility: str | None
    line_start: int
    line_end: int
    signature: str | None = None
    return_type: str | None = None
    docblock: str | None = None
    metadata: dict[str, str | bool | list[str]] = {}


class Reference(NamedTuple):
    source: str
    target: str
    kind: str
    line: int


def _spaces(text: str) -> str:
    """Blanks in place of all but line ends."""
    if "\r" in text:
        return re.sub(r"[^\r\n]", " ", text)
    return "\n".join([" " * len(part) for part in text.split("\n")])


def blanked(text: str, docs: list[tuple[int, int]] | None = None) -> str:
    """The text with comments and literals turned into blanks of equal length; ``docs`` gets the places of ``/**``."""

    def blank(m: re.Match[str]) -> str:
        if docs is not None and m[0].startswith("/**"):
            docs.append(m.span())
        return _spaces(m[0])

    return _BLANK.sub(blank, text)


def _partner(code: str, start: int) -> int:
    """Position of the delimiter that closes the one before ``start``."""
    depth = 1
    for m in re.compile(r"[(){}\[\]]").finditer(code, start):
        depth += 1 if m[0] in "({[" else -1
        if not depth:
            return m.start()
    return len(code)


def outer_level(code: str) -> str:
    """The code with everything inside braces blanked."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"[{}]", code):
        part = code[at : m.start()]
        out.append(part if depth == 0 else _spaces(part))
        out.append(m[0])
        depth = depth + 1 if m[0] == "{" else max(0, depth - 1)
        at = m.end()
    out.append(code[at:] if depth == 0 else _spaces(code[at:]))
    return "".join(out)


class Source:
    """Symbols and references of one file."""

    def __init__(self, text: str):
        self.docs: list[tuple[int, int]] = []
        self.text, self.code = text, blanked(text, self.docs)
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
        self.symbols: list[Symbol] = []
        self.references: list[Reference] = []
        top = outer_level(self.code)
        ns = _NAMESPACE.search(top)
        self.namespace = ns[1] if ns else ""
        self.imports: dict[str, str] = {}
        for m in _USE.finditer(self.code):
            if top[m.start()].isspace():
                continue  # inside a body: a trait
            base, brace, inner = m[1].partition("{")
            for part in (inner.rstrip("} \t\r\n") if brace else base).split(","):
                words = part.split()
                if not words or words[0].lower() in ("function", "const"):
                    continue
                name = (base.strip() if brace else "") + words[0]
                # a group import keeps its last segment as alias
                alias = words[2] if len(words) == 3 and not brace else name.rsplit("\\", 1)[-1]
                self.imports[alias.lower()] = name.lstrip("\\")
        bodies = []
        for m in _CLASS.finditer(top):
            if re.search(r"\bnew\s*$", top[: m.start()]):
                continue
            end = _partner(self.code, m.end())
            bodies.append((m.start(), end))
            self._class(m, end)
        for m in _FUNCTION.finditer(top):
            if not any(a <= m.start() <= b for a, b in bodies):
                self._function(m, None, 0)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def qualify(self, name: str) -> str:
        return f"{self.namespace}\\{name}" if self.namespace else name

    def resolve(self, name: str) -> str:
        """Lower-case name a written class name stands for."""
        return self.full_name(name).lower()

    def full_name(self, name: str) -> str:
        """Name a written class name stands for."""
        if name.startswith("\\"):
            return name[1:]
        first, _, rest = name.partition("\\")
        if first.lower() in self.imports:
            return self.imports[first.lower()] + ("\\" + rest if rest else "")
        return self.qualify(name)

    def docblock(self, at: int) -> str | None:
        """The comment ``/**`` right before a declaration and its attributes."""
        k = bisect_right(self.docs, at, key=lambda d: d[1]) - 1
        if k < 0 or not _ATTRIBUTES.fullmatch(self.text, self.docs[k][1], at):
            return None
        return self.text[slice(*self.docs[k])]

    def exceptions(self, body: str, docblock: str | None) -> dict[str, list[str]]:
        """Resolved exceptions that a body throws and catches and its docblock names, distinct and sorted."""
        named = {
            "thrownExceptions": _THROW.findall(body),
            "caughtExceptions": [n for c in _CATCH.findall(body) for n in c.split("|")],
            "documentedThrows": [n for d in _THROWS.findall(docblock or "") for n in d.split("|")],
        }
        return {k: sorted({self.full_name(n) for n in (x.strip().lstrip("?") for x in names) if n}) for k, names in named.items()}

    def context(self, start: int, end: int) -> dict[str, list[str]]:
        """E5: keys of ``$this->args`` and ``$this->params`` that a body reads, in order."""
        found: dict[str, dict[str, None]] = {"contextArgs": {}, "contextParams": {}}
        for m in _CONTEXT.finditer(self.text, start, end):
            if self.code.startswith("$this", m.start()):
                found["contextArgs" if m[1] == "args" else "contextParams"][m[2]] = None
        return {k: list(v) for k, v in found.items()}

    def refer(self, source: str, name: str, kind: str, at: int, member: str = "") -> None:
        if name.lower().lstrip("\\") not in _BUILTIN:
            self.references.append(Reference(source, self.resolve(name) + member.lower(), kind, self.line(at)))

    def hint(self, source: str, kind: str | None, at: int) -> None:
        for n in _NAMES.findall(kind or ""):
            self.refer(source, n, "type_hint", at)

    def _class(self, m: re.Match[str], end: int) -> None:
        own, kind = self.qualify(m["name"]), m["kind"].lower()
        meta: dict[str, str | bool | list[str]] = {}
        at, head = len(self.symbols), m["head"]
        if e := re.search(r"\bextends\s+(.+?)(?:\bimplements\b|$)", head, re.I | re.S):
            for n in _NAMES.findall(e[1])[:1]:
                meta["extends"] = self.full_name(n)
                self.refer(own, n, "inheritance", m.start())
        if i := re.search(r"\bimplements\s+(.+)$", head, re.I | re.S):
            meta["implements"] = [self.full_name(n) for n in _NAMES.findall(i[1])]
            for n in _NAMES.findall(i[1]):
                self.refer(own, n, "implementation", m.start())
        body, base = outer_level(self.code[m.end() : end]), m.end()
        for t in _TRAITS.finditer(body):
            for n in _NAMES.findall(t[1]):
                meta["traits"] = [*meta.get("traits", []), self.full_name(n)]
                self.refer(own, n, "trait_use", base + t.start())
        self.symbols.insert(at, Symbol(kind, m["name"], own, None, None, self.line(m.start()), self.line(end), docblock=self.docblock(m.start()), metadata=_present(meta)))
        taken = []
        for f in _FUNCTION.finditer(body):
            taken.append((f.start(), self._function(f, own, base) - base))
        free = lambda at: not any(a <= at <= b for a, b in taken)
        for p in _PROPERTY.finditer(body):
            if free(p.start()):
                self._member("property", p, own, f"${p['name']}", base)
                self.hint(own, p["type"], base + p.start())
        for c in _CONSTANT.finditer(body):
            if free(c.start()):
                self._member("constant", c, own, c["name"], base)

    def _member(self, kind: str, m: re.Match[str], own: str, tail: str, base: int) -> None:
        at = self.line(base + m.start())
        kept = ("static", "readonly") if kind == "property" else ()
        written = m["type"] if kind == "property" else None
        self.symbols.append(
            Symbol(kind, m["name"], f"{own}::{tail}", own, _visibility(m["mods"]), at, at, None, (written or "").strip() or None, self.docblock(base + m.start()), _modifiers(m["mods"], *kept))
        )

    def _function(self, m: re.Match[str], own: str | None, base: int) -> int:
        close = _partner(self.code, base + m.end())
        stop = re.compile(r"[{;]").search(self.code, close)
        opens = bool(stop) and stop[0] == "{"
        end = _partner(self.code, stop.end()) if opens else (stop.start() if stop else len(self.code))
        name = f"{own}::{m['name']}" if own else self.qualify(m["name"])
        visibility = _visibility(m["mods"]) if own else None
        returned = re.match(r"\s*:\s*(.*\S)", self.code[close + 1 : stop.start() if stop else len(self.code)], re.S)
        signature = f"{m['name']}({self.text[base + m.end() : close]})" + (f": {returned[1]}" if returned else "")
        docblock, inside = self.docblock(base + m.start()), (stop.end(), end) if opens else (end, end)
        meta = self.exceptions(self.code[slice(*inside)], docblock)
        if own:
            meta |= _modifiers(m["mods"], "static", "abstract") | self.context(*inside) | {"magic": m["name"].startswith("__")}
        lines = self.line(base + m.start()), self.line(end)
        self.symbols.append(Symbol("method" if own else "function", m["name"], name, own, visibility, *lines, signature, returned[1] if returned else None, docblock, _present(meta)))
        params = self.code[base + m.end() : close]
        if own and m["name"].lower() == "__construct":
            for p in _PROMOTED.finditer(params):
                at = self.line(base + m.end() + p.start())
                meta = {"promoted": True} | _modifiers(p["mods"], "readonly")
                self.symbols.append(Symbol("property", p["name"], f"{own}::${p['name']}", own, _visibility(p["mods"]), at, at, None, (p["type"] or "").strip() or None, None, meta))
        for p in re.finditer(rf"(?:(?:public|protected|private|readonly)\s+)*(?P<type>{_TYPE})?\s*&?(?:\.\.\.)?\$\w+", params, re.I):
            self.hint(name, re.sub(r"\b(?:public|protected|private|readonly)\b", "", p["type"] or "", flags=re.I), base + m.end() + p.start())
        if stop:
            self.hint(name, self.code[close + 1 : stop.start()], close)
        if opens:
            self._body(name, own, stop.end(), end)
        return end

    def _body(self, source: str, own: str | None, start: int, end: int) -> None:
        code = self.code[start:end]
        for m in _NEW.finditer(code):
            self.refer(source, m[1], "instantiation", start + m.start())
        for m in _STATIC.finditer(code):
            if m[2] == "class":
                self.refer(source, m[1], "class_reference", start + m.start())
            else:
                self.refer(source, m[1], "static_call" if m[3] else "static_access", start + m.start(), f"::{m[2]}")
        if own:
            for m in _SELF_CALL.finditer(code):
                self.references.append(Reference(source, f"{own}::{m[1]}".lower(), "self_call", self.line(start + m.start())))


def _visibility(mods: str) -> str:
    found = re.search(r"public|protected|private", mods, re.I)
    return found[0].lower() if found else "public"


def _modifiers(mods: str, *kept: str) -> dict[str, bool]:
    """The modifiers among ``kept``."""
    return {k: True for k in kept if k in mods.lower().split()}


def _present(meta: dict[str, str | bool | list[str]]) -> dict[str, str | bool | list[str]]:
    return {k: v for k, v in meta.items() if v}
