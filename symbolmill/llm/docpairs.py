"""Functions paired with their documentation (problem 4).

An island grammar per language reads a file: islands are documentation comments,
annotations (attributes, decorators), signatures and the balanced bodies behind them;
strings and other comments are known just well enough not to be mistaken for islands,
and all other code is water that is skipped. A function keeps the documentation that
stands before it with nothing but annotations and blanks between (for Python, the
string that opens its body).

Only prose counts as a description: tag lines (``@...``), code samples, inline tags and
rules of signs are taken out, and a description must hold ``LEAST_WORDS`` words besides
the words of the function's own name and must not merely say that there is none yet.

Files are parsed where they are read; what leaves a task is only the functions that
are documented, and those meet the symbols of the index in one equi-join by file and
line, a key no hot file can crowd.

Edge cases: null or empty contents, null lines, and lines beyond the file have no
documentation; a null name has no words of its own; symbols without a file give no
pair; removed symbols count like others; repeated rows give one pair; any line ends;
very long files are read whole; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of prose a description has at least.
LEAST_WORDS = 6

_LINE = re.compile(r"\r\n|\r|\n")


@dataclass(slots=True)
class Island:
    """A documented or undocumented function of a file."""

    name: str
    line: int
    signature: str
    doc: str | None
    start: int
    end: int


_STRINGS = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
_C_COMMENT = r"//[^\r\n]*+|/\*(?!\*(?!/)).*?(?:\*/|\Z)"
_DOC = r"(?P<doc>/\*\*(?!/).*?(?:\*/|\Z))"
#: A regular expression where no operand stands before the slash.
_TS_REGEX = r"(?=[ \t/])(?:(?<=[(,=:\[!&|?{};\n])|(?<=\breturn)|(?<==>))[ \t]*/(?![*/\s])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/"
_GRAMMARS = {
    "php": re.compile(
        rf"{_DOC}|(?P<note>\#\[)|(?P<water>{_C_COMMENT}|\#[^\r\n]*+|{_STRINGS}"
        r"|<<<[ \t]*([\"']?)([^\W\d]\w*)\4[ \t]*(?:\r\n|\r|\n)(?:.*?[\r\n])??[ \t]*\5\b)"
        r"|(?P<head>(?<![\w$>:\\])(?:(?:public|protected|private|static|abstract|final|readonly)\s+)*function\s+&?\s*(?P<name>[^\W\d]\w*)\s*\()",
        re.S | re.I,
    ),
    "typescript": re.compile(
        rf"{_DOC}|(?P<note>(?<![\w$])@(?=[A-Za-z_$]))|(?P<water>{_C_COMMENT}|{_TS_REGEX}|'(?:[^'\\\r\n]|\\.)*+'|\"(?:[^\"\\\r\n]|\\.)*+\"|`(?:[^`\\]|\\.)*+`)"
        r"|(?P<head>(?<![\w$.])(?:(?:export|default|declare|async)\s+)*function\b\s*\*?\s*(?P<name>[\w$]+)(?=\s*[<(])"
        r"|(?<![\w$.])(?:(?:export|declare)\s+)*(?:const|let|var)\s+(?P<name3>[\w$]+)(?=\s*[:=])"
        r"|(?:(?<=[;{},\n/)])|\A)[ \t]*(?:(?:public|protected|private|static|abstract|override|readonly|async|get|set|declare|accessor)\s+)*\*?\s*"
        r"(?!(?:if|for|while|switch|catch|return|function|new|await|typeof|super|throw|do|else|case|delete|void|yield|in|of|instanceof|import|export|const|let|var|class|interface|type|enum|namespace|default)\b)"
        r"(?P<name2>\#?[\w$]+)[ \t]*[?!]?(?=\s*[<(:=]))",
        re.S,
    ),
    "python": re.compile(
        r"(?P<doc>(?!))|(?P<note>(?<=\n)[ \t]*@(?=\w))|(?P<water>\#[^\r\n]*+|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|'(?:[^'\\\r\n]|\\.)*+'|\"(?:[^\"\\\r\n]|\\.)*+\")"
        r"|(?P<head>(?:(?<=\n)|(?<=\r)|\A)[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)\s*\()",
        re.S,
    ),
    "sql": re.compile(
        rf"{_DOC}|(?P<note>(?!))|(?P<water>--[^\r\n]*+|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*+')"
        r"|(?P<head>\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\"`\[\]]+)\s*\()",
        re.S | re.I,
    ),
}
_SKIP = re.compile(rf"<<<[ \t]*(?P<q>[\"']?)(?P<id>[^\W\d]\w*)(?P=q)[ \t]*(?:\r\n|\r|\n)(?:.*?[\r\n])??[ \t]*(?P=id)\b|/\*.*?\*/|//[^\r\n]*|\#(?!\[)[^\r\n]*|{_STRINGS}|`(?:[^`\\]|\\.)*`|[()\[\]{{}};]", re.S)
_TS_SKIP = re.compile(rf"/\*.*?\*/|//[^\r\n]*|{_TS_REGEX}|{_STRINGS}|`(?:[^`\\]|\\.)*`|[()\[\]{{}};]", re.S)
_TS_BLANK = re.compile(r"(?:\s|//[^\r\n]*|/\*.*?\*/)*", re.S)
_TS_TYPE = re.compile(rf"(?P<line>[\r\n]\s*)|[ \t]+|//[^\r\n]*|/\*.*?\*/|(?P<text>{_STRINGS}|`[^`]*`|-?\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<arrow>=>)|(?P<sign>.)", re.S)
_TS_PREFIXES = frozenset(("keyof", "typeof", "readonly", "infer", "extends", "is", "asserts", "unique", "new", "in", "abstract"))
_PY_SKIP = re.compile(r"\#[^\r\n]*|\"\"\".*?\"\"\"|'''.*?'''|'(?:[^'\\\r\n]|\\.)*'|\"(?:[^\"\\\r\n]|\\.)*\"|[()\[\]{}:]", re.S)
_PY_DOC = re.compile(r"\s*(?:\#[^\r\n]*\s*)*[rRuU]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\r\n]|\\.)*)\"|'((?:[^'\\\r\n]|\\.)*)')", re.S)


def _closing(text: str, start: int, pattern: re.Pattern[str] = _SKIP) -> int:
    """Position behind the partner of the delimiter before ``start``."""
    depth = 1
    for m in pattern.finditer(text, start):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}" and len(t) == 1:
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def _body(text: str, at: int) -> tuple[int, int]:
    """(end of the signature, end of the body) behind the parameters; a declaration ends at its semicolon."""
    for m in _SKIP.finditer(text, at):
        if m[0] == "{":
            return m.start(), _closing(text, m.end())
        if m[0] in (";", "}"):
            return m.start(), m.start()
    return len(text), len(text)


def _angle(text: str, at: int) -> int:
    """Position behind the partner of the ``<`` at ``at``; -1 if there is none."""
    depth = 0
    for m in re.compile(rf"=>|[<>;]|[({{\[]|{_STRINGS}").finditer(text, at):
        if m.start() < at:
            continue
        if m[0] in "({[":
            at = _closing(text, m.end(), _TS_SKIP)
        elif m[0] in "<>":
            depth += 1 if m[0] == "<" else -1
            if not depth:
                return m.end()
        elif m[0] == ";":
            return -1
    return -1


def _type_end(text: str, at: int) -> int:
    """Position behind the type that begins at ``at``."""
    operand, grouped = False, False
    while m := _TS_TYPE.match(text, at):
        if m["line"]:
            if operand and text[m.end() : m.end() + 1] not in ("|", "&", "?", ":", "=") and not text.startswith("extends", m.end()):
                return at
        elif m["text"]:
            if operand:
                return at
            operand, grouped = True, False
        elif m["word"]:
            prefix = m["word"] in _TS_PREFIXES
            if operand and not prefix:
                return at
            operand, grouped = not prefix, False
        elif m["arrow"]:
            if not grouped:
                return at
            operand, grouped = False, False
        elif sign := m["sign"]:
            if sign in "([{":
                if operand and sign != "[":
                    return at
                at, operand, grouped = _closing(text, m.end(), _TS_SKIP), True, sign == "("
                continue
            if sign == "<":
                end = _angle(text, at)
                if end < 0:
                    return at
                at = end
                continue
            if sign not in "|&?:.":
                return at
            operand = False
        at = m.end()
    return at


def _value_end(text: str, at: int) -> int:
    """Position behind an expression: up to a line end, comma or semicolon outside delimiters."""
    for m in re.compile(rf"{_TS_SKIP.pattern}|,|[\r\n](?!\s*[.?:&|+*])", re.S).finditer(text, at):
        if m.start() < at:
            continue
        if m[0] in ("(", "[", "{"):
            at = _closing(text, m.end(), _TS_SKIP)
        elif m[0] in (")", "]", "}", ";", ",", "\r", "\n"):
            return m.start()
    return len(text)


def _typescript_tail(text: str, at: int, declared: bool) -> tuple[int, int] | None:
    """(end of the signature, end of the body) behind the parameters; only a ``declared`` function may lack both type and body."""
    at = _TS_BLANK.match(text, at).end()
    if text.startswith(":", at):
        typed = _type_end(text, at + 1)
        at = _TS_BLANK.match(text, typed).end()
        if text.startswith("{", at):
            return at, _closing(text, at + 1, _TS_SKIP)
        return (typed, typed) if text[typed : typed + 1] in ("", ";", ",", "}", "\r", "\n") else None
    if text.startswith("{", at):
        return at, _closing(text, at + 1, _TS_SKIP)
    return (at, at) if declared and text[at : at + 1] in ("", ";") else None


def _typescript_value(text: str, at: int) -> tuple[int, int] | None:
    """The same for a value, if it is an arrow function or a function."""
    at = _TS_BLANK.match(text, at).end()
    lead = re.compile(r"(?:async\b\s*)?(function\b\s*\*?\s*[\w$]*\s*)?").match(text, at)
    at = lead.end()
    short = re.compile(r"[A-Za-z_$][\w$]*\s*=>").match(text, at)
    if short and not lead[1]:
        at = short.end()
    else:
        if text.startswith("<", at):
            at = _TS_BLANK.match(text, max(at, _angle(text, at))).end()
        if not text.startswith("(", at):
            return None
        at = _closing(text, at + 1, _TS_SKIP)
        if lead[1]:
            return _typescript_tail(text, at, False)
        at = _TS_BLANK.match(text, at).end()
        if text.startswith(":", at):
            at = _TS_BLANK.match(text, _type_end(text, at + 1)).end()
        if not text.startswith("=>", at):
            return None
        at += 2
    head, body = at, _TS_BLANK.match(text, at).end()
    return head, _closing(text, body + 1, _TS_SKIP) if text.startswith("{", body) else _value_end(text, body)


def _typescript_function(text: str, m: re.Match[str]) -> tuple[int, int] | None:
    """(end of the signature, end of the body) of what a name begins; null if that is no function."""
    at = _TS_BLANK.match(text, m.end()).end()
    if not m["name3"]:
        opened = _TS_BLANK.match(text, max(at, _angle(text, at))).end() if text.startswith("<", at) else at
        if text.startswith("(", opened):
            return _typescript_tail(text, _closing(text, opened + 1, _TS_SKIP), bool(m["name"]))
    if text.startswith(":", at):
        found = None if m["name3"] else _typescript_value(text, at + 1)
        if found:
            return found
        at = _TS_BLANK.match(text, _type_end(text, at + 1)).end()
    return _typescript_value(text, at + 1) if text.startswith("=", at) and text[at + 1 : at + 2] not in ("=", ">") else None


def _python_body(text: str, at: int, indent: int) -> tuple[int, int]:
    for m in _PY_SKIP.finditer(text, at):
        if m[0] == ":":
            end = m.end()
            block = re.compile(rf"(?:\r\n|\r|\n)(?=[ \t]{{0,{indent}}}[^\s#])").search(text, end)
            return end, block.start() if block else len(text)
    return len(text), len(text)


def islands(text: str, language: str) -> list[Island]:
    """All named functions and methods of a source text, in order."""
    grammar = _GRAMMARS.get(language)
    if not grammar or not text:
        return []
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    out: list[Island] = []
    doc: str | None = None
    edge, skip = -1, 0  # edge: where the documentation and annotations so far end
    for m in grammar.finditer(text):
        if m.start() < skip:
            continue
        kind = m.lastgroup if m.lastgroup in ("doc", "note", "water") else "head"
        touching = edge >= 0 and not text[edge : m.start()].strip()
        if kind == "doc":
            doc, edge = m[0], m.end()
        elif kind == "note":
            skip = _annotation_end(text, m, language)
            if touching:
                edge = skip
        elif kind == "water":
            doc, edge = None, -1
        else:
            name = next((m[g] for g in ("name", "name2", "name3") if g in grammar.groupindex and m[g]), "")
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            if language == "typescript":
                ends = _typescript_function(text, m)
                if not ends:
                    doc, edge = None, -1
                    continue
                head_end, end = ends
                found = doc if touching else None
                out.append(Island(name, bisect_right(starts, first), " ".join(text[first:head_end].split()), found, first, end))
                doc, edge = None, -1
                continue
            after = _closing(text, m.end())
            if language == "python":
                indent = len(m[0]) - len(m[0].lstrip(" \t"))
                head_end, end = _python_body(text, after, indent)
                d = _PY_DOC.match(text, head_end)
                found = next((g for g in d.groups() if g is not None), None) if d and d.end() <= end else None
            else:
                head_end, end = _body(text, after)
                found = doc if touching else None
            out.append(Island(name, bisect_right(starts, first), " ".join(text[first:head_end].split()), found, first, end))
            doc, edge = None, -1
    return out


def _annotation_end(text: str, m: re.Match[str], language: str) -> int:
    if language == "php":
        return _closing(text, m.end())
    tail = re.compile(r"[\w$.]+\s*(\()?").match(text, m.end())
    if not tail:
        return m.end()
    return _closing(text, tail.end()) if tail[1] else tail.end()


# --- what a documentation comment says

_CODE = re.compile(r"<(code|pre)\b[^>]*>.*?(?:</\1\s*>|\Z)|```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|``[^`]*``|`[^`\r\n]*`|\{@[^}]*\}", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_CALL = re.compile(r"[\w$\\:>-]*\w\s*\([^()]*\)\s*;?")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")
#: Ways of saying that nothing is said, in the languages of the corpus.
_MISSING = re.compile(
    r"\b(?:enter|insert|add|put|write|type)\s+(?:a\s+|the\s+|your\s+|some\s+)?(?:short\s+)?(?:description|documentation|doc|docs|comment|summary)\b"
    r"|^\W*(?:todo|fixme|tbd|xxx|n/?a)\b"
    r"|\b(?:description|documentation|docs?|doc\s*block|comment)s?\b.{0,40}\b(?:missing|here|pending|to\s+be\s+(?:done|added|written|completed)|needed|required|later|tbd|todo|follows)\b"
    r"|\b(?:no|without|missing|lacks?)\s+(?:\w+\s+)?(?:description|documentation|docs?|comment)s?\b"
    r"|\b(?:is|was|are|has)\s+(?:not|n't|yet\s+to\s+be)\s+(?:yet\s+|been\s+)*(?:documented|described)\b|\b(?:undocumented|not\s+(?:yet\s+)?documented)\b"
    r"|\bauto-?generated\s+(?:method|function|documentation|comment|doc)\b"
    r"|\b(?:keine|fehlende|noch\s+keine)\s+(?:\w+\s+)?(?:beschreibung|dokumentation)\b|\b(?:beschreibung|dokumentation)\b.{0,30}\b(?:fehlt|folgt|ergänzen|nachtragen)\b|\bnicht\s+dokumentiert\b|\bfehl(?:t|en)\b.{0,30}\b(?:beschreibung|dokumentation|kommentar)"
    r"|\b(?:description|documentation)\b.{0,30}\b(?:manqu\w+|à\s+(?:compléter|écrire|venir|faire))|\bmanque\b.{0,30}\b(?:description|documentation)\b|\b(?:pas|aucune)\s+(?:de\s+|encore\s+)*(?:description|documentation)\b"
    r"|\b(?:sin|falta(?:\s+la)?)\s+(?:descripción|documentación)\b|\b(?:descripción|documentación)\b.{0,30}\b(?:pendiente|falta)\b",
    re.I | re.S,
)


def prose(doc: str) -> str:
    """The text of a documentation comment outside tag lines and code."""
    text = re.sub(r"^\s*/\*\*+|\*+/\s*$", "", doc.strip()) if doc.lstrip().startswith("/*") else doc
    lines = [re.sub(r"^\s*\*+(?!\*)", "", x) for x in _LINE.split(text)]
    text = _CODE.sub(" ", "\n".join(lines))
    return "\n".join(x.strip() for x in text.split("\n") if x.strip() and not x.lstrip().startswith("@"))


def name_words(name: str | None) -> set[str]:
    return {w.lower() for w in _CAMEL.findall(name or "")} | ({name.lower()} if name else set())


def description_of(doc: str | None, name: str | None) -> str | None:
    """The prose of a comment if it says something about ``name``, else nothing."""
    if not doc:
        return None
    text = prose(doc)
    own = name_words(name)
    said = [w for w in _WORD.findall(_CALL.sub(" ", text)) if w.lower() not in own]
    if len(said) < LEAST_WORDS or _MISSING.search(text):
        return None
    return text


# --- tables

_PAIRS = "file_id long, language string, line int, name string, signature string, code string, description string"


def documented_functions(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Functions whose documentation says something: (file_id, language, line, name, signature, code, description).

    Without ``with_code`` the three texts are left null, for those who only ask which.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAIRS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for file_id, language, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "language", "content")), strict=True):
                lang = (language or "").strip().lower()
                for f in islands(text or "", lang):
                    said = description_of(f.doc, f.name)
                    if said is None:
                        continue
                    texts = (f.signature, text[f.start : f.end].rstrip(), said) if with_code else (None, None, None)
                    for c, v in zip(cols, (file_id, lang, f.line, f.name, *texts), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select(F.col("file_id").cast("long"), "language", "content").mapInArrow(run, _PAIRS)


def documented_symbols(symbols: DataFrame, files: DataFrame, with_code: bool = True) -> DataFrame:
    """(symbol_id, file_id, language, name, signature, code, description) of methods and functions of the index.

    A symbol is the function of its file that begins in its line; where several do, the
    one of its name.
    """
    mine = symbols.filter(F.col("kind").isin("method", "function")).select(
        F.col("symbol_id").cast("long"), F.col("file_id").cast("long"), F.col("line_start").cast("int").alias("line"), F.lower("name").alias("wanted")
    )
    found = documented_functions(files, with_code)
    return (
        mine.join(found, ["file_id", "line"])
        .filter(F.col("wanted").isNull() | (F.col("wanted") == F.lower("name")))
        .select("symbol_id", "file_id", "language", "name", "signature", "code", "description")
        .distinct()
    )
