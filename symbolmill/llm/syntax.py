"""Source files that do not parse (problem 6).

Per language a lexer takes literals and comments out of the text, which finds what is
unterminated; a pushdown stack runs over the delimiters of the rest, which finds what
is unbalanced, closed wrongly or ended too early; and token rules on the rest find
merge-conflict markers, neighbours no grammar allows (two names or a literal and a name
in a row, as in prose or in another language), statements that break off and, for PHP,
a missing opening tag. Bodies of SQL routines and blocks are not judged, but for their
delimiters and their END; all other SQL statements are. Strings with expressions in them
(PHP, TypeScript templates, Python's formatted strings) and JSX elements are taken out by a
pushdown of their own. For Python a second stack follows the indentation: what opens a
block, which clause may follow which, and where a block must not end.

Verdicts are per file and come from one pass over the table without a shuffle; rates
per repository and language are one small aggregation.

Edge cases: null, empty and blank contents are valid; unknown and null languages are
not judged; languages are compared in lower case; any line ends, a byte-order mark and
unusual characters are part of the language; very long files are read whole; strings in
strings (or elements in elements) nested some hundred levels deep are a fault; repeated
rows give one verdict; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the text without literals: what was unterminated, a literal, a conflict marker.
_OPEN, _LITERAL, _CONFLICT = "\x01", "\x02", "\x03"
_PAIRS = {")": "(", "]": "[", "}": "{"}
_DELIMITER = re.compile(r"[()\[\]{}]")
_MARKER = r"(?<![^\r\n])(?:(?:<{7}|>{7}|\|{7})(?:[ \t][^\r\n]*)?|={7})(?![^\r\n])"


def unbalanced(code: str, pattern: re.Pattern[str] = _DELIMITER) -> str | None:
    """What the pushdown stack finds wrong with the delimiters."""
    stack: list[str] = []
    for d in pattern.findall(code):
        if d in "([{":
            stack.append(d)
        elif not stack:
            return "closed too often"
        elif stack.pop() != _PAIRS[d]:
            return "closed wrongly"
    return "premature end" if stack else None


def _words(text: str) -> str:
    return "|".join(text.split())


#: Keywords that open a declaration: no other name stands before them.
_DECLARE = frozenset(("function", "class", "interface", "trait", "namespace", "import", "const", "let", "def"))


def _neighbours(keywords: str, before: str = r"[\w$\\>.:@#&-]", declare: frozenset[str] = _DECLARE) -> Callable[[str], bool]:
    """Whether two names stand in a row of which neither is a keyword."""
    known = frozenset(keywords.split())
    pair = re.compile(rf"(?<!{before})([^\W\d]\w*+)[ \t]++(?=([^\W\d]\w*+))")

    def found(code: str) -> bool:
        return any(
            a not in known and a.lower() not in known and (b in declare or (b not in known and b.lower() not in known)) for a, b in pair.findall(code)
        )

    return found


# --- PHP

_PHP_TAG = re.compile(r"<\?(?:php\b|=|(?=\s))", re.I)
_PHP_TOKEN = re.compile(
    r"(?P<comment>(?://|#(?!\[))[^\r\n]*?(?=\?>|[\r\n]|\Z)|/\*.*?\*/)"
    r"|(?P<halt>\b__halt_compiler\s*\(\s*\)\s*(?:;|\?>).*\Z)"
    r"|(?P<html>\?>.*?(?:<\?(?:php\b|=|(?=\s))|\Z))"
    r"|(?P<conflict>" + _MARKER + r")"
    r"|(?P<literal>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`"
    r"|<<<[ \t]*(?P<q>[\"']?)(?P<id>[^\W\d]\w*)(?P=q)[ \t]*(?:\r\n|\r|\n)(?:.*?[\r\n])??[ \t]*(?P=id)\b)"
    r"|(?P<open>['\"`]|/\*|<<<[ \t]*[\"']?[^\W\d]\w*[\"']?[ \t]*[\r\n])",
    re.S | re.M | re.I,
)
_PHP_KEYWORDS = (
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif enddeclare endfor "
    "endforeach endif endswitch endwhile enum extends final finally fn for foreach from function global goto if implements include include_once "
    "instanceof insteadof interface match namespace new or print private protected public readonly require require_once return static switch "
    "throw trait try unset use var while xor yield int float string bool mixed void iterable object self parent null false true never"
)
_PHP_NAMES = _neighbours(_PHP_KEYWORDS)
_PHP_AFTER = _words("as and or xor instanceof insteadof else elseif endif endforeach endwhile endfor endswitch while catch finally extends implements")
_PHP_WRONG = re.compile(
    rf"(?:{_LITERAL}|\$\w++)[ \t\r\n]*(?:{_LITERAL}|\$\w|(?!(?:{_PHP_AFTER})\b)[A-Za-z_]\w*)|\b\d+[ \t\r\n]+(?:\$\w|\d|{_LITERAL})|\b(?:extends|implements)\s*[{{;]"
    r"|(?<![=!<>])=[ \t\r\n]*[;)\]}]|[^\s;,:(\[{}]\s*=>\s*[;)\]}]|(?<![=!<>])=[ \t]+=|\b(?:class|interface|trait|enum|function)\s+\d|->\s*[;)\]}=]|,\s*;|\(\s*,|(?<!use )\bfunction\s+\w+\s*[^\s(\w]|\b(?:class|interface|trait)\s+\w+\s*[;(=]",
    re.S,
)


_PHP_STRING = re.compile(
    r"(?P<skip>(?://|#(?!\[))[^\r\n]*?(?=\?>|[\r\n]|\Z)|/\*.*?\*/|\?>.*?(?:<\?(?:php\b|=|(?=\s))|\Z)|'(?:[^'\\]|\\.)*'"
    r"|<<<[ \t]*(?P<q>[\"']?)(?P<id>[^\W\d]\w*)(?P=q)[ \t]*(?:\r\n|\r|\n)(?:.*?[\r\n])??[ \t]*(?P=id)\b)|(?P<quote>[\"`])",
    re.S | re.I,
)
_PHP_FIELD = re.compile(r"[()\[\]{}\"'`]")


def _php_string_end(text: str, at: int, quote: str) -> int:
    """Position behind a string whose text begins at ``at``, expressions in it (``{$...}``) by a pushdown; -1 if it has no end."""
    stop = re.compile(r"\\.|\{\$|\$\{|" + quote, re.S)
    while m := stop.search(text, at):
        at = m.end()
        if m[0] == quote:
            return at
        if m[0][0] == "\\":
            continue
        stack = ["{"]
        while stack:
            f = _PHP_FIELD.search(text, at)
            if not f:
                return -1
            at = f.end()
            if f[0] in "([{":
                stack.append(f[0])
            elif f[0] in ")]}":
                if stack.pop() != _PAIRS[f[0]]:
                    return -1
            elif f[0] == "'":
                end = re.compile(r"(?:[^'\\]|\\.)*'", re.S).match(text, at)
                at = end.end() if end else -1
            else:
                at = _php_string_end(text, at, f[0])
            if at < 0:
                return -1
    return -1


def _plain_interpolated(text: str) -> str:
    """The text with interpolated strings turned into empty ones."""
    out: list[str] = []
    at = 0
    while m := _PHP_STRING.search(text, at):
        end = m.end() if m["skip"] else _php_string_end(text, m.end(), m["quote"])
        out.append(text[at : m.end()] if m["skip"] or end < 0 else text[at : m.start()] + '""')
        at = m.end() if end < 0 else end
    return "".join(out) + text[at:]


#: Words whose parentheses are no arguments of a call: another operand may follow them.
_PHP_HEADS = frozenset("if elseif while for foreach switch match catch declare function fn use return echo print and or xor include include_once require require_once case throw new else do clone yield".split())
_PHP_CALL = re.compile(r"([^\W\d]\w*)?[ \t]*\(|\)[ \t]*(?:[\r\n]\s*)?(?=([$\x02\w])?)")


_PHP_NEXT = re.compile(r"\)\s*[$\x02\d]")


def _missing_separator(code: str) -> bool:
    """Whether a variable, number or literal follows the arguments of a call."""
    if not _PHP_NEXT.search(code):
        return False
    calls: list[bool] = []
    for m in _PHP_CALL.finditer(code):
        if m[0][-1] == "(":
            before = code[m.start() - 1 : m.start()]
            calls.append(bool(m[1]) and m[1].lower() not in _PHP_HEADS and not (before and before in "$"))
        elif calls and calls.pop() and m[2] and (m[2] in "$\x02" or m[2].isdigit()):
            return True
    return False


def php_fault(text: str) -> str | None:
    tag = _PHP_TAG.search(text)
    if not tag:
        return "no opening tag"
    text = text[tag.end() :]
    if "{$" in text or "${" in text:
        text = _plain_interpolated(text)
    code = _PHP_TOKEN.sub(_replace, text)
    fault = _common(code) or unbalanced(code)
    if fault:
        return fault
    if _missing_separator(code):
        return "unexpected token"
    if code.rstrip()[-1:] not in ("", ";", "}", ":"):
        return "premature end"
    if _PHP_NAMES(code) or _PHP_WRONG.search(code):
        return "unexpected token"
    return None


def _replace(m: re.Match[str]) -> str:
    kind = m.lastgroup
    if kind == "comment":
        return " "
    if kind in ("html", "halt"):
        return ";"
    if kind == "conflict":
        return _CONFLICT
    return _OPEN if kind == "open" else _LITERAL


def _common(code: str) -> str | None:
    if _CONFLICT in code:
        return "merge conflict"
    return "unterminated literal" if _OPEN in code else None


# --- TypeScript

#: Where a slash begins a regular expression.
_TS_BEFORE = r"(?=[ \t/])(?:(?<=[(,=:\[!&|?{};+\n])|(?<==>)|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bof)|(?<=\bin)|(?<=\bvoid)|(?<=\bdelete)|(?<=\bthrow)|(?<=\bdo)|(?<=\belse)|(?<=\bawait)|(?<=\byield))"
_TS_TOKEN = re.compile(
    r"(?P<comment>//[^\r\n]*|/\*.*?\*/)"
    r"|(?P<conflict>" + _MARKER + r")"
    r"|(?P<literal>'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\""
    r"|" + _TS_BEFORE + r"(?P<gap>[ \t]*)/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*)"
    r"|(?P<template>`)"
    r"|(?P<open>['\"]|/\*)",
    re.S | re.M,
)
_TS_KEYWORDS = (
    "abstract any as asserts async await boolean break case catch class const constructor continue debugger declare default delete do else "
    "enum export extends finally for from function get global if implements import in infer instanceof interface is keyof let module namespace "
    "never new null number object of out override package private protected public readonly require return satisfies set static string "
    "super switch symbol this throw true try type typeof undefined unique unknown using var void while with yield accessor"
)
_TS_NAMES = _neighbours(_TS_KEYWORDS, r"[\w$.@#-]")
_TS_WRONG = re.compile(
    rf"(?:{_LITERAL})[ \t]*(?:{_LITERAL}|(?!(?:as|in|of|instanceof|satisfies|from|is|with|assert)\b)[A-Za-z_$]\w*)|\b\d+[ \t]+(?:[A-Za-z_]\w*|\d|{_LITERAL})(?<!\bin)(?<!\bas)(?<!\bof)"
    r"|(?<![=!<>])=[ \t\r\n]*[;)\]}]|(?<![=!<>])=[ \t]+=|\b(?:class|interface|enum|function|const|let|var)\s+\d|\b(?:const|let|var)\s*[=;]|,\s*;|\(\s*,|<\?php|\b(?:extends|implements)\s*[{;]|\bimport\s+\w+\s*[\r\n;]|^\s*def\s+\w+\s*\(|^\s*#(?!\w)|\$\w+\s*->|^\s*(?:use|namespace)\s+[\w\\]+;",
    re.S | re.M,
)
_TS_BROKEN = re.compile(r"\b(?:const|let|var|return|function|class|interface|export|import|from|new|extends|implements|if|for|while|throw|else|case|typeof|await|of|in)\s*\Z|[=+*/,.:?&|(\[{<-]\s*\Z")


_TS_REGEX = _TS_BEFORE + r"[ \t]*/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*|"
_TS_SPLIT = re.compile(
    _TS_REGEX + r"//[^\r\n]*|/\*.*?\*/|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|`(?:[^`\\$]|\\.|\$(?!\{))*`|`", re.S
)


_TS_PLAIN = r"//[^\r\n]*|/\*.*?\*/|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|`(?:[^`\\]|\\.)*`"
_JSX_BEGIN = r"(?:(?<=[(=?:,\[{&|])|(?<==>)|(?<=\breturn))(?P<gap>\s*)<(?=[A-Za-z>])"
_JSX_STEP = re.compile(_TS_REGEX + _TS_PLAIN + "|(?P<jsx>" + _JSX_BEGIN + ")", re.S)
_JSX_BRACE = re.compile(_TS_PLAIN + "|[{}]|(?P<jsx>" + _JSX_BEGIN + ")", re.S)
_JSX_OPEN = re.compile(r"<([A-Za-z][\w.:-]*)?")
_JSX_ATTRIBUTE = re.compile(r"\s*(?:[A-Za-z_$][\w$:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<value>\{)))?|(?P<spread>\{)|(?P<end>/?>))")
_JSX_LEFT = re.compile(r"</[A-Za-z][\w.:-]*>")
_JSX_CHILD = re.compile(r"</\s*(?P<close>[\w.:-]*)\s*>|[<{]")


def _jsx_end(text: str, at: int) -> int:
    """Position behind the element that begins at ``at``; -1 if there is none."""
    m = _JSX_OPEN.match(text, at)
    at = m.end()
    while True:
        a = _JSX_ATTRIBUTE.match(text, at)
        if not a:
            return -1
        at = a.end()
        if a["value"] or a["spread"]:
            at = _jsx_brace(text, at)
            if at < 0:
                return -1
        elif a["end"] == "/>":
            return at
        elif a["end"]:
            break
    while child := _JSX_CHILD.search(text, at):
        if child[0].startswith("</"):
            return child.end() if child["close"] == (m[1] or "") else -1
        at = _jsx_brace(text, child.end()) if child[0] == "{" else _jsx_end(text, child.start())
        if at < 0:
            return -1
    return -1


def _jsx_brace(text: str, at: int) -> int:
    """Position behind the brace that closes the one before ``at``."""
    depth = 1
    while m := _JSX_BRACE.search(text, at):
        at = m.end()
        if m["jsx"]:
            end = _jsx_end(text, m.end("gap"))
            at = end if end > 0 else at
        elif m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at
    return -1


def _plain_elements(text: str) -> str:
    """The text with JSX elements, where an operand may stand, turned into empty strings."""
    out: list[str] = []
    at = 0
    while m := _JSX_STEP.search(text, at):
        end = _jsx_end(text, m.end("gap")) if m["jsx"] else -1
        out.append(text[at : m.end()] if end < 0 else text[at : m.end("gap")] + '""')
        at = m.end() if end < 0 else end
    return "".join(out) + text[at:]


def typescript_fault(text: str) -> str | None:
    if "</" in text or "/>" in text:
        text = _plain_elements(text)

    def literal(m: re.Match[str]) -> str:
        if m.lastgroup == "comment":
            return " "
        if m.lastgroup == "conflict":
            return _CONFLICT
        if m.lastgroup == "template":
            return "`"
        return _OPEN if m.lastgroup == "open" else (m["gap"] or "") + _LITERAL

    # templates first become plain literals where they are whole, so their quotes are no quotes
    nested = False

    def flat(m: re.Match[str]) -> str:
        nonlocal nested
        t = m[0]
        if t[0] != "`":
            return t
        if t == "`":
            nested = True
            return t
        return '""'

    if "`" in text:
        plain = _TS_SPLIT.sub(flat, text)
        text = _flatten_templates(text) if nested else plain
    code = _TS_TOKEN.sub(literal, text)
    fault = _common(code) or ("unterminated literal" if "`" in code else None) or unbalanced(code) or ("closed wrongly" if _JSX_LEFT.search(code) else None)
    if fault:
        return fault
    if _TS_BROKEN.search(code):
        return "premature end"
    if _TS_NAMES(code) or _TS_WRONG.search(code):
        return "unexpected token"
    return None


_TEMPLATE_STEP = re.compile(_TS_REGEX + r"//[^\r\n]*|/\*.*?\*/|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|[`{}]", re.S)
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.S)


def _flatten_templates(text: str) -> str:
    """Template literals with substitutions as ``"" + (...)``; an unterminated one stays a backquote."""
    out: list[str] = []
    stack: list[int] = []
    i = 0
    while m := _TEMPLATE_STEP.search(text, i):
        t = m[0]
        out.append(text[i : m.start()])
        i = m.end()
        into_text = t == "`"
        if t == "{" and stack:
            stack[-1] += 1
        elif t == "}" and stack:
            if stack[-1] == 0:
                stack.pop()
                out.append(")")
                into_text = True
                t = ""
            else:
                stack[-1] -= 1
        if not into_text:
            out.append(t)
            continue
        body = _TEMPLATE_TEXT.match(text, i)
        i = body.end()
        if body[1] == "`":
            out.append('""' if t else "")
        elif body[1] == "${":
            out.append('"" + (' if t else " + (")
            stack.append(0)
        else:
            return "".join(out) + "`"
    return "".join(out) + text[i:]


# --- Python

_PY_PREFIX = r"(?<![\w.])(?:[rR]?[fFtT]|[fFtT][rR]|[rR]?[bB]|[bB][rR]|[rRuU])?"
_PY_TOKEN = re.compile(
    r"(?P<comment>#[^\r\n]*)"
    r"|(?P<conflict>" + _MARKER + r")"
    rf"|(?P<literal>{_PY_PREFIX}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"))"
    r"|(?P<join>\\(?:\r\n|\r|\n))"
    r"|(?P<open>['\"])",
    re.S | re.M,
)
_PY_FORMATTED = re.compile(r"(?P<skip>#[^\r\n]*)|(?P<prefix>(?<![\w.])[rRbBuUfFtT]{0,2})(?P<quote>\"\"\"|'''|\"|')")
_PY_KEYWORDS = (
    "False None True and as assert async await break case class continue def del elif else except exec finally for from global if import in is lambda "
    "match nonlocal not or pass raise return try type while with yield"
)
_PY_NAMES = _neighbours(_PY_KEYWORDS, r"[\w.@$]", frozenset(("def", "class")))
_PY_BETWEEN = _words("and or not in is if else for async as from import")
_PY_WRONG = re.compile(
    rf"{_LITERAL}[ \t]*(?!(?:{_PY_BETWEEN})\b)[^\W\d]\w*|(?<![\w.])(?!(?:{_words(_PY_KEYWORDS)})\b)[^\W\d]\w*[ \t]*{_LITERAL}"
    rf"|(?<![\w.])\d[\w.]*[ \t]+(?:\d|{_LITERAL}|(?!(?:{_PY_BETWEEN})\b)[^\W\d]\w*)|[\])}}][ \t]*(?:\d|{_LITERAL}|(?!(?:{_PY_BETWEEN})\b)[^\W\d]\w*)"
    r"|[?$`]|!(?!=)|&&|\|\||=>|===|[=!<>]=[ \t]*=|=[ \t]+=|(?<![=!<>:])=[ \t]*(?:[,)\]}]|$)|[(\[{,][ \t]*,|[+\-/%|&^~<>=][ \t]*$|(?<!import)(?<!import[ \t])\*[ \t]*$|(?<![\d.])\.[ \t]*(?:$|[)\]},])|[+%|&^~<>-][ \t]*[)\]}]|,[ \t]*;"
    rf"|\b(?:{_words('and or not in is if else for lambda import assert as del global nonlocal while elif class def from')})[ \t]*(?:$|[)\]}},=])"
)
_PY_LEAD = re.compile(r"[ \t\f]*")
_PY_OPENS = re.compile(r"(async[ \t]+)?(if|elif|else|for|while|try|except|finally|with|def|class)\b")
_PY_SOFT = re.compile(r"(match|case)[ \t]+(?![=.,)\]]|(?:and|or|in|is|if|else|for)\b).*:[ \t]*$|(match|case)[ \t]*[(\[{\x02-].*:[ \t]*$")
_PY_STATEMENTS = [
    (re.compile(p), re.compile(q))
    for p, q in (
        (r"import\b", r"import[ \t]+[\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*[ \t]*"),
        (r"from\b", r"from[ \t]*(?:\.[ \t.]*)?(?:[\w.]+[ \t]*)?\bimport\b[ \t]*(?:\*|\(.*\)|\w+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*\w+(?:[ \t]+as[ \t]+\w+)?)*)[ \t]*"),
        (r"(?:async[ \t]+)?def\b", r"(?:async[ \t]+)?def[ \t]+[^\W\d]\w*[ \t]*(?:\[.*\][ \t]*)?\(.*\)[ \t]*(?:->[ \t]*\S.*?)?:.*"),
        (r"class\b", r"class[ \t]+[^\W\d]\w*[ \t]*(?:\[.*\][ \t]*)?(?:\(.*\)[ \t]*)?:.*"),
        (r"(?:else|try|finally)\b", r"(?:else|try|finally)[ \t]*:.*"),
        (r"(?:if|elif|while|with|except)\b|(?:async[ \t]+)?(?:for|with)\b", r"(?:except[ \t]*|(?:async[ \t]+)?(?:if|elif|while|with|except|for)\b[ \t]*[^\s:].*?):.*"),
        (r"(?:async[ \t]+)?for\b", r".*\bin\b[ \t]*[^\s:].*:.*"),
        (r"(?:pass|break|continue)\b", r"(?:pass|break|continue)[ \t]*(?:;.*)?"),
    )
]
#: What a clause follows at its own depth.
_PY_AFTER = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else"),
}


def _plain_formatted(text: str) -> str:
    """The text with formatted strings whose replacement fields hold quotes or strings turned into plain ones; a pushdown over fields."""
    out: list[str] = []
    at = 0
    while m := _PY_FORMATTED.search(text, at):
        if m["skip"]:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        end = _string_end(text, m.end(), m["quote"], "f" in m["prefix"].lower() or "t" in m["prefix"].lower(), 0)
        out.append(text[at : m.start()])
        out.append(text[m.start() : m.end()] if end < 0 else '""')
        at = m.end() if end < 0 else end
    return "".join(out) + text[at:]


def _string_end(text: str, at: int, quote: str, fields: bool, depth: int) -> int:
    """Position behind a string whose text begins at ``at``; -1 if it has no end."""
    stop = re.compile(r"\\(?:\r\n|.)|" + quote + (r"|\{\{|\{" if fields else "") + ("" if len(quote) == 3 else r"|[\r\n]"), re.S)
    while m := stop.search(text, at):
        at = m.end()
        if m[0] == quote:
            return at
        if m[0] in ("\r", "\n"):
            return -1
        if m[0] == "{":
            level = 1
            while level:
                f = re.compile(r"[{}]|[rRbBuUfFtT]{0,2}(\"\"\"|'''|\"|')", re.S).search(text, at)
                if not f:
                    return -1
                at = f.end()
                if f[0] == quote and level == 1 and not depth and not re.compile(r"[^\r\n]*[}]").match(text, at):
                    return -1
                if f[0] in "{}":
                    level += 1 if f[0] == "{" else -1
                else:
                    at = _string_end(text, at, f[1], len(f[0]) > len(f[1]), depth + 1)
                    if at < 0:
                        return -1
    return -1


def _logical_lines(code: str) -> tuple[list[tuple[int, str]], str | None]:
    """(indentation, text) of logical lines, brackets joined to one line; what the stack of brackets finds wrong."""
    out: list[tuple[int, str]] = []
    stack: list[str] = []
    current: list[str] = []
    for line in re.split(r"\r\n|\r|\n", code):
        if not current and not line.strip():
            continue
        current.append(line)
        for d in _DELIMITER.findall(line):
            if d in "([{":
                stack.append(d)
            elif not stack:
                return out, "closed too often"
            elif stack.pop() != _PAIRS[d]:
                return out, "closed wrongly"
        if not stack:
            whole = " ".join(current)
            lead = _PY_LEAD.match(whole)[0]
            out.append((len(lead.expandtabs(8)), whole.strip()))
            current = []
    return out, "premature end" if stack else None


def python_fault(text: str) -> str | None:
    """Literals by the lexer, brackets and blocks by stacks, statements by their forms."""
    text = text.removeprefix("\ufeff")
    if "{" in text:
        text = _plain_formatted(text)
    code = _PY_TOKEN.sub(lambda m: " " if m.lastgroup == "join" else _replace(m), text)
    fault = _common(code)
    if fault:
        return fault
    lines, fault = _logical_lines(code)
    return fault or _blocks(lines)


def _blocks(lines: list[tuple[int, str]]) -> str | None:
    """What is wrong with the indentation, the clauses or a statement."""
    depths, last, opened = [0], [""], False  # last: the statement before at each depth, by its keyword
    for depth, line in lines:
        if opened:
            if depth <= depths[-1]:
                return "premature end"
            depths.append(depth)
            last.append("")
            opened = False
        elif depth > depths[-1]:
            return "unexpected token"
        head = _PY_OPENS.match(line)
        word = head[2] if head else ""
        while depth < depths[-1]:
            if last[-1] == "try":
                return "unexpected token"
            depths.pop()
            last.pop()
        if depth != depths[-1] or (last[-1] == "try" and word not in ("except", "finally")) or (word in _PY_AFTER and last[-1] not in _PY_AFTER[word]):
            return "unexpected token"
        soft = bool(not head and _PY_SOFT.match(line))
        if line[0] in "/%|&^=<>,:)]}!+" and line[:1] != "+" or (line[0] == "." and not line.startswith("...")):
            return "unexpected token"
        for part in _statements_of(line):
            if _PY_NAMES(part) or _PY_WRONG.search(part):
                return "unexpected token"
        for start, form in _PY_STATEMENTS:
            if start.match(line) and not form.fullmatch(line) and not (start.pattern.startswith(("import", "from")) and ";" in line):
                return "unexpected token"
        opened = (bool(head) or soft) and line.endswith(":")
        last[-1] = word
    if opened:
        return "premature end"
    return "premature end" if "try" in last else None


def _statements_of(line: str) -> list[str]:
    return [p.strip() for p in line.split(";")] if ";" in line else [line]


# --- SQL

_SQL_PARTS = (
    r"(?P<comment>--[^\r\n]*|/\*.*?\*/|#(?=[ \t#!-])[^\r\n]*|^#[^\r\n]*)"
    r"|(?P<conflict>" + _MARKER + r")"
    r"|(?P<literal>{string}|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[^\]\r\n]*\]|(?P<tag>\$(?:[^\W\d]\w*)?\$).*?(?P=tag))"
    r"|(?P<open>['\"`]|/\*)"
)
_SQL_TOKENS = [re.compile(_SQL_PARTS.replace("{string}", s), re.S | re.M) for s in (r"'(?:[^']|'')*'", r"'(?:[^'\\]|''|\\.)*'")]
_SQL_STARTS = _words(
    "create insert update delete alter drop select with set begin commit rollback start grant revoke truncate rename comment use merge replace "
    "call exec execute declare analyze analyse explain vacuum lock unlock copy do go show describe desc pragma savepoint release values load "
    "optimize reindex cluster refresh delimiter if end return print raiserror prepare deallocate attach detach upsert checkpoint "
    "reset discard listen notify flush kill handler table else while loop repeat leave iterate signal open close fetch"
)
_SQL_HEAD = re.compile(rf"\s*(?:\(\s*)*(?:{_SQL_STARTS})\b", re.I)
_N = rf"(?:[\w$#@]|{_LITERAL})+(?:\s*\.\s*(?:[\w$#@]|{_LITERAL})+)*"
_OBJECTS = _words(
    "table view index sequence schema database user role function procedure trigger type domain extension policy rule aggregate cast collation "
    "conversion language operator publication subscription server statistics tablespace text event package synonym partition constraint column "
    "default login queue assembly certificate group profile directory library cluster catalog macro stream task stage warehouse pipe"
)
_OBJECT_WORDS = (
    r"(?:unique|clustered|nonclustered|columnstore|fulltext|spatial|bitmap|temp|temporary|unlogged|global|local|external|virtual|foreign|materialized|"
    r"recursive|force|editionable|noneditionable|public|private|constraint|event|definer\s*=\s*\S+|algorithm\s*=\s*\w+|sql\s+security\s+\w+|"
    r"transient|secure|live|streaming|trusted|default|access|body)"
)
_SQL_FORMS = [
    (re.compile(p, re.I | re.S), re.compile(q, re.I | re.S))
    for p, q in (
        (r"\s*insert\b", rf"\s*insert\s+(?:or\s+\w+\s+|ignore\s+|low_priority\s+|delayed\s+|overwrite\s+|all\s+)*(?:into\s+)?(?:table\s+)?{_N}\s*(?:as\s+\w+\s*)?(?:\(.*?\)\s*)?(?:overriding\s+\w+\s+value\s+)?(?:values?\b|select\b|with\b|set\b|default\b|exec|table\b|\().*[^\s,=]\s*"),
        (r"\s*update\b", rf"\s*update\s+.*?\bset\s+{_N}\s*=\s*\S.*"),
        (r"\s*delete\b", rf"\s*delete\s+(?:top\s*\(.*?\)\s*|low_priority\s+|quick\s+|ignore\s+)*(?:{_N}(?:\s*,\s*{_N})*\s+)?from\s+(?:only\s+)?{_N}.*"),
        (r"\s*drop\b", rf"\s*drop\s+(?:temporary\s+|materialized\s+|foreign\s+|public\s+)*(?:{_OBJECTS})\b.*\s{_N}.*"),
        (r"\s*create\b", rf"\s*create\s+(?:or\s+(?:replace|alter)\s+)?(?:{_OBJECT_WORDS}\s+)*(?:{_OBJECTS})\b.*"),
        (r"\s*alter\b", rf"\s*alter\s+(?:{_OBJECT_WORDS}\s+)*(?:{_OBJECTS})\b.*"),
        (r"\s*create\s+(?:unique\s+)?(?:clustered\s+|nonclustered\s+|fulltext\s+|spatial\s+)?index\b", r".*\bon\b.*\(.+\).*"),
        (r"\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+|external\s+|global\s+|local\s+)*table\b", r"\s*create\s.*\btable\b.+(?:\(|\bas\b|\blike\b|\bof\b|\bclone\b|\busing\b|\blocation\b).*"),
        (r"\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+|temp(?:orary)?\s+)*view\b", r".*\bas\b\s*.*\S.*"),
        (r"\s*alter\s+table\b", rf"\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_N}\s+\w+.*"),
    )
]
_SQL_BROKEN = re.compile(
    r"(?:[=<>+*/,.(|-]|\b(?:where|set|into|from|and|or|not|on|by|values|table|as|join|in|like|between|is|select|add|column|references|primary|foreign|default|constraint|if|exists|insert|update|create|alter|drop|index|view))\s*\Z"
    r"|\bwhere\s+[\w.\x02]+\s*\Z|\bset\s+[\w.\x02]+\s*\Z",
    re.I,
)
_SQL_WRONG = re.compile(r",\s*\)|\(\s*,|,\s*,|=\s*=\s*=|<\?php|=>|\$this\b", re.S)
#: Statements with a body of statements: routines, and blocks outside of them (not BEGIN of a transaction).
_SQL_ROUTINE = re.compile(
    rf"\s*(?:create|alter)\s+(?:or\s+(?:replace|alter)\s+)?(?:{_OBJECT_WORDS}\s+|temp\s+|aggregate\s+)*(?P<kind>procedure|proc|function|trigger|event|package)\b", re.I
)
_SQL_TRANSACTION = r"(?=\s*(?:;|\Z)|\s*^\s*(?:go|/)\s*$|\s+(?:tran|transaction|work|distributed|isolation|read|deferred|immediate|exclusive|concurrent)\b)"
_SQL_BLOCK = re.compile(rf"\s*(?:\w+\s*:\s*)?(?:begin\b(?!{_SQL_TRANSACTION})|declare\b|if\b|while\b)", re.I | re.M)
_SQL_STEP = re.compile(
    rf"[;()]|^[ \t]*(?:go|/)[ \t]*$|(?<![\w.@:$#])(?:begin\b{_SQL_TRANSACTION}|begin\b|case\b|end[ \t]+(?:if|loop|while|repeat|for)\b|end[ \t]+case\b|end\b)(?![ \t]*[=.])", re.I | re.M
)
_SQL_BEGIN = re.compile(rf"(?<![\w.@:$#])begin\b(?!{_SQL_TRANSACTION})", re.I | re.M)
_SQL_DECLARES = re.compile(r"\b(?:is|as|declare)\b(?!\s*\x02)", re.I)
_SQL_DELIMITER = re.compile(r"^[ \t]*delimiter[ \t]+(\S+)[^\r\n]*$", re.I | re.M)


def _declares(code: str, at: int) -> bool:
    """Whether declarations stand between ``at`` and the BEGIN of a body."""
    begin = _SQL_BEGIN.search(code, at)
    parts = code[at : begin.start()].split(";") if begin else [""]
    return bool(begin) and not parts[-1].strip() and not any(_SQL_HEAD.match(p) and not re.match(r"\s*(?:declare|pragma)\b", p, re.I) for p in parts)


def _sql_statements(code: str) -> tuple[list[tuple[str, bool]], bool]:
    """(text, whether it ends with a body, which is left out) of each statement; whether the last body lacks its END."""
    out: list[tuple[str, bool]] = []
    start = at = parens = 0
    while start < len(code):
        routine = _SQL_ROUTINE.match(code, start)
        package = bool(routine) and routine["kind"].lower() == "package"
        procedural = bool(routine) or bool(_SQL_BLOCK.match(code, start))
        body, depth, closed, stop, at, parens = -1, 0, False, len(code), start, 0
        if package:
            body = routine.end()
        after = len(code)
        while m := _SQL_STEP.search(code, at):
            step, at = " ".join(m[0].lower().split()), m.end()
            if step in ("(", ")"):
                parens += 1 if step == "(" else -1
            elif step in ("go", "/"):
                stop, after = m.start(), m.end()
                break
            elif step == ";":
                if depth or (package and not closed) or (procedural and body < 0 and _SQL_DECLARES.search(code, start, at) and _declares(code, at)):
                    continue
                stop, after = m.start(), m.end()
                break
            elif not procedural or parens > 0:
                continue
            elif step == "begin" and not re.compile(rf"begin\b{_SQL_TRANSACTION}", re.I | re.M).match(code, m.start()):
                body = m.start() if body < 0 else body
                depth += 1
            elif step == "case":
                depth += 1
            elif step in ("end", "end case"):
                closed = package and depth == 0
                depth = max(0, depth - 1)
                follows = re.compile(r"\s*([^\W\d]\w*)").match(code, at)
                if not package and body >= 0 and depth == 0 and follows and _SQL_HEAD.match(code, at) and follows[1].lower() not in ("else", "while", "if", "loop", "repeat"):
                    stop = after = at
                    break
        text = code[start : stop if body < 0 else body]
        if text.strip() or body >= 0:
            out.append((text, body >= 0))
        if depth or (package and not re.search(r"\bend\b", code[body:stop], re.I)):
            return out, True
        start = after
    return out, False


_SQL_LIST = re.compile(r"\s*select\b(.*?)(?:\b(?:from|into|where|union|group|order|having|limit|intersect|except|window|qualify|for)\b|\Z)", re.I | re.S)
#: Words that join or follow operands in the list of a SELECT.
_SQL_JOINERS = frozenset(
    "distinct all top as case when then else end and or not is null in like ilike rlike regexp between exists any some over partition by rows range groups unbounded "
    "preceding following current row within filter interval year month day hour minute second at time zone local collate escape cast using separator div mod xor "
    "similar to both leading trailing percent with ties ignore respect nulls asc desc first last true false unknown date timestamp datetime binary prior "
    "straight_join sql_no_cache sql_calc_found_rows high_priority distinctrow unique bulk collect offset fetch next only values array struct map precision varying "
    "unsigned signed integer character double national".split()
)


def _wrong_list(s: str) -> bool:
    """Whether an item of the list of a SELECT has more behind its operand than a name."""
    while "(" in s and (flat := re.sub(r"\([^()]*\)", "\x02", s)) != s:
        s = flat
    m = _SQL_LIST.match(s)
    for item in m[1].split(",") if m else ():
        words = re.findall(r"[\w$@]+(?:\s*\.\s*[\w$@*]+)*|\S", item)
        free = [bool(re.match(r"[\w$@\x02]", w)) and w.lower() not in _SQL_JOINERS for w in words]
        if any(a and b and c and words[i + 1] != _LITERAL and words[i + 2] != _LITERAL for i, (a, b, c) in enumerate(zip(free, free[1:], free[2:], strict=False))):
            return True
    return False


def _sql_fault(code: str) -> str | None:
    fault = _common(code) or unbalanced(code)
    if fault:
        return fault
    if _SQL_WRONG.search(code):
        return "unexpected token"
    statements, unended = _sql_statements(code)
    for k, (s, body) in enumerate(statements):
        if body:  # what stands in a body is not judged
            if s.strip() and not (_SQL_ROUTINE.match(s) or _SQL_BLOCK.match(s + " begin x")):
                return "unexpected token"
            continue
        if not _SQL_HEAD.match(s):
            return "unexpected token"
        if _SQL_BROKEN.search(s):
            return "premature end"
        if _wrong_list(s):
            return "unexpected token"
        for head, form in _SQL_FORMS:
            if head.match(s) and not form.fullmatch(s):
                return "premature end" if k + 1 == len(statements) and not code.rstrip().endswith(";") else "unexpected token"
    return "premature end" if unended else None


def _one_delimiter(text: str) -> str:
    """The text with what DELIMITER lines set as the end of a statement turned into semicolons."""
    parts = _SQL_DELIMITER.split(text)
    return "\n".join([parts[0], *(body if d == ";" else body.replace(d, ";") for d, body in zip(parts[1::2], parts[2::2], strict=True))]) if len(parts) > 1 else text


def sql_fault(text: str) -> str | None:
    """None if some dialect (backslashes escape in strings, or do not) takes the text."""
    text = _one_delimiter(text)
    faults = [_sql_fault(t.sub(_replace, text)) for t in (_SQL_TOKENS if "\\" in text else _SQL_TOKENS[:1])]
    return None if None in faults else faults[0]


CHECKERS: dict[str, Callable[[str], str | None]] = {
    "php": php_fault, "typescript": typescript_fault, "javascript": typescript_fault, "python": python_fault, "sql": sql_fault,
}


def fault_of(language: str | None, content: str | None) -> str | None:
    """What is wrong with a file; null if nothing is."""
    check = CHECKERS.get((language or "").strip().lower())
    try:
        return check(content) if check and content and content.strip() else None
    except RecursionError:
        return "nested too deeply"


def file_faults(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, fault) of every file, fault being null for valid ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True)
            faults = pa.array([fault_of(*p) for p in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo_id"), b.column("language"), faults], ["file_id", "repo_id", "language", "fault"])

    cols = files.select(F.col("file_id").cast("long"), F.col("repo_id").cast("long"), "language", "content")
    return cols.mapInArrow(run, "file_id long, repo_id long, language string, fault string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, fault) of files that are not valid in their language."""
    return file_faults(files).filter("fault is not null").groupBy("file_id").agg(F.min("fault").alias("fault"))


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language; repeated rows count once."""
    each = file_faults(files).groupBy("repo_id", "language", "file_id").agg(F.min("fault").alias("fault"))
    return (
        each.groupBy("repo_id", "language")
        .agg(F.count("*").alias("n_files"), F.count("fault").alias("n_invalid"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 4))
    )
