"""Extractors: files to symbols, references, tables, columns and keys.

Each is one ``mapInArrow`` over the files: no shuffle, a file is parsed where it is
read. Edge cases: null and empty contents and other languages give no rows; texts that
do not parse give what can be read of them; repeated rows are parsed each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.functions import ddl
from symbolmill.functions.php_source import Source

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _each_file(files: DataFrame, language: str, schema: str, rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows (file_id, ...) of every file of a language."""
    fields = [f.split(" ") for f in ("file_id long, " + schema).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *row) for i, text in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True) for row in rows_of(text)]
            cols = list(zip(*out, strict=True)) if out else [() for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    mine = files.filter((F.lower("language") == language) & F.col("content").isNotNull() & (F.col("content") != ""))
    return mine.select(F.col("file_id").cast("long"), "content").mapInArrow(run, "file_id long, " + schema)


#: Metadata of a symbol, by the names of the catalog.
_METADATA = {"extends": "string", "static": "boolean", "abstract": "boolean", "magic": "boolean", "readonly": "boolean", "promoted": "boolean"} | dict.fromkeys(
    ("implements", "traits", "contextArgs", "contextParams", "thrownExceptions", "caughtExceptions", "documentedThrows"), "array<string>"
)


def php_symbols(files: DataFrame) -> DataFrame:
    """Classes, interfaces, traits, enums, functions and members, with signature, docblock and metadata."""
    schema = "kind string, name string, qualified_name string, parent_name string, visibility string, line_start int, line_end int, signature string, return_type string, docblock string"
    rows = _each_file(files, "php", ", ".join([schema, *(f"{k} {v}" for k, v in _METADATA.items())]), lambda t: [(*s[:-1], *(s.metadata.get(k) for k in _METADATA)) for s in Source(t).symbols])
    return rows.select(*[c for c in rows.columns if c not in _METADATA], F.struct(*_METADATA).alias("metadata"))


def php_references(files: DataFrame) -> DataFrame:
    """References between names, targets resolved through imports and in lower case."""
    schema = "source_name string, target_qualified_name string, reference_kind string, line_number int"
    return _each_file(files, "php", schema, lambda t: [tuple(r) for r in Source(t).references])


def split_statements(text: str) -> list[tuple[int, str]]:
    """(first line, text) of statements between semicolons outside quotes, comments and parentheses."""
    out, start, depth = [], 0, 0
    for m in re.finditer(r"'(?:[^'\\]|''|\\.)*'|\"[^\"]*\"|`[^`]*`|--[^\r\n]*|/\*.*?\*/|[();]", text + ";", re.S):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == ";" and (depth <= 0 or m.end() > len(text)):
            part = text[start : m.start()]
            if part.strip():
                lead = start + len(part) - len(part.lstrip())
                out.append((1 + len(re.findall(r"\r\n|\r|\n", text[:lead])), part.strip()))
            start, depth = m.end(), 0
    return out


def sql_statements(files: DataFrame) -> DataFrame:
    """Statements of SQL files."""
    return _each_file(files, "sql", "line_start int, text string", split_statements)


def _created(text: str) -> Iterator[tuple[int, ddl.Change]]:
    """(first line of the statement, change) of the statements of a script."""
    for line, statement in split_statements(text):
        for change in ddl.statement_changes(statement):
            yield line, change


def ddl_columns(files: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE statements, with type, nullability, default, position and line."""

    def rows(text: str) -> list[tuple]:
        out, at, n = [], None, 0
        for line, c in _created(text):
            if c.level == "table":
                at, n = ((line, c.table_name) if c.op == "set" else None), 0
            elif c.level == "column" and c.op == "set" and at == (line, c.table_name):
                n += 1
                out.append((line, c.table_name, c.column_name, c.data_type, c.is_nullable, c.default_value, n, line + c.line))
        return out

    schema = "line_start int, table_name string, column_name string, data_type string, is_nullable boolean, default_value string, ordinal_position int, line_number int"
    return _each_file(files, "sql", schema, rows)


def ddl_keys(files: DataFrame) -> DataFrame:
    """Foreign keys of CREATE and ALTER TABLE statements, those of a column's definition among them."""

    def rows(text: str) -> list[tuple]:
        found = ((line, c) for line, c in _created(text) if c.level == "key" and c.op == "set")
        return [(line, c.table_name, c.field, c.source_columns, c.other, c.target_columns) for line, c in found]

    schema = "line_start int, table_name string, constraint_name string, source_columns array<string>, target_table string, target_columns array<string>"
    return _each_file(files, "sql", schema, rows)


def context_keys(files: DataFrame, fields: tuple[str, ...] = ("args", "params")) -> DataFrame:
    """E5: distinct keys read from ``$this->args[...]`` and the like, per file, in Spark alone."""
    pattern = rf"\$this->(?:{'|'.join(fields)})\[['\"]([^'\"]+)['\"]\]"
    return files.filter("content is not null").select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("context_key")).distinct()


def orm_mappings(files: DataFrame) -> DataFrame:
    """(file_id, kind, name) of table and column attributes or annotations of PHP files."""
    found = F.regexp_extract_all("content", F.lit(r"(?i)(?:#\[|@)(?:ORM\\)?(Table|Column|JoinColumn)\s*\(([^)]*)\)"), F.lit(0))
    rows = files.filter("language = 'php' and content is not null").select("file_id", F.explode(F.array_distinct(found)).alias("m"))
    kind = F.regexp_extract("m", r"(?i)(Table|Column|JoinColumn)\s*\(", 1)
    return rows.select("file_id", kind.alias("kind"), F.regexp_extract("m", r"name\s*[:=]\s*['\"]([^'\"]+)", 1).alias("name")).filter("name <> ''")


_ORM = re.compile(r"(?P<name>[\w\\]+)\s*\((?P<args>[^()]*(?:\([^()]*\)[^()]*)*)\)", re.S)
_ORM_ARGUMENT = re.compile(r"(?:(\w+)\s*[:=]\s*)?['\"]([^'\"]*)['\"]")
_ORM_ANNOTATION = re.compile(r"@(?:[\w\\]+\\)?(?P<name>table|joincolumn|column)\s*\((?P<args>[^)]*)\)", re.I)


def _orm_parts(marks: str, docblock: str | None) -> dict[str, dict[str, str]]:
    """Arguments of the table, column and joincolumn marks before a declaration: those of attributes first, else of the docblock."""
    found: dict[str, dict[str, str]] = {}
    for pattern, text, positional in ((_ORM, marks, True), (_ORM_ANNOTATION, docblock or "", False)):
        for m in pattern.finditer(text):
            leaf = m["name"].rsplit("\\", 1)[-1].lower()
            if leaf in ("table", "column", "joincolumn") and leaf not in found:
                args = {(k or "").lower(): v for k, v in _ORM_ARGUMENT.findall(m["args"])}
                name = args.get("name") or (args.get("") if positional else None)
                if name:
                    found[leaf] = args | {"name": name}
        if found:
            return found
    return found


def orm_links(files: DataFrame) -> DataFrame:
    """(file_id, owner, link_kind, table_name, column_name, referenced_column_name) of mapped classes and their properties.

    ``owner`` is the qualified name of the entity or of its property; a property counts only in a class with a table. Promoted
    parameters take attributes only. Edge cases: marks without a name and classes without a table give nothing.
    """

    def rows(text: str) -> list[tuple]:
        source, out, tables = Source(text), [], {}
        lines = text.splitlines(keepends=True)
        starts = source.starts
        for s in source.symbols:
            begin = starts[s.line_start - 1] if s.line_start <= len(starts) else len(text)
            promoted = bool(s.metadata.get("promoted"))
            if s.kind == "property" and promoted:
                line = lines[s.line_start - 1] if s.line_start <= len(lines) else ""
                at = line.find("$" + s.name)
                marks = line[line.rfind("#[", 0, at) : at] if "#[" in line[:at] else _marks_before(text, begin)
                found = _orm_parts(marks, None)
            else:
                found = _orm_parts(_marks_before(text, begin), s.docblock)
            if s.kind == "class" and "table" in found:
                tables[s.qualified_name] = ddl.normalise(found["table"]["name"])
                out.append((s.qualified_name, "entity_table", tables[s.qualified_name], None, None))
            elif s.kind == "property" and s.parent in tables:
                order = ("column", "joincolumn") if "column" in found else ("joincolumn",)
                for leaf in order[:1]:
                    if leaf in found:
                        kind = "entity_column" if leaf == "column" else "entity_join_column"
                        other = found[leaf].get("referencedcolumnname") if leaf == "joincolumn" else None
                        out.append((s.qualified_name, kind, tables[s.parent], ddl.normalise(found[leaf]["name"]), ddl.normalise(other) if other else None))
        return out

    return _each_file(files, "php", "owner string, link_kind string, table_name string, column_name string, referenced_column_name string", rows)


def _marks_before(text: str, at: int) -> str:
    """The attributes right before a declaration."""
    head = text[:at].rstrip()
    marks = ""
    while head.endswith("]"):
        depth, i = 0, len(head)
        while i:
            i -= 1
            depth += {"]": 1, "[": -1}.get(head[i], 0)
            if not depth:
                break
        if head[i - 1 : i] != "#":
            break
        marks = head[i:] + marks
        head = head[: i - 1].rstrip()
    return marks
