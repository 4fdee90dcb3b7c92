"""Generated, minified, vendored and bulk-data source files (problem 5).

Every file gets layout statistics over its whole content - maximum and mean line
length, white-space share, alphanumeric share (of what is no white space), numeric-literal
density, long encoded runs and how far its lines repeat a template - and thresholds tuned
per language turn them into verdicts (minified, data, packed text, generated by template).
What the statistics cannot see (a tool or a third party may write as people do) is read from two places that only describe the file itself: its path with its
source label, and the comments before its first and after its last code (a string, or a
comment amid code, that speaks of generated code is no sign). Vendored files are those in folders or sources
for third-party code, or whose leading comment or PHP namespace is that of a package in
``external_symbols``; packages meet files by equi-joins, so neither side is collected.

Edge cases: null and empty contents are judged by path alone; null languages take the
default thresholds; null paths and labels are no sign; any line ends; very long files
are read whole; repeated rows give one verdict; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FEATURES = (
    "file_id long, language string, path string, source_label string, n_chars long, n_lines long, max_line long, mean_line double, "
    "space_share double, alnum_share double, number_density double, encoded_share double, template_share double, "
    "tool_comment boolean, package_names array<string>, namespace string"
)

#: Thresholds per language; the default holds for others. Each lies between the extremes measured over files that people
#: wrote and files that tools made, which differ by language: hand-written SQL has longer lines and more letters and
#: digits than the rest, TypeScript denser ones than PHP, and Python repeats its lines least.
THRESHOLDS: dict[str, dict[str, float]] = {
    "default": {"max_line": 300, "mean_line": 200, "space_share": 0.07, "number_density": 0.40, "encoded_share": 0.50, "alnum_low": 0.35, "alnum_high": 0.93, "template_share": 0.25},
    "php": {"max_line": 300, "mean_line": 180, "space_share": 0.075, "number_density": 0.40, "encoded_share": 0.45, "alnum_low": 0.35, "alnum_high": 0.92, "template_share": 0.33},
    "typescript": {"max_line": 300, "mean_line": 160, "space_share": 0.085, "number_density": 0.30, "encoded_share": 0.40, "alnum_low": 0.40, "alnum_high": 0.90, "template_share": 0.30},
    "python": {"max_line": 300, "mean_line": 170, "space_share": 0.09, "number_density": 0.30, "encoded_share": 0.40, "alnum_low": 0.40, "alnum_high": 0.90, "template_share": 0.35},
    "sql": {"max_line": 800, "mean_line": 300, "space_share": 0.06, "number_density": 0.25, "encoded_share": 0.50, "alnum_low": 0.40, "alnum_high": 0.93, "template_share": 0.25},
}
#: Shares are taken as if so many ordinary characters (lines) stood beside the text: little text proves little, at any size.
PRIOR_CHARS, PRIOR_LINES, PRIOR_ALNUM = 200, 4, 0.6

_LINE = re.compile(r"\r\n|\r|\n")
_HEAD = re.compile(
    r"(?:﻿|\s+|#![^\r\n]*|<\?php\b|<\?(?!=)|declare\s*\(\s*strict_types\s*=\s*\d\s*\)\s*;|//[^\r\n]*|#(?!\[)[^\r\n]*|--[^\r\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?''')*",
    re.S,
)
_COMMENT = re.compile(r"//([^\r\n]*)|#(?!\[)([^\r\n]*)|--([^\r\n]*)|/\*(.*?)\*/|\"\"\"(.*?)\"\"\"|'''(.*?)'''", re.S)
#: What tools write at the top of their output, in the languages of the corpus. A comment is one only if it
#: says so of the file: it begins with the phrase, or names the tool or the ban on editing along with it.
_TOOL = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated|auto-?generated\b|automatically\s+generated|machine[- ]generated|(?:code|file|source)\s+(?:auto-?matically\s+)?generated\s+(?:by|from|with)"
    r"|this\s+(?:file|code|class|module|script)\s+(?:was|is|has\s+been)\s+(?:automatically\s+|auto-?)?(?:generated|produced|created|compiled|built)\s+(?:automatically\s+)?(?:by|from|with)"
    r"|generated\s+(?:by|from|with|using|at|on)\b"
    r"|(?:diese\s+datei|dieser\s+(?:code|quelltext))\s+(?:wurde|ist|wird)\b.*\b(?:erzeugt|generiert|erstellt)"
    r"|automatisch\s+(?:erzeugt|generiert|erstellt)"
    r"|(?:ce\s+)?(?:fichier|code)\s+(?:est\s+|a\s+été\s+)?(?:généré|produit|créé)(?:\s+automatiquement)?\s+par"
    r"|(?:este\s+)?(?:archivo|fichero|código)\s+(?:fue\s+|ha\s+sido\s+|es\s+)?(?:generado|producido|creado)(?:\s+automáticamente)?\s+por)"
    r"|\bdo\s+not\s+(?:edit|modify)\b.*\bgenerated|\bgenerated\b.*\bdo\s+not\s+(?:edit|modify)\b|\b(?:ne\s+pas\s+(?:modifier|éditer)|no\s+(?:editar|modificar)|nicht\s+(?:bearbeiten|ändern|editieren))\b",
    re.I | re.S,
)
_LAST = re.compile(r"(?://|#|--)(.*)$")
_PACKAGE = re.compile(
    r"\(c\)\s+(?:the\s+)?([\w.-]+/[\w.-]+)\s+(?:contributors|authors|developers|team)|(?:file|terms\s+shipped|licen[cs]e)\s+(?:of|with)\s+(?:the\s+)?([\w-]+/[\w-]+)"
    r"|part\s+of\s+(?:the\s+)?([\w.-]+/[\w.-]+)(?:\s+package|\s+library|\s+project|[.,\s]|$)|copied\s+from\s+(?:the\s+)?([\w.-]+/[\w.-]+)",
    re.I,
)
_NAMESPACE = re.compile(r"^[ \t]*(?:<\?php\s+)?namespace\s+\\?([\w\\]+)\s*[;{]", re.M)
_ENCODED = re.compile(r"[A-Za-z0-9+/_=-]{60,}|(?:\\x[0-9A-Fa-f]{2}){15,}|(?:\\u[0-9A-Fa-f]{4}){10,}|(?:\\[0-7]{2,3}){15,}")
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w$])")
_VARYING = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")
#: Letters and digits; every character beyond ASCII counts as one.
_ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def layout(text: str) -> tuple[int, int, int, float, float, float, float, float, float]:
    """(characters, lines, longest and mean line, shares: white space, letters and digits, numbers, encoded runs, templates).

    Shares but for white space are those of the text with the prior beside it.
    """
    lines = [x for x in _LINE.split(text) if x.strip()]
    n = len(text)
    if not lines:
        return n, 0, 0, 0.0, 1.0, PRIOR_ALNUM, 0.0, 0.0, 1.0
    longest = max(map(len, lines))
    dense = sum(map(len, text.split()))
    data = text.encode("utf-8", "surrogatepass")
    signs = len(b"".join(data.translate(None, _ALNUM).split()))
    letters = len(b"".join(data.split())) - signs
    numbers = sum(map(len, _NUMBER.findall(text)))
    encoded = sum(len(m[0]) for m in _ENCODED.finditer(text)) if longest >= 60 else 0
    templates = len({_VARYING.sub("0", x.strip()) for x in lines})
    return (
        n, len(lines), longest, sum(map(len, lines)) / len(lines), 1 - dense / n, (letters + PRIOR_ALNUM * PRIOR_CHARS) / (letters + signs + PRIOR_CHARS),
        numbers / (dense + PRIOR_CHARS), encoded / (dense + PRIOR_CHARS), (templates + PRIOR_LINES) / (len(lines) + PRIOR_LINES),
    )


def head_comments(text: str) -> list[str]:
    """The comments before the first code."""
    head = _HEAD.match(text)
    return [next((g for g in m.groups() if g is not None), "") for m in _COMMENT.finditer(head[0])] if head else []


def closing_comments(text: str) -> list[str]:
    """The line comments after the last code."""
    out = []
    for line in reversed(_LINE.split(text.rstrip())):
        m = _LAST.match(line)
        if not m:
            break
        out.append(m[1])
    return out


def file_features(files: DataFrame) -> DataFrame:
    """Layout statistics and self-descriptions of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(12)]
            for text in batch.column("content").to_pylist():
                text = text or ""
                notes = head_comments(text)
                names = [next(g for g in m if g).lower().strip(".") for note in notes for m in _PACKAGE.findall(note)]
                tool = any(_TOOL.search(line.strip(" \t*!")) for note in notes for line in _LINE.split(note))
                tool = tool or any(_TOOL.search(line.strip(" \t*!")) for line in closing_comments(text))
                ns = _NAMESPACE.search(text)
                for c, v in zip(cols, (*layout(text), tool, list(dict.fromkeys(names)), ns[1] if ns else None), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.float64()] * 6 + [pa.bool_(), pa.list_(pa.string()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names_ = [x.split()[0] for x in _FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("file_id", "language", "path", "source_label")] + arrays, names_)

    return files.select(F.col("file_id").cast("long"), "language", "path", "source_label", "content").mapInArrow(run, _FEATURES)


def _limit(name: str) -> Column:
    """The threshold of the row's language."""
    value = F.lit(float(THRESHOLDS["default"][name]))
    for language, limits in THRESHOLDS.items():
        if limits[name] != THRESHOLDS["default"][name]:
            value = F.when(F.lower("language") == language, F.lit(float(limits[name]))).otherwise(value)
    return value


def layout_verdicts() -> dict[str, Column]:
    """Named conditions over the statistics."""
    above = lambda c: F.col(c) >= _limit(c)
    below = lambda c: F.col(c) <= _limit(c)
    return {
        "minified": below("space_share") & above("max_line") & above("mean_line"),
        "numbers": above("number_density"),
        "encoded": above("encoded_share"),
        "packed": (F.col("alnum_share") <= _limit("alnum_low")) | (F.col("alnum_share") >= _limit("alnum_high")),
        "template": below("template_share"),
    }


_FOREIGN_PATH = r"(?:^|/)(?:vendor|vendors|vendored|node_modules|bower_components|third[-_]?party|external|externals)/"
_FOREIGN_LABEL = r"(?i)^(?:vendor|third[-_]?party|external)|vendor[-_]mirror"
_TOOL_PATH = r"(?:^|/)(?:[Gg]enerated|__generated__|__CG__|autogen)/|(?:^|/)(?:var|storage|bootstrap|tmp|temp)/cache/|^\.?cache/|\.(?:pb|pb2|generated|g|gen|designer)\.\w+$|_pb2(?:_grpc)?\.py$"
_MINIFIED_PATH = r"(?i)\.(?:min|bundle)\.\w+$"


def foreign_files(files: DataFrame, external: DataFrame) -> DataFrame:
    """(file_id, reasons) of files that nobody wrote by hand in that repository."""
    rows = file_features(files)
    inner = F.regexp_replace(F.coalesce("path", F.lit("")), r"^@[^/]*/", "")
    label = F.coalesce("source_label", F.regexp_extract(F.coalesce("path", F.lit("")), r"^@([^/]*)/", 1))
    packages = external.filter(F.col("package_name").isNotNull()).select(F.lit("package comment").alias("reason"), F.lower("package_name").alias("value"))
    # the packages' own namespaces, from the names of their symbols
    spaces = external.filter(F.instr("qualified_name", "\\") > 0).select(
        F.lit("package namespace").alias("reason"), F.lower(F.substring_index(F.regexp_replace("qualified_name", r"^\\", ""), "\\", 2)).alias("value")
    )
    known = packages.unionByName(spaces).distinct().withColumn("known", F.lit(True))
    tests = layout_verdicts() | {
        "vendored path": F.regexp_like(inner, F.lit(_FOREIGN_PATH)) | F.regexp_like(label, F.lit(_FOREIGN_LABEL)),
        "tool path": F.regexp_like(inner, F.lit(_TOOL_PATH)),
        "minified path": F.regexp_like(inner, F.lit(_MINIFIED_PATH)),
        "tool comment": F.col("tool_comment"),
    }
    # signs that speak for themselves have no value; the others count if the value is a package's
    sign = lambda reason, value: F.struct(F.lit(reason).alias("reason"), value.alias("value"))
    plain = F.array_compact(F.array(*[F.when(c, sign(n, F.lit(None).cast("string"))) for n, c in tests.items()]))
    named = F.transform("package_names", lambda p: sign("package comment", p))
    spaced = F.array_compact(F.array(F.when(F.col("namespace").isNotNull(), sign("package namespace", F.lower(F.substring_index("namespace", "\\", 2))))))
    signs = rows.select("file_id", F.explode(F.concat(plain, named, spaced)).alias("s")).select("file_id", "s.reason", "s.value")
    judged = signs.join(known, ["reason", "value"], "left").filter(F.col("value").isNull() | F.col("known"))
    return judged.groupBy("file_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
