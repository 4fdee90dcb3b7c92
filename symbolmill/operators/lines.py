"""Lines of text: enclosing symbols, windows, blocks and direct table references.

Lines come from an explode next to the scan. Only what names a line leaves it: joins are
by file (and token), windows by file - units a source file bounds.

Edge cases: null contents have no lines; any line end counts; numbers start at 1; a line
no symbol covers has none; ties between symbols go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def file_lines(files: DataFrame, unique: bool = True) -> DataFrame:
    """(file_id, path, line_number, line) of all files.

    ``unique`` drops repeated deliveries first, which moves whole contents (by file_id,
    as the windows below need them anyway). Operators whose result is a set of lines do
    without and drop repeats from the little they find.
    """
    kept = [c for c in ("file_id", "repo_id", "path") if c in files.columns]
    rows = files.select(*kept, "content").filter(F.col("content").isNotNull())
    if unique:
        rows = rows.dropDuplicates(["file_id"])
    parts = F.split("content", "\r\n|\r|\n", -1)
    return rows.select(*kept, F.posexplode(parts).alias("i", "line")).select(*kept, (F.col("i") + 1).alias("line_number"), "line")


def files_with(files: DataFrame, text: str) -> DataFrame:
    """Files that hold ``text`` in any case: only their lines are worth exploding when lines with it are asked for."""
    return files.filter(F.contains(F.lower("content"), F.lit(text.lower())))


def line_count(content: Column | str) -> Column:
    """Pieces between newlines; a closing newline counts one more."""
    return F.size(F.split(content, "\n", -1))


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line_number, symbol_id) - the innermost symbol around each distinct point, null if there is none.

    Methods and functions first, then the smaller span, the earlier start, the smaller id.
    """
    points = points.select("file_id", "line_number").distinct()
    spans = symbols.select("file_id", "symbol_id", "line_start", "line_end", F.when(F.col("kind").isin("method", "function"), 0).otherwise(1).alias("rank"))
    hit = points.join(spans, "file_id").filter(F.col("line_number").between(F.col("line_start"), F.col("line_end")))
    best = hit.groupBy("file_id", "line_number").agg(F.min(F.struct("rank", (F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "symbol_id")).alias("b"))
    return points.join(best.select("file_id", "line_number", "b.symbol_id"), ["file_id", "line_number"], "left")


def comment_only(line: Column | str) -> Column:
    """F9."""
    return F.regexp_like(F.trim(line), F.lit(r"^(?://|#|/\*|\*)"))


def write_context(lines: DataFrame, needle: str) -> DataFrame:
    """Lines with ``needle`` and whether one of [line - 2, line + 1] writes."""
    w = W.partitionBy("file_id").orderBy("line_number")
    text = F.concat_ws("\n", F.lag("line", 2).over(w), F.lag("line", 1).over(w), F.col("line"), F.lead("line", 1).over(w))
    hit = lines.withColumn("around", text).filter(F.contains(F.lower("line"), F.lit(needle.lower())))
    return hit.select("file_id", "line_number", F.regexp_like("around", F.lit(r"(?i)\b(update|insert|set|delete)\b|->(save|persist|update|insert)\(")).alias("is_write"))


#: What makes a line SQL, and what ends a block behind or before a line.
SQL_LINE = (
    r"(?i)\b(select|from|join|update|insert|delete|where|set|values|on|using)\b|->(?:from|join|leftJoin|rightJoin|innerJoin|crossJoin|table|set)\s*\("
    r"|\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_*]*\b"
)
STATEMENT_BREAK = r";\s*(?:$|[\"'`)]|\+)"
SCOPE_BREAK = r"(?i)^\s*(?:public|protected|private|final|abstract)?\s*(?:static\s+)?function\b|^\s*class\b|^\s*interface\b|^\s*trait\b"


def sql_lines(lines: DataFrame) -> DataFrame:
    """(file_id, repo_id, block, line_number, line): lines that look like SQL, in blocks (``repo_id`` if the lines have it).

    A block ends before the head of a function or class, at a line that is no SQL and behind
    the end of a statement. Only SQL lines reach the window; a gap between them is a line that is none.
    """
    w = W.partitionBy("file_id").orderBy("line_number")
    kept = [c for c in ("file_id", "repo_id", "line_number", "line") if c in lines.columns]
    rows = lines.filter(F.regexp_like("line", F.lit(SQL_LINE))).select(*kept)
    ended = F.lag(F.regexp_like("line", F.lit(STATEMENT_BREAK)), 1, False).over(w)
    gap = F.coalesce(F.lag("line_number").over(w) + 1 != F.col("line_number"), F.lit(True))
    rows = rows.withColumn("fresh", (gap | ended | F.regexp_like("line", F.lit(SCOPE_BREAK))).cast("int"))
    return rows.withColumn("block", F.sum("fresh").over(w)).drop("fresh")


def sql_blocks(lines: DataFrame) -> DataFrame:
    """(file_id, first_line, last_line, n_lines) of the blocks of SQL."""
    rows = sql_lines(lines).groupBy("file_id", "block")
    return rows.agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.count("*").alias("n_lines")).drop("block")


#: What a table's name may look like, and the five ways to refer to one, in this order ({0} is the name).
TABLE_TOKEN = r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*"
TABLE_REFERENCES = {
    "sql_clause": r"(?i)\b(?:from|join|update|into|table|using)\s+(?:if\s+(?:not\s+)?exists\s+)?(?:[\"'`])?(?:[A-Za-z0-9_]+\.)?{0}(?:[\"'`])?(?=$|[\s,;\)\]])",
    "query_builder_call": r"(?i)(?:->|::|\b)(?:from|join|leftjoin|rightjoin|innerjoin|crossjoin|table)\s*\(\s*([\"'`]){0}\1",
    "table_assignment": r"(?i)(?:[\"'`]?\b(?:table|table_name|tablename|dbtable|source_table|sourcetable)\b[\"'`]?|\$[A-Za-z_][A-Za-z0-9_]*table[A-Za-z0-9_]*)\s*(?:=>|:|=)\s*([\"'`]){0}\1",
    "quoted_literal": r"(?i)([\"'`]){0}\1",
    "quoted_return": r"(?i)\breturn\b\s*(?:\(?\s*)?([\"'`]){0}\1",
}


def direct_table_references(lines: DataFrame, tables: DataFrame, symbols: DataFrame, is_test: Column) -> DataFrame:
    """(file_id, line_number, table_name, kind, symbol_id) - tables of the repository in code lines, each once per line.

    ``lines`` has (file_id, repo_id, path, line_number, line). Tokens of lines that could refer
    to a table meet names in an equi-join; only what is left is matched against the patterns of its
    own name. Quoted literals count in tests only, quoted returns only in symbols named after a table.
    """
    names = tables.filter("normalized_name is not null").select("repo_id", F.col("normalized_name").alias("table_name")).distinct()
    could = F.regexp_like("line", F.lit(r"(?i)[\"'`]|\b(?:from|join|update|into|table|using)\s"))
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(TABLE_TOKEN), F.lit(0)), F.lower))
    rows = lines.filter(~comment_only("line") & could).select("file_id", "repo_id", "line_number", "line", is_test.alias("is_test"), F.explode(tokens).alias("table_name"))
    hit = rows.join(names, ["repo_id", "table_name"])
    name = F.replace("table_name", F.lit("."), F.lit("\\."))

    def matches(kind: str) -> Column:
        before, after = TABLE_REFERENCES[kind].split("{0}")
        return F.rlike("line", F.concat(F.lit(before), name, F.lit(after)))

    kind = F.lit(None).cast("string")
    for k in reversed(TABLE_REFERENCES):
        kind = F.when(matches(k) & F.col("is_test") if k == "quoted_literal" else matches(k), k).otherwise(kind)
    # classified inside the aggregation: as a plain filter the patterns would be pushed below the join, to every token
    found = hit.groupBy("file_id", "line_number", "table_name").agg(F.max(kind).alias("kind")).filter("kind is not null")
    inner = enclosing(found, symbols).join(symbols.select("symbol_id", F.col("qualified_name").alias("q")), "symbol_id", "left")
    leaf = F.lower(F.coalesce(F.substring_index("q", "::", -1), F.lit("")))
    kept = (F.col("kind") != "quoted_return") | F.contains(leaf, F.lit("table"))
    return found.join(inner, ["file_id", "line_number"], "left").filter(kept).select("file_id", "line_number", "table_name", "kind", "symbol_id")


def search_content(lines: DataFrame, needle: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` lines with ``needle`` in order of path, file and line (a top-k, not a cap on the search)."""
    hit = lines.filter(F.contains(F.lower("line"), F.lit(needle.lower()))).select("file_id", "path", "line_number", "line").distinct()
    return hit.orderBy("path", "file_id", "line_number").limit(limit).select("file_id", "path", "line_number", F.trim("line").alias("preview"))
