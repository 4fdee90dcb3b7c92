"""SQL written in code lines, checked against the schema.

Lines that look like SQL are cut into blocks; in a block tables and aliases are bound, then
columns and join predicates are looked up: tables, columns and keys meet the lines in
equi-joins by repository and name, nothing is evaluated per line outside Spark.

Edge cases: comment lines count as they stand; an alias bound twice in a block means its last
table; words of SQL are no aliases; a bare column belongs to the block's primary table (the
last one read from, written or opened), or to its only table, else it is left out; joins whose
columns are unknown are left out; keys of several columns back no join; null lines and
repositories and empty tables give no rows; repeated findings count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import schema_name
from symbolmill.operators.lines import enclosing, sql_lines
from symbolmill.session import checkpointed

#: What binds a table, what names a column, words that are no aliases, and what makes a table the primary one.
TABLE_NAME = r"(?:[\"'`])?((?:[A-Za-z0-9_]+\.)?[A-Za-z0-9_]+)(?:[\"'`])?(?:\s+(?:as\s+)?([A-Za-z_][A-Za-z0-9_]*))?"
BINDINGS = (
    (r"(?i)\b(from|join|update|into|using)\s+(?:if\s+(?:not\s+)?exists\s+)?" + TABLE_NAME, 1, 2, 3),
    (r"(?i)\b(delete)\s+from\s+" + TABLE_NAME, 1, 2, 3),
    (r"(?i)(?:->|::)(from|join|leftjoin|rightjoin|innerjoin|crossjoin|table)\s*\(\s*([\"'`])([^\"'`]+)\2(?:\s*,\s*([\"'`])([^\"'`]+)\4)?", 1, 3, 5),
)
QUALIFIED = r"\b([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_*]*)\b"
JOIN_PAIR = r"\b([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\b"
INSERT_LIST = r"(?i)\binsert\s+into\b\s+(?:[\"'`])?(?:[A-Za-z0-9_]+\.)?[A-Za-z0-9_]+(?:[\"'`])?\s*\(([^)]+)\)"
ASSIGNED = r"(?<!\.)\b([A-Za-z_][A-Za-z0-9_]*)\b\s*="
COMPARED = r"(?i)(?:\bwhere\b|\band\b|\bor\b)\s+(?<!\.)\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:=|<>|!=|<|>|<=|>=|\blike\b|\bin\b|\bis\b)"
BUILDER_SET = r"(?i)->set\s*\(\s*([\"'`])([A-Za-z_][A-Za-z0-9_]*)\1"
NO_ALIASES = ("on", "where", "set", "values", "group", "order", "left", "right", "inner", "cross", "limit", "offset", "as")
PRIMARY = ("update", "into", "from", "table")

_AT = ["file_id", "repo_id", "block", "line_number"]


def _groups(pattern: str, *numbers: int) -> Column:
    """The groups of all matches in the line, as an array of structs ``g1``, ``g2``..."""
    arrays = [F.regexp_extract_all("line", F.lit(pattern), F.lit(n)).alias(f"g{i + 1}") for i, n in enumerate(numbers)]
    return F.arrays_zip(*arrays)


def _tables_bound(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(block, line, order, keyword, written, alias, table_name): every binding, ``table_name`` null if the schema lacks it."""
    def bindings(n: int, pattern: str, *groups: int) -> Column:
        return F.transform(_groups(pattern, *groups), lambda x, i: F.struct(F.lit(n).alias("p"), i.alias("i"), F.lower(x["g1"]).alias("keyword"), x["g2"].alias("written"), x["g3"].alias("alias")))

    found = [bindings(n, *b) for n, b in enumerate(BINDINGS)]
    binds = rows.select(*_AT, F.explode(F.concat(*found)).alias("b")).select(
        *_AT, F.struct("line_number", "b.p", "b.i").alias("order"), "b.keyword", "b.written", "b.alias", schema_name("b.written").alias("wanted")
    )
    return binds.join(known.withColumnRenamed("table_name", "wanted").withColumn("table_name", F.col("wanted")), ["repo_id", "wanted"], "left")


def _aliases(bound: DataFrame) -> DataFrame:
    """(file_id, block, alias, table_name): what a name means in a block, by its last binding."""
    clean = F.lower(F.regexp_replace(F.trim("alias"), "[\"'`]", ""))
    names = F.array(F.col("table_name"), F.substring_index("table_name", ".", -1), clean)
    rows = bound.filter("table_name is not null").select("file_id", "block", "order", "table_name", F.posexplode(names).alias("k", "alias"))
    rows = rows.filter(F.col("alias").isNotNull() & (F.col("alias") != "") & ~F.col("alias").isin(*NO_ALIASES))
    return rows.groupBy("file_id", "block", "alias").agg(F.max_by("table_name", F.struct("order", "k")).alias("table_name"))


def validate(lines: DataFrame, tables: DataFrame, columns: DataFrame, keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line_number, kind, subject, symbol_id) of what SQL in the lines names, and whether the schema has it.

    ``lines``: (file_id, repo_id, line_number, line); ``tables``: (repo_id, table_name); ``columns``: (repo_id,
    table_name, column_name); ``keys``: (repo_id, source_table, source_columns, target_table, target_columns).
    kind is missing_table, unresolved_alias, verified_column, missing_column, verified_join or missing_fk.
    """
    rows = checkpointed(sql_lines(lines))  # met by every check below
    known = tables.filter("repo_id is not null and table_name is not null").select("repo_id", "table_name").distinct()
    cols = columns.select("repo_id", "table_name", F.lower("column_name").alias("column_name")).distinct()
    bound = _tables_bound(rows, known)
    aliases = _aliases(bound)
    missing = bound.filter("table_name is null").select(*_AT, F.lit("missing_table").alias("kind"), F.col("wanted").alias("subject"))

    real = bound.filter("table_name is not null").groupBy("file_id", "block")
    blocks = real.agg(F.max_by("table_name", F.when(F.col("keyword").isin(*PRIMARY), F.col("order"))).alias("p"), F.countDistinct("table_name").alias("n"), F.min("table_name").alias("only"))
    blocks = blocks.select("file_id", "block", F.coalesce("p", F.when(F.col("n") == 1, F.col("only"))).alias("table_name")).filter("table_name is not null")

    named = rows.select(*_AT, F.explode(_groups(QUALIFIED, 1, 2)).alias("q")).select(*_AT, F.lower("q.g1").alias("alias"), F.lower("q.g2").alias("column_name"))
    named = named.join(aliases, ["file_id", "block", "alias"], "left")
    unresolved = named.filter("table_name is null").select(*_AT, F.lit("unresolved_alias").alias("kind"), F.concat_ws(".", "alias", "column_name").alias("subject"))

    listed = F.transform(F.split(F.regexp_extract("line", INSERT_LIST, 1), ","), lambda x: F.regexp_replace(x, "[\"'`\\s]", ""))
    bare = F.concat(listed, *[F.regexp_extract_all("line", F.lit(p), F.lit(g)) for p, g in ((ASSIGNED, 1), (COMPARED, 1), (BUILDER_SET, 2))])
    bare = rows.select(*_AT, F.explode(F.array_distinct(F.transform(bare, F.lower))).alias("column_name")).filter(F.col("column_name") != "")
    bare = bare.filter(~F.col("column_name").isin(*NO_ALIASES)).join(blocks, ["file_id", "block"])

    used = named.filter("table_name is not null").select(*_AT, "table_name", "column_name").unionByName(bare.select(*_AT, "table_name", "column_name")).distinct()
    checked = used.join(cols.withColumn("k", F.lit(True)), ["repo_id", "table_name", "column_name"], "left")
    column_rows = checked.select(*_AT, F.when(F.col("k"), "verified_column").otherwise("missing_column").alias("kind"), F.concat_ws(".", "table_name", "column_name").alias("subject"))

    pairs = rows.select(*_AT, F.explode(_groups(JOIN_PAIR, 1, 2, 3, 4)).alias("q")).select(*_AT, *[F.lower(f"q.g{i + 1}").alias(c) for i, c in enumerate(("a_alias", "a_column", "b_alias", "b_column"))])
    for side in ("a", "b"):
        to = aliases.select("file_id", "block", F.col("alias").alias(f"{side}_alias"), F.col("table_name").alias(f"{side}_table"))
        has = cols.select("repo_id", F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"))
        pairs = pairs.join(to, ["file_id", "block", f"{side}_alias"]).join(has, ["repo_id", f"{side}_table", f"{side}_column"], "left_semi")
    ends = ["repo_id", "a_table", "a_column", "b_table", "b_column"]
    backed = pairs.join(single_keys(keys).withColumn("k", F.lit(True)), ends, "left")
    equal = F.concat(F.concat_ws(".", "a_table", "a_column"), F.lit(" = "), F.concat_ws(".", "b_table", "b_column"))
    join_rows = backed.select(*_AT, F.when(F.col("k"), "verified_join").otherwise("missing_fk").alias("kind"), equal.alias("subject"))

    found = missing.unionByName(unresolved).unionByName(column_rows).unionByName(join_rows).select("file_id", "line_number", "kind", "subject").distinct()
    return found.join(enclosing(found, symbols), ["file_id", "line_number"], "left")


def single_keys(keys: DataFrame) -> DataFrame:
    """(repo_id, a_table, a_column, b_table, b_column) of keys with one column, in both directions (a union, where an OR would be no equi-join)."""
    one = keys.filter("size(source_columns) = 1 and size(target_columns) = 1").select(
        "repo_id", F.col("source_table").alias("a_table"), F.lower(F.col("source_columns")[0]).alias("a_column"), F.col("target_table").alias("b_table"), F.lower(F.col("target_columns")[0]).alias("b_column")
    )
    turned = one.select("repo_id", F.col("b_table").alias("a_table"), F.col("b_column").alias("a_column"), F.col("a_table").alias("b_table"), F.col("a_column").alias("b_column"))
    return one.unionByName(turned).distinct()
