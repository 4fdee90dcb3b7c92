"""Where symbols, tables and columns are used.

Tokens of lines meet names in equi-joins; a symbol's lines are gathered per symbol up to
the span that is previewed. Edge cases: symbols without lines, tables nobody names and
empty inputs give no rows; ties go to the smaller value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.operators.lines import comment_only, enclosing
from symbolmill.operators.reports import layer_of
from symbolmill.operators.traverse import outermost, reach, reverse


#: Lines of a method that is previewed at most, lines shown.
MOST_LINES, SHOWN = 40, 8


def body_previews(files: DataFrame, symbols: DataFrame, most_lines: int = MOST_LINES, shown: int = SHOWN) -> DataFrame:
    """(symbol_id, preview) of methods up to ``most_lines``: the first lines after the declaration, trimmed, without blanks and lone braces."""
    spans = symbols.filter("kind = 'method' and line_start is not null and line_end - line_start <= " + str(most_lines)).select("symbol_id", "file_id", "line_start", "line_end")
    # a method's own lines are cut out of its file, so a file's lines never meet all its methods
    lines = files.select("file_id", F.split("content", "\r\n|\r|\n", -1).alias("lines")).filter("lines is not null")
    own = F.transform(F.slice("lines", F.greatest(F.col("line_start"), F.lit(0)) + 1, F.greatest(F.col("line_end") - F.greatest(F.col("line_start"), F.lit(0)), F.lit(0))), lambda t: F.trim(t))
    body = spans.join(lines, "file_id").select("symbol_id", F.filter(own, lambda t: ~t.isin("", "{", "}")).alias("b")).filter("size(b) > 0")
    kept = F.slice("b", 1, shown)
    return body.select("symbol_id", F.array_join(F.when(F.size("b") > shown, F.concat(kept, F.array(F.lit("...")))).otherwise(kept), "\n").alias("preview"))


def symbol_card(symbols: DataFrame, references: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of the chosen symbols (node): out of them and their direct children, and into them.

    (node, section, via_symbol_id, other, reference_kind, n): ``other`` is the target's name, or the source's id as text.
    """
    owners = chosen.select("node", F.col("node").alias("owner")).unionByName(
        symbols.select(F.col("parent_symbol_id").alias("node"), F.col("symbol_id").alias("owner")).join(chosen.select("node"), "node", "left_semi")
    )
    out = references.join(owners.withColumnRenamed("owner", "source_symbol_id"), "source_symbol_id").select(
        "node", F.lit("out").alias("section"), F.col("source_symbol_id").alias("via_symbol_id"), F.col("target_qualified_name").alias("other"), "reference_kind"
    )
    into = references.join(chosen.select("node", F.col("node").alias("target_symbol_id")), "target_symbol_id").select(
        "node", F.lit("in").alias("section"), F.col("node").alias("via_symbol_id"), F.col("source_symbol_id").cast("string").alias("other"), "reference_kind"
    )
    every = out.unionByName(into)
    return every.groupBy(*every.columns).agg(F.count("*").alias("n"))


def table_usage(refs: DataFrame, files: DataFrame, symbols: DataFrame, is_test: Column) -> DataFrame:
    """(table_name, layer, is_test, owner, path, kind, line_number): the first direct reference of each table in each symbol, or file outside symbols.

    ``refs`` are ``direct_table_references``; ``owner`` is the symbol's name, null outside symbols.
    """
    at = files.select("file_id", "path", is_test.alias("is_test"))
    rows = refs.join(at, "file_id").join(symbols.select("symbol_id", F.col("qualified_name").alias("owner")), "symbol_id", "left")
    first = rows.groupBy("table_name", "is_test", "owner", "path").agg(F.min(F.struct("line_number", "kind")).alias("f"))
    return first.select("table_name", layer_of("path", "owner").alias("layer"), "is_test", "owner", "path", "f.kind", "f.line_number")


def column_mentions(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines naming a column (table_name, column_name) in files that name its table: (file_id, line_number, table_name, column_name)."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))
    words = lines.filter(~comment_only("line")).select("file_id", "line_number", F.explode(tokens).alias("token"))
    known = columns.select("table_name", "column_name").distinct()
    touching = words.join(known.select(F.col("table_name").alias("token")).distinct(), "token").select("file_id", F.col("token").alias("table_name")).distinct()
    named = words.join(known.withColumnRenamed("column_name", "token"), "token").select("file_id", "line_number", "table_name", F.col("token").alias("column_name"))
    return named.join(touching, ["file_id", "table_name"], "left_semi").distinct().select("file_id", "line_number", "table_name", "column_name")


def literal_sql_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that SQL in code lines reads or writes, and whether the catalog has them: (file_id, line_number, table_name, is_known)."""
    named = F.regexp_extract_all(F.lower("line"), F.lit(r"\b(?:from|join|into|update)\s+[`\"\[]?([a-z_][a-z0-9_.]*)"), F.lit(1))
    is_sql = F.regexp_like("line", F.lit(r"(?i)\b(select\s.+\sfrom|insert\s+into|update\s+\S+\s+set|delete\s+from)\b"))
    rows = lines.filter(is_sql & ~comment_only("line")).select("file_id", "line_number", F.explode(F.array_distinct(named)).alias("table_name"))
    known = tables.filter("normalized_name is not null").select(F.col("normalized_name").alias("table_name")).distinct().withColumn("k", F.lit(True))
    return rows.join(known, "table_name", "left").select("file_id", "line_number", "table_name", F.coalesce("k", F.lit(False)).alias("is_known")).distinct()


def dedup_seeds(seeds: DataFrame, key: str, weight: str, payload: str) -> DataFrame:
    """The heaviest row per key, ties to the smaller payload; a fold with map-side combine."""
    best = seeds.groupBy(key).agg(F.min(F.struct((-F.col(weight)).alias("w"), payload)).alias("b"))
    return best.select(key, (-F.col("b.w")).alias(weight), F.col(f"b.{payload}").alias(payload))


def merge_hints(hints: DataFrame, keys: Sequence[str], once_per_reason: bool = True) -> DataFrame:
    """Scores (keys, reason, score) summed per key with the distinct reasons; a reason counts once or each time."""
    rows = hints.groupBy(*keys, "reason").agg(F.max("score").alias("score")) if once_per_reason else hints
    return rows.groupBy(*keys).agg(F.sum("score").alias("score"), F.sort_array(F.collect_set("reason")).alias("reasons"))


def requirements(reached: DataFrame, keys: DataFrame) -> DataFrame:
    """Least depth of each context key (node, context_key) over the nodes reached (node, depth)."""
    return reached.join(keys, "node").groupBy("context_key").agg(F.min("depth").alias("depth"))


def upstream_touchpoints(points: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, layer: Column, bridges: Sequence[str], depth: int = 3) -> DataFrame:
    """Symbols that reach the given lines (file_id, line_number) from outside: (symbol_id, depth).

    Lines lead to their innermost symbol and its outermost container; containers in a
    bridging layer start at depth 1, and users of them (or of their containers) follow.
    """
    inner = enclosing(points, symbols).filter("symbol_id is not null").select(F.col("symbol_id").alias("node")).distinct()
    tops = outermost(symbols.select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent")))
    at = symbols.select(F.col("symbol_id").alias("top"), "file_id").join(files.select("file_id", layer.alias("layer")), "file_id")
    seeds = inner.join(tops, "node").select("top").distinct().join(at, "top").filter(F.col("layer").isin(*bridges)).select(F.col("top").alias("node"))
    lift = symbols.filter("parent_symbol_id is not null").select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent"))
    found = reach(reverse(edges), seeds, depth, lift=lift)
    return found.select(F.col("node").alias("symbol_id"), (F.col("depth") + 1).alias("depth"))
