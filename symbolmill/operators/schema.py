"""The schema catalog: counts, look-ups, foreign-key graph.

``tables`` has (repo_id, table_id, normalized_name), ``keys`` has (foreign_key_id,
table_id, normalized_target_table, source_columns, target_columns).

Edge cases: a key whose table is unknown belongs to no repository and is left out; null
names are no tables; keys to tables the index lacks are edges to nowhere, listed and not
followed; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.operators.traverse import reach


def key_edges(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, source_table, target_table, foreign_key_id)."""
    own = tables.select("table_id", "repo_id", F.col("normalized_name").alias("source_table")).dropDuplicates(["table_id"])
    rows = keys.select("foreign_key_id", "table_id", F.col("normalized_target_table").alias("target_table")).dropDuplicates(["foreign_key_id"])
    return rows.join(own, "table_id").filter("source_table is not null and target_table is not null").select("repo_id", "source_table", "target_table", "foreign_key_id")


def schema_counts(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """A3 per repository: tables, foreign keys, tables with keys and tables referred to, as pre-aggregates (no fan-out)."""
    edges = key_edges(tables, keys)
    n = tables.filter("normalized_name is not null").groupBy("repo_id").agg(F.countDistinct("normalized_name").alias("n_tables"))
    e = edges.groupBy("repo_id").agg(
        F.countDistinct("foreign_key_id").alias("n_keys"), F.countDistinct("source_table").alias("n_sources"), F.countDistinct("target_table").alias("n_targets")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_keys", "n_sources", "n_targets")]
    return n.join(e, "repo_id", "left").select("repo_id", "n_tables", *zero)


def table_summary(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """A4: outgoing and incoming keys of every table, by two pre-aggregates."""
    edges = key_edges(tables, keys)
    out = edges.groupBy("repo_id", F.col("source_table").alias("table_name")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy("repo_id", F.col("target_table").alias("table_name")).agg(F.count("*").alias("n_in"))
    names = tables.filter("normalized_name is not null").select("repo_id", F.col("normalized_name").alias("table_name")).distinct()
    joined = names.join(out, ["repo_id", "table_name"], "left").join(into, ["repo_id", "table_name"], "left")
    return joined.select("repo_id", "table_name", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"), F.coalesce("n_in", F.lit(0).cast("long")).alias("n_in"))


def match_rank(name: Column | str, query: str) -> Column:
    """0 for the name itself, 1 for ``schema.name``, 2 for a part of it, else null."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name == query, 0).when(F.endswith(name, F.lit("." + query)), 1).when(F.contains(name, F.lit(query)), 2)


def search_tables(tables: DataFrame, query: str) -> DataFrame:
    """(repo_id, table_name, match_rank) of tables that match."""
    rows = tables.filter("normalized_name is not null").select("repo_id", F.col("normalized_name").alias("table_name")).distinct()
    return rows.withColumn("match_rank", match_rank("table_name", query)).filter("match_rank is not null")


def key_neighbourhood(tables: DataFrame, keys: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(repo_id, table_name, depth) - undirected distance from the seed tables (repo_id, table_name) over known tables."""
    node = lambda c: F.concat_ws(":", F.col("repo_id").cast("string"), F.col(c))
    edges = key_edges(tables, keys).select(node("source_table").alias("src"), node("target_table").alias("dst")).distinct()
    known = tables.filter("normalized_name is not null").select(node("normalized_name").alias("dst")).distinct()
    edges = edges.join(known, "dst", "left_semi")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = reach(both, seeds.select(node("table_name").alias("node")), depth)
    return found.select(F.substring_index("node", ":", 1).cast("long").alias("repo_id"), F.expr("substring(node, instr(node, ':') + 1)").alias("table_name"), "depth")


def full_edges(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, source_table, source_columns, target_table, target_columns, foreign_key_id, constraint_name)."""
    more = keys.select("foreign_key_id", "constraint_name", *[F.transform(c, F.lower).alias(c) for c in ("source_columns", "target_columns")])
    return key_edges(tables, keys).join(more, "foreign_key_id").select("repo_id", "source_table", "source_columns", "target_table", "target_columns", "foreign_key_id", "constraint_name")


def graph_edges(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(repo_id, depth, direction, source_table, source_columns, target_table, target_columns): keys of the nodes (repo_id, table_name, depth) above ``depth``.

    A key seen from both ends is one row outbound and one inbound, each at its least depth; keys to tables the index lacks are listed as well.
    """
    near = nodes.filter(F.col("depth") < depth).select("repo_id", F.col("table_name").alias("node"), "depth")
    columns = ["source_table", "source_columns", "target_table", "target_columns"]
    sides = [
        edges.withColumn("node", F.col(end)).join(near, ["repo_id", "node"]).select("repo_id", "depth", F.lit(direction).alias("direction"), *columns)
        for end, direction in (("source_table", "outbound"), ("target_table", "inbound"))
    ]
    return sides[0].unionByName(sides[1]).groupBy("repo_id", "direction", *columns).agg(F.min("depth").alias("depth"))


def table_cards(tables: DataFrame, columns: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """R11/J8/C19 of every table: (repo_id, table_name, section, name, detail).

    Sections: ``file`` (path and first line of each definition), ``column`` (with its type), ``references`` and ``referenced_by`` (columns and the other end).
    """
    known = tables.filter("normalized_name is not null").select("repo_id", F.col("normalized_name").alias("table_name"), "file_id", "line_start")
    names = known.select("repo_id", "table_name").distinct()
    at = known.join(files.select("file_id", "path"), "file_id", "left").select("repo_id", "table_name", F.lit("file").alias("section"), F.coalesce("path", F.lit("?")).alias("name"), F.col("line_start").cast("string").alias("detail"))
    cols = columns.join(names, ["repo_id", "table_name"], "left_semi").select("repo_id", "table_name", F.lit("column").alias("section"), F.col("column_name").alias("name"), F.col("data_type").alias("detail"))
    way = F.concat(F.concat_ws(",", "source_columns"), F.lit(" -> "), F.col("target_table"), F.lit("("), F.concat_ws(",", "target_columns"), F.lit(")"))
    back = F.concat(F.col("source_table"), F.lit("("), F.concat_ws(",", "source_columns"), F.lit(") -> "), F.concat_ws(",", "target_columns"))
    out = edges.select("repo_id", F.col("source_table").alias("table_name"), F.lit("references").alias("section"), F.coalesce("constraint_name", F.lit("")).alias("name"), way.alias("detail"))
    into = edges.select("repo_id", F.col("target_table").alias("table_name"), F.lit("referenced_by").alias("section"), F.coalesce("constraint_name", F.lit("")).alias("name"), back.alias("detail"))
    into = into.join(names, ["repo_id", "table_name"], "left_semi")
    return at.unionByName(cols).unionByName(out).unionByName(into).distinct()


def find_table(tables: DataFrame, query: str) -> DataFrame:
    """Resolve table: (repo_id, table_name, match): the exact one per repository, else the sole one it ends, else all it ends as ``ambiguous``."""
    rows = search_tables(tables, query).filter("match_rank < 2")
    per = rows.groupBy("repo_id").agg(F.min("match_rank").alias("best"), F.count("*").alias("n"))
    kept = rows.join(per, "repo_id").filter("match_rank = best")
    return kept.select("repo_id", "table_name", F.when(F.col("best") == 0, "exact").when(F.col("n") == 1, "suffix").otherwise("ambiguous").alias("match"))


def catalog_tables(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Information-schema rows folded into one row per table with its columns by ordinal and its keys.

    ``columns``: (table_name, column_name, data_type, ordinal_position); ``keys``:
    (table_name, constraint_name, column_name, target_table, target_column, position).
    """
    cols = columns.dropDuplicates(["table_name", "column_name"]).groupBy("table_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "data_type"))), lambda x: F.struct(x["column_name"], x["data_type"])).alias("columns")
    )
    pairs = keys.groupBy("table_name", "constraint_name", "column_name", "target_table", "target_column").agg(F.min("position").alias("position"))
    folded = pairs.groupBy("table_name", "constraint_name", "target_table").agg(F.sort_array(F.collect_list(F.struct("position", "column_name", "target_column"))).alias("p"))
    fk = folded.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("constraint_name", "target_table", F.col("p.column_name").alias("source_columns"), F.col("p.target_column").alias("target_columns")))).alias("foreign_keys")
    )
    return cols.join(fk, "table_name", "left")
