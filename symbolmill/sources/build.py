"""Building the index from source trees: files to tables that all queries read.

Identifiers are 64-bit hashes of what a record is (a repository's name, a path in it, a name and line
in a file), so a record keeps its id from run to run and no counter is shared between tasks.

Edge cases: a path found under several roots is that of the last root; files that are
empty or of other languages have no symbols; names without a symbol stay unresolved; symbols
of one name in one line count once; repositories that are gone keep their rows until written anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolmill import catalog
from symbolmill.operators import extract
from symbolmill.operators.resolve import resolve_references
from symbolmill.sources.files import discover

#: Metadata by the names that queries read.
_METADATA = {
    "is_static": "static", "is_abstract": "abstract", "thrown_exceptions": "thrownExceptions", "caught_exceptions": "caughtExceptions", "documented_throws": "documentedThrows",
    "context_args": "contextArgs", "context_params": "contextParams",
}


def repositories(spark: SparkSession, roots: Mapping[str, str], stored: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, name, created_at, last_indexed_at): found by name or made, the index time set to now."""
    now = F.current_timestamp().cast("timestamp_ntz")
    rows = spark.createDataFrame([(n, p) for n, p in roots.items()], "name string, path string").withColumn("repo_id", F.xxhash64("name"))
    first = rows.withColumn("created_at", now)
    if stored is not None:
        first = rows.join(stored.select("repo_id", F.col("created_at").alias("old")), "repo_id", "left").withColumn("created_at", F.coalesce("old", now))
    return first.select("repo_id", "path", "name", "created_at", now.alias("last_indexed_at"))


def source_files(spark: SparkSession, roots: Mapping[str, str], additional: Mapping[str, str] | None = None, exclude: Sequence[str] = (), languages: Sequence[str] = ("php", "sql")) -> DataFrame:
    """(file_id, repo_id, path, language, hash, source_label, lines_of_code, last_indexed_at, content) of all repositories."""
    parts = [discover(spark, root, additional, exclude, languages).withColumn("name", F.lit(name)) for name, root in roots.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    label = F.when(F.startswith("path", F.lit("@")), F.expr("substring(substring_index(path, '/', 1), 2)")).otherwise("repo")
    rows = rows.withColumn("repo_id", F.xxhash64("name"))
    return rows.select(
        F.xxhash64("repo_id", "path").alias("file_id"), "repo_id", "path", "language", "hash", label.alias("source_label"), "lines_of_code",
        F.current_timestamp().cast("timestamp_ntz").alias("last_indexed_at"), "content",
    )


def index_tables(files: DataFrame) -> dict[str, DataFrame]:
    """All tables that follow from ``files``, by name."""
    now = F.current_timestamp().cast("timestamp_ntz")
    never = F.lit(None).cast("timestamp_ntz")
    times = [now.alias("indexed_at"), never.alias("removed_at")]
    found = extract.php_symbols(files)
    named = found.withColumn("symbol_id", F.xxhash64("file_id", "kind", F.lower("qualified_name"), "line_start")).dropDuplicates(["symbol_id"])
    parents = named.filter(F.col("kind").isin("class", "interface", "trait", "enum")).groupBy("file_id", F.col("qualified_name").alias("parent_name")).agg(F.min("symbol_id").alias("parent_symbol_id"))
    metadata = F.struct(*[_plain(F.col(f"metadata.{old}"), old).alias(new) for new, old in _METADATA.items()]).alias("metadata")
    symbols = named.join(parents, ["file_id", "parent_name"], "left").select(
        "symbol_id", "file_id", "kind", "name", "qualified_name", "visibility", "parent_symbol_id", "line_start", "line_end", "signature", "return_type", "docblock", metadata, *times
    )
    sources = symbols.groupBy("file_id", F.lower("qualified_name").alias("source_key")).agg(F.min("symbol_id").alias("source_symbol_id"), F.min_by("name", "symbol_id").alias("source_symbol_name"))
    refs = extract.php_references(files).withColumn("source_key", F.lower("source_name")).join(sources, ["file_id", "source_key"], "left")
    refs = refs.withColumn("reference_id", F.xxhash64("file_id", "source_name", "target_qualified_name", "reference_kind", "line_number")).dropDuplicates(["reference_id"])
    resolved = resolve_references(refs, symbols).select("reference_id", F.col("resolved_symbol_id").alias("target_symbol_id"))
    references = refs.join(resolved, "reference_id", "left").select(
        "reference_id", "source_symbol_id", "source_symbol_name", "target_qualified_name", "target_symbol_id", "reference_kind", "line_number", now.alias("recorded_at"), now.alias("loaded_at")
    )
    table_id = F.xxhash64("file_id", "table_name")
    columns = extract.ddl_columns(files).withColumn("table_id", table_id)
    where = files.select("file_id", "repo_id")
    tables = columns.groupBy("table_id", "file_id", "table_name").agg(F.min("line_start").alias("line_start"), F.max("line_number").alias("line_end")).join(where, "file_id")
    keys = extract.ddl_keys(files).withColumn("table_id", table_id)
    keys = keys.withColumn("foreign_key_id", F.xxhash64("table_id", "constraint_name", F.concat_ws(",", "source_columns"), "target_table", F.concat_ws(",", "target_columns")))
    statements = extract.sql_statements(files).join(files.select("file_id", "repo_id", "path"), "file_id")
    return {
        "files": files, "symbols": symbols, "symbol_references": references,
        "db_tables": tables.select("table_id", "repo_id", "file_id", "table_name", F.col("table_name").alias("normalized_name"), "line_start", "line_end", *times),
        "db_columns": columns.select("table_id", "column_name", "data_type", "is_nullable", "default_value", "ordinal_position", "line_number"),
        "db_foreign_keys": keys.select("foreign_key_id", "table_id", "constraint_name", "source_columns", "target_table", F.col("target_table").alias("normalized_target_table"), "target_columns",
            F.col("line_start").alias("line_number"), now.alias("recorded_at"), now.alias("loaded_at")).dropDuplicates(["foreign_key_id"]),
        "sql_statements": statements.select("repo_id", "path", F.lit(1).alias("delivery_no"), now.alias("delivered_at"), "line_start", "text"),
    }


def _plain(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(False)) if name in ("static", "abstract") else value


def build_catalog(
    spark: SparkSession, roots: Mapping[str, str], folder: str, additional: Mapping[str, str] | None = None, exclude: Sequence[str] = (), languages: Sequence[str] = ("php", "sql")
) -> list[str]:
    """Writes the index of repositories (name to root) to ``folder``; every query runs on it. Returns the names of the tables.

    The files are written first and read back, so all tables derive from the same contents.
    """
    catalog.write(source_files(spark, roots, additional, exclude, languages), folder, "files")
    catalog.write(repositories(spark, roots), folder, "repos")
    tables = index_tables(catalog.read(spark, folder, "files"))
    catalog.write(tables["symbols"], folder, "symbols")
    for name, df in tables.items():
        if name not in ("files", "symbols"):
            catalog.write(df, folder, name)
    return ["repos", *tables]
