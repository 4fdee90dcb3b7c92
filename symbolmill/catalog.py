"""Typed access to the tables of the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOL_KINDS = ("class", "interface", "trait", "method", "function", "property", "constant", "enum")
TOP_LEVEL_KINDS = ("class", "interface", "trait", "enum", "function")
REFERENCE_KINDS = (
    "inheritance", "implementation", "trait_use", "instantiation", "static_call",
    "type_hint", "self_call", "static_access", "class_reference",
)

METADATA = (
    "STRUCT<extends: STRING, implements: ARRAY<STRING>, traits: ARRAY<STRING>, static: BOOLEAN, abstract: BOOLEAN, "
    "magic: BOOLEAN, readonly: BOOLEAN, promoted: BOOLEAN, contextArgs: ARRAY<STRING>, contextParams: ARRAY<STRING>, "
    "thrownExceptions: ARRAY<STRING>, caughtExceptions: ARRAY<STRING>, documentedThrows: ARRAY<STRING>>"
)

#: The thirteen tables of the index, as DDL; ``metadata`` of symbols is the struct above.
SCHEMAS: dict[str, str] = {
    "repos": "id LONG, path STRING, name STRING, created_at TIMESTAMP, last_indexed_at TIMESTAMP",
    "files": "id LONG, repo_id LONG, path STRING, language STRING, hash STRING, last_indexed_at TIMESTAMP, lines_of_code INT, content STRING",
    "symbols": "id LONG, file_id LONG, kind STRING, name STRING, qualified_name STRING, visibility STRING, parent_symbol_id LONG, "
    "line_start INT, line_end INT, signature STRING, return_type STRING, docblock STRING, metadata " + METADATA,
    "symbol_references": "id LONG, source_symbol_id LONG, target_qualified_name STRING, target_symbol_id LONG, reference_kind STRING, line_number INT",
    "db_tables": "id LONG, file_id LONG, name STRING, normalized_name STRING, line_start INT, line_end INT",
    "db_columns": "id LONG, table_id LONG, name STRING, normalized_name STRING, data_type STRING, is_nullable BOOLEAN, "
    "default_value STRING, ordinal_position INT, line_number INT",
    "db_foreign_keys": "id LONG, table_id LONG, constraint_name STRING, source_columns ARRAY<STRING>, target_table STRING, "
    "normalized_target_table STRING, target_columns ARRAY<STRING>, line_number INT",
    "db_current_tables": "id LONG, repo_id LONG, source_file_id LONG, name STRING, normalized_name STRING, line_start INT, line_end INT",
    "db_current_columns": "id LONG, table_id LONG, source_file_id LONG, name STRING, normalized_name STRING, data_type STRING, "
    "is_nullable BOOLEAN, default_value STRING, ordinal_position INT, line_number INT",
    "db_current_foreign_keys": "id LONG, table_id LONG, source_file_id LONG, constraint_name STRING, source_columns ARRAY<STRING>, "
    "target_table STRING, normalized_target_table STRING, target_columns ARRAY<STRING>, line_number INT",
    "symbol_table_links": "source_symbol_id LONG, table_name STRING, normalized_table_name STRING, link_kind STRING",
    "symbol_column_links": "source_symbol_id LONG, table_name STRING, normalized_table_name STRING, column_name STRING, "
    "normalized_column_name STRING, referenced_column_name STRING, normalized_referenced_column_name STRING, link_kind STRING",
    "direct_table_references": "source_file_id LONG, source_symbol_id LONG, table_name STRING, normalized_table_name STRING, "
    "reference_kind STRING, line_number INT, preview STRING",
}


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One Parquet table of the folder ``base``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{base}/{table}.parquet")


def read_spread(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table whose texts are parsed: a scan with fewer splits than cores is dealt out over them.

    Large tables have more splits than that and are read as they lie, without a shuffle.
    """
    df = read(spark, base, table)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty catalog table with its declared schema."""
    return spark.createDataFrame([], SCHEMAS[table])


def write(df: DataFrame, base: str, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a catalog table; with ``partition_by`` only the partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(f"{base}/{table}.parquet")
