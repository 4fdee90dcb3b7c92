"""Schema of a live PostgreSQL database through JDBC (S8, S9), and its settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from symbolmill.operators.schema import catalog_tables

_COLUMNS = """SELECT c.table_name, c.column_name, c.data_type, c.ordinal_position FROM information_schema.columns c
JOIN information_schema.tables t USING (table_schema, table_name) WHERE t.table_type = 'BASE TABLE' AND c.table_schema = 'public'"""
#: Columns of composite keys are paired by position, so they do not multiply.
_KEYS = """SELECT k.table_name, k.constraint_name, k.column_name, u.table_name AS target_table, u.column_name AS target_column, k.ordinal_position AS position
FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r USING (constraint_schema, constraint_name)
JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name
AND u.ordinal_position = k.position_in_unique_constraint WHERE k.table_schema = 'public'"""


def settings(overrides: Mapping[str, str | None], config: Mapping[str, str | None], env: Mapping[str, str]) -> dict[str, str]:
    """Overrides before configuration before environment before defaults."""
    default = {"host": "localhost", "port": "5432", "database": "postgres", "user": "postgres", "password": ""}
    names = {"host": "PGHOST", "port": "PGPORT", "database": "PGDATABASE", "user": "PGUSER", "password": "PGPASSWORD"}
    return {k: str(overrides.get(k) or config.get(k) or env.get(names[k]) or v) for k, v in default.items()}


def read_schema(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Tables with columns and keys; the joins are pushed to the database. Needs its JDBC driver on the class path."""
    url = f"jdbc:postgresql://{options['host']}:{options['port']}/{options['database']}"
    reader = spark.read.format("jdbc").options(url=url, user=options["user"], password=options["password"], driver="org.postgresql.Driver")
    return catalog_tables(reader.option("query", _COLUMNS).load(), reader.option("query", _KEYS).load())
