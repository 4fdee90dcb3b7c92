"""Registered queries of the general problems (1 to 3) and their SQL."""

from __future__ import annotations

from symbolmill.catalog import read
from symbolmill.operators.changefeed import current_columns, current_keys, current_schema
from symbolmill.operators.heavykeys import fresh_reference_counts, heavy_targets, target_statistics
from symbolmill.operators.orphans import orphans_by_period, reference_orphans


def p1_found(spark, d):
    tables = ("symbols", "external_symbols", "symbol_references", "db_tables", "db_foreign_keys")
    return reference_orphans(*(read(spark, d, t) for t in tables))


def p1_by_period(spark, d):
    return orphans_by_period(p1_found(spark, d))


def p2_found(spark, d):
    return current_schema(read(spark, d, "sql_statements"))


def p2_columns(spark, d):
    return current_columns(read(spark, d, "sql_statements"))


def p2_keys(spark, d):
    return current_keys(read(spark, d, "sql_statements"))


def p3_found(spark, d):
    return heavy_targets(target_statistics(read(spark, d, "symbol_references"))).select("target_qualified_name")


def p3_targets(spark, d):
    rows = target_statistics(read(spark, d, "symbol_references"))
    return rows.filter("target is not null").withColumnRenamed("target", "target_qualified_name")


def p3_reference_counts(spark, d):
    return fresh_reference_counts(read(spark, d, "module_symbols"), target_statistics(read(spark, d, "symbol_references")))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p2_found, p2_columns, p2_keys, p3_found, p3_targets, p3_reference_counts)}

_KEY = r"lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\\', ''))"
_NAME = "array_to_string(list_filter(list_transform(string_split(regexp_replace(trim({0}), '^[`\"\\[\\]]+|[`\"\\[\\]]+$', '', 'g'), '.'), lambda p: lower(trim(regexp_replace(trim(p), '^[`\"\\[\\]]+|[`\"\\[\\]]+$', '', 'g')))), lambda p: p <> ''), '.')"

_P1 = f"""
WITH names AS (
  SELECT symbol_id, {_KEY.format('qualified_name')} AS k, indexed_at AS born, coalesce(removed_at, TIMESTAMP '9999-12-31') AS died FROM symbols
  UNION ALL
  SELECT symbol_id, {_KEY.format('qualified_name')}, TIMESTAMP '0001-01-01', TIMESTAMP '9999-12-31' FROM external_symbols),
known AS (SELECT DISTINCT k FROM names WHERE k IS NOT NULL),
refs AS (SELECT DISTINCT reference_id, {_KEY.format('target_qualified_name')} AS k, target_symbol_id, recorded_at FROM symbol_references),
fks AS (
  SELECT DISTINCT f.foreign_key_id, coalesce(f.normalized_target_table, {_NAME.format('f.target_table')}) AS k, o.repo_id, f.recorded_at
  FROM db_foreign_keys f LEFT JOIN (SELECT table_id, min(repo_id) AS repo_id FROM db_tables GROUP BY 1) o USING (table_id)),
cand AS (
  SELECT 'symbol_references' AS ref_table, 'target_qualified_name' AS ref_field, r.reference_id AS ref_id, r.recorded_at, n.born, n.died
  FROM refs r LEFT JOIN known e ON e.k = r.k
  LEFT JOIN names n ON n.k = CASE WHEN e.k IS NOT NULL THEN r.k ELSE split_part(r.k, '::', 1) END
  WHERE r.k IS NOT NULL
  UNION ALL
  SELECT 'symbol_references', 'target_symbol_id', r.reference_id, r.recorded_at, n.born, n.died
  FROM refs r LEFT JOIN names n ON n.symbol_id = r.target_symbol_id WHERE r.target_symbol_id IS NOT NULL
  UNION ALL
  SELECT 'db_foreign_keys', 'normalized_target_table', f.foreign_key_id, f.recorded_at, t.indexed_at, coalesce(t.removed_at, TIMESTAMP '9999-12-31')
  FROM fks f LEFT JOIN db_tables t ON t.normalized_name = f.k AND t.repo_id = f.repo_id WHERE f.k IS NOT NULL),
cases AS (
  SELECT ref_table, ref_field, ref_id,
    CASE WHEN count(born) = 0 THEN 'missing' WHEN min(born) <= recorded_at THEN 'deleted' ELSE 'late' END AS cause,
    strftime(recorded_at, '%Y-%m') AS period
  FROM cand GROUP BY ref_table, ref_field, ref_id, recorded_at
  HAVING count(*) FILTER (WHERE born <= recorded_at AND died > recorded_at) = 0)
"""
_P3 = f"""
WITH refs AS (SELECT DISTINCT reference_id, {_KEY.format('target_qualified_name')} AS t, source_symbol_id, reference_kind FROM symbol_references),
stats AS (SELECT t, count(*) AS n_references, count(DISTINCT source_symbol_id) AS n_sources, count(DISTINCT reference_kind) AS n_kinds FROM refs GROUP BY t)
"""

SQL = {
    "p1_found": _P1 + "SELECT ref_table, ref_field, ref_id, cause, period FROM cases",
    "p1_by_period": _P1 + "SELECT ref_table, ref_field, cause, period, count(*) AS n_references FROM cases GROUP BY ALL",
    "p3_found": _P3 + "SELECT t AS target_qualified_name FROM stats WHERE t IS NOT NULL AND n_references >= 0.01 * (SELECT sum(n_references) FROM stats)",
    "p3_targets": _P3 + "SELECT t AS target_qualified_name, n_references, n_sources, n_kinds FROM stats WHERE t IS NOT NULL",
    "p3_reference_counts": _P3
    + f"""SELECT m.module_path, m.qualified_name, m.kind, m.stored_count, CAST(coalesce(o.n, 0) AS BIGINT) AS reference_count
FROM (SELECT DISTINCT module_path, qualified_name, kind, reference_count AS stored_count FROM module_symbols) m
LEFT JOIN (SELECT split_part(t, '::', 1) AS k, sum(n_references) AS n FROM stats GROUP BY 1) o ON o.k = {_KEY.format('m.qualified_name')}""",
}
