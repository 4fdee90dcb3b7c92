"""Registered queries of the index operators and their SQL.

Every query reads whole tables; a limit occurs only where it is the operator (top-k).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolmill.catalog import read, read_spread
from symbolmill.operators import compare as C
from symbolmill.operators import extract as X
from symbolmill.operators import lines as L
from symbolmill.operators import reports as R
from symbolmill.operators import schema as S
from symbolmill.operators import sqlcheck as Q
from symbolmill.operators import testing as T
from symbolmill.operators import traverse as G
from symbolmill.operators import usage as U
from symbolmill.operators.changefeed import current_columns, current_keys
from symbolmill.operators.resolve import current, resolve_references
from symbolmill.plans.index_sql import SQL

__all__ = ["QUERIES", "SQL"]


def files_of(spark, d):
    return read(spark, d, "files").dropDuplicates(["file_id"])


def symbols_of(spark, d):
    return current(read(spark, d, "symbols"), "symbol_id")


def references_of(spark, d):
    return read(spark, d, "symbol_references").dropDuplicates(["reference_id"])


def tables_of(spark, d):
    return current(read(spark, d, "db_tables"), "table_id")


def keys_of(spark, d):
    return read(spark, d, "db_foreign_keys").dropDuplicates(["foreign_key_id"])


def resolve(spark, d):
    return resolve_references(references_of(spark, d), symbols_of(spark, d)).select("reference_id", "resolved_symbol_id", "how")


def dependents_direct(spark, d):
    own = symbols_of(spark, d).select(F.col("symbol_id").alias("source_symbol_id"), "file_id")
    refs = references_of(spark, d).filter("target_symbol_id is not null")
    rows = refs.join(own, "source_symbol_id").join(files_of(spark, d).select("file_id", "path"), "file_id")
    return rows.select("target_symbol_id", "path", "source_symbol_id", "reference_kind", "line_number").distinct()


def _edges(spark, d, kinds=None):
    return G.symbol_edges(read(spark, d, "symbol_references"), kinds)


def _hub(edges):
    return G.busiest(edges, "dst")


def dependents_min_depth(spark, d):
    edges = _edges(spark, d)
    return G.reach(G.reverse(edges), _hub(edges), 4, seed_seen=False).select(F.col("node").alias("symbol_id"), "depth")


def dependents_paths(spark, d):
    edges = _edges(spark, d)
    return G.shortest_paths(G.reverse(edges), _hub(edges), 3).select(F.col("node").alias("symbol_id"), "depth", "n_paths")


def deps_forward(spark, d):
    edges = _edges(spark, d)
    return G.reach(edges, G.busiest(edges, "src"), 6).select(F.col("node").alias("symbol_id"), "depth")


def flow_calls(spark, d):
    edges = _edges(spark, d, G.CALL_KINDS)
    return G.reach(edges, G.busiest(edges, "src"), 10).select(F.col("node").alias("symbol_id"), "depth")


def deps_tree(spark, d):
    """All dependencies of the busiest symbol, three steps deep, unknown targets as leaves."""
    owned = G.owned_references(read(spark, d, "symbol_references"), symbols_of(spark, d))
    return G.tree(owned, G.busiest(owned, "src"), 3)


def flow_tree(spark, d):
    """The calls of the busiest symbol, five steps deep, through inherited and overridden methods."""
    symbols = symbols_of(spark, d)
    owned = G.owned_references(read(spark, d, "symbol_references"), symbols)
    calls = G.flow_references(owned, symbols)
    return G.tree(calls, G.busiest(calls, "src"), 5, first_kinds=G.CALL_KINDS)


def blast_radius(spark, d):
    files, symbols, edges = files_of(spark, d), symbols_of(spark, d), _edges(spark, d)
    seeds = symbols.join(G.busiest(symbols, "file_id").withColumnRenamed("node", "file_id"), "file_id").select(F.col("symbol_id").alias("node"))
    return R.blast_radius(files, symbols, G.reach(G.reverse(edges), seeds, 3, seed_seen=False))


def blast_radius_top(spark, d):
    return R.blast_top(blast_radius(spark, d))


def find_in_path(spark, d):
    return C.find(symbols_of(spark, d), files_of(spark, d), "find*", kind="method", path="app/", limit=50)


def climb_usage(spark, d):
    edges = _edges(spark, d)
    lift = symbols_of(spark, d).filter("parent_symbol_id is not null").select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent"))
    return G.reach(G.reverse(edges), _hub(edges), 3, lift=lift).select(F.col("node").alias("symbol_id"), "depth")


def top_level_container(spark, d):
    nodes = symbols_of(spark, d).select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent"))
    return G.outermost(nodes).select(F.col("node").alias("symbol_id"), F.col("top").alias("top_symbol_id"), F.col("height").cast("int").alias("height"))


def exception_summary(spark, d):
    return G.exception_summary(symbols_of(spark, d))


def fk_graph_bfs(spark, d):
    tables, keys = tables_of(spark, d), keys_of(spark, d)
    seeds = S.table_summary(tables, keys).orderBy(F.desc("n_in"), "repo_id", "table_name").limit(1)
    return S.key_neighbourhood(tables, keys, seeds, 5)


def schema_counts(spark, d):
    return S.schema_counts(tables_of(spark, d), keys_of(spark, d))


def table_summary(spark, d):
    return S.table_summary(tables_of(spark, d), keys_of(spark, d))


def table_search(spark, d):
    return S.search_tables(tables_of(spark, d), "tariff")


def fk_join_check(spark, d):
    """Join predicates of code lines, and whether a key backs them."""
    return sql_validate(spark, d).filter(F.col("kind").isin("verified_join", "missing_fk")).groupBy("kind", "subject").agg(F.count("*").alias("n_lines"))


def _code_lines(spark, d):
    return L.file_lines(read_spread(spark, d, "files").filter("language <> 'sql'"))


def _key_columns(spark, d):
    """Columns the index knows of: those its foreign keys name on either side."""
    edges = S.full_edges(tables_of(spark, d), keys_of(spark, d))
    sides = [edges.select("repo_id", F.col(f"{end}_table").alias("table_name"), F.explode(f"{end}_columns").alias("column_name")) for end in ("source", "target")]
    return sides[0].unionByName(sides[1]).filter("column_name is not null").distinct()


def sql_validate(spark, d):
    """SQL in code against the tables and keys of the index, and the columns these keys name."""
    tables = tables_of(spark, d).select("repo_id", F.col("normalized_name").alias("table_name"))
    return Q.validate(_code_lines(spark, d), tables, _key_columns(spark, d), S.full_edges(tables_of(spark, d), keys_of(spark, d)), symbols_of(spark, d))


def sql_validate_replayed(spark, d):
    """SQL in code against the schema that the migration scripts lead to."""
    statements = read(spark, d, "sql_statements")
    columns = current_columns(statements)
    keys = current_keys(statements).withColumnRenamed("table_name", "source_table")
    return Q.validate(_code_lines(spark, d), columns.select("repo_id", "table_name").distinct(), columns, keys, symbols_of(spark, d))


def table_cards(spark, d):
    edges = S.full_edges(tables_of(spark, d), keys_of(spark, d))
    columns = _key_columns(spark, d).withColumn("data_type", F.lit(None).cast("string"))
    return S.table_cards(tables_of(spark, d), columns, edges, files_of(spark, d))


def table_cards_replayed(spark, d):
    """Cards of the tables in the index, with the columns that the migration scripts lead to."""
    edges = S.full_edges(tables_of(spark, d), keys_of(spark, d))
    return S.table_cards(tables_of(spark, d), current_columns(read(spark, d, "sql_statements")), edges, files_of(spark, d))


def table_graph_edges(spark, d):
    edges = S.full_edges(tables_of(spark, d), keys_of(spark, d))
    return S.graph_edges(edges, fk_graph_bfs(spark, d), 5)


def find_table(spark, d):
    return S.find_table(tables_of(spark, d), "tariff")


def test_targets(spark, d):
    """Tests likely to cover the symbol that most references name."""
    files, symbols, edges = files_of(spark, d), symbols_of(spark, d), _edges(spark, d)
    known = edges.join(symbols.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
    hub = _hub(known)
    own = hub.join(symbols.withColumnRenamed("symbol_id", "node"), "node").join(files.select("file_id", "path"), "file_id").select("node", "name", "qualified_name", "path").first()
    if own is None:
        return spark.createDataFrame([], "path string, score long, reasons string")
    reached = G.reach(G.reverse(edges), hub, 2, seed_seen=False)
    at = reached.join(symbols.select(F.col("symbol_id").alias("node"), "file_id", "qualified_name"), "node").join(files.select("file_id", "path"), "file_id").select("path", "qualified_name", "depth")
    tests = files.filter(R.is_test_path("path"))
    name = own.name or ""
    lines = L.file_lines(tests.filter("lower(content) like " + repr("%" + name.lower().replace("'", "") + "%")))
    hints = T.content_hints(lines, name, own.qualified_name).unionByName(
        at.filter(R.is_test_path("path") & (F.col("depth") <= 1)).select("path", F.lit("references").alias("reason"), F.lit(T.REFERENCES).alias("score")).distinct()
    )
    return T.rank_tests(tests, T.seeds_of(at.filter(~R.is_test_path("path")), own.path, name), hints)


def planned_layers(spark, d):
    rows = symbols_of(spark, d).filter("parent_symbol_id is null and name is not null").join(files_of(spark, d).select("file_id", "path"), "file_id")
    return rows.groupBy(R.planned_layer("name", "path").alias("layer")).agg(F.count("*").alias("n_symbols"))


def line_counts(spark, d):
    rows = files_of(spark, d).filter("content is not null")
    return rows.groupBy("language").agg(F.count("*").alias("n_files"), F.sum(L.line_count("content")).alias("n_lines"), F.count_if(F.sha2("content", 256) == F.col("hash")).alias("n_hash_equal"))


def enclosing_symbol(spark, d):
    symbols = symbols_of(spark, d)
    own = symbols.select(F.col("symbol_id").alias("source_symbol_id"), "file_id")
    points = references_of(spark, d).filter("line_number is not null").join(own, "source_symbol_id").select("file_id", "line_number")
    return L.enclosing(points, symbols)


def search_content(spark, d):
    return L.search_content(L.file_lines(L.files_with(read_spread(spark, d, "files"), "snapshot"), unique=False), "snapshot")


def line_write_context(spark, d):
    return L.write_context(L.file_lines(L.files_with(read_spread(spark, d, "files"), "payload")), "payload")


def block_segments(spark, d):
    return L.sql_blocks(L.file_lines(read_spread(spark, d, "files")))


def comment_lines(spark, d):
    rows = L.file_lines(read_spread(spark, d, "files"))
    return rows.groupBy("file_id").agg(F.count("*").alias("n_lines"), F.count_if(L.comment_only("line")).alias("n_comment_lines"))


def table_refs(spark, d):
    """Direct references to tables in code: a repository's lines against its tables."""
    code = L.file_lines(read_spread(spark, d, "files").filter("language <> 'sql'"), unique=False)
    return L.direct_table_references(code, tables_of(spark, d), symbols_of(spark, d), R.is_test_path("path"))


def table_refs_sql(spark, d):
    """The same references in SQL files, which direct references of code leave out."""
    scripts = L.file_lines(read_spread(spark, d, "files").filter("language = 'sql'"), unique=False)
    return L.direct_table_references(scripts, tables_of(spark, d), symbols_of(spark, d), R.is_test_path("path"))


def status(spark, d):
    return R.status(files_of(spark, d), symbols_of(spark, d), references_of(spark, d))


def unresolved_categories(spark, d):
    symbols = symbols_of(spark, d)
    sources = symbols.select(F.col("symbol_id").alias("source_symbol_id"), "file_id").join(files_of(spark, d).select("file_id", "path"), "file_id").select("source_symbol_id", "path")
    return R.unresolved_categories(references_of(spark, d), sources, read(spark, d, "external_symbols"), R.namespace_prefixes(symbols))


def source_labels(spark, d):
    return R.source_labels(files_of(spark, d))


def namespace_prefixes(spark, d):
    return R.namespace_prefixes(symbols_of(spark, d))


def module_stats(spark, d):
    return R.module_stats(files_of(spark, d), symbols_of(spark, d))


def module_table(spark, d):
    return R.module_table(files_of(spark, d), symbols_of(spark, d), references_of(spark, d))


def module_dependencies(spark, d):
    return R.module_dependencies(files_of(spark, d), symbols_of(spark, d), references_of(spark, d))


def layer_violations(spark, d):
    return R.layer_violations(files_of(spark, d), symbols_of(spark, d), references_of(spark, d))


def external_namespaces(spark, d):
    return R.external_namespaces(references_of(spark, d))


def kind_counts(spark, d):
    return R.kind_counts(references_of(spark, d))


def interface_adoption(spark, d):
    return R.interface_adoption(files_of(spark, d), symbols_of(spark, d), references_of(spark, d))


def naming_ratios(spark, d):
    return R.naming_ratios(symbols_of(spark, d))


def freshness(spark, d):
    return R.freshness(read(spark, d, "repos"), F.lit("2026-01-01 00:00:00"))


def _kin_pairs(spark, d):
    """Each symbol with the symbols of the index it extends, implements or uses."""
    rows = references_of(spark, d).filter(F.col("reference_kind").isin("inheritance", "implementation", "trait_use"))
    tops = symbols_of(spark, d).select("symbol_id", F.coalesce("parent_symbol_id", "symbol_id").alias("top"))
    pairs = rows.filter("target_symbol_id is not null").select("source_symbol_id", "target_symbol_id")
    pairs = pairs.join(tops.select(F.col("symbol_id").alias("source_symbol_id"), F.col("top").alias("a")), "source_symbol_id")
    pairs = pairs.join(tops.select(F.col("symbol_id").alias("target_symbol_id"), F.col("top").alias("b")), "target_symbol_id")
    return pairs.filter("a <> b").select("a", "b").distinct()


def compare_members(spark, d):
    return C.compare_members(_kin_pairs(spark, d), C.member_names(symbols_of(spark, d)))


def missing_everywhere(spark, d):
    return C.missing_everywhere(_kin_pairs(spark, d), C.member_names(symbols_of(spark, d)))


def find_symbols(spark, d):
    return C.find_symbols(symbols_of(spark, d), "find%ledger")


def suggest_symbols(spark, d):
    return C.suggest_symbols(symbols_of(spark, d), "FindLedgerEntry", 20)


def name_tokens(spark, d):
    rows = symbols_of(spark, d).filter("name is not null").select(F.explode(C.name_tokens("name")).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n_symbols"))


def tested_areas(spark, d):
    return C.tested_areas(files_of(spark, d), R.is_test_path("path"))


def route_pairs(spark, d):
    folders = read(spark, d, "files").select(F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), "/", "\\\\").alias("name"))
    return C.route_pairs(folders, 3)


def route_families(spark, d):
    """Pairs of nested and flat classes below the folder ``app``."""
    return C.family_pairs(C.route_families(symbols_of(spark, d), files_of(spark, d), "app"))


def changeset(spark, d):
    files = files_of(spark, d)
    cut = F.lit("2025-07-01").cast("timestamp_ntz")
    stored = files.filter(F.col("last_indexed_at") < cut).select("repo_id", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    return C.changeset(stored, files.filter("content is not null and content <> ''").select("repo_id", "path", "hash"))


def php_symbols_all(spark, d):
    """Symbols read from the sources of all files, with all that is read of them."""
    return X.php_symbols(read_spread(spark, d, "files")).distinct()


def php_symbols(spark, d):
    """Comparison of ``php_symbols_all`` with the index: places of symbols in files that ``symbols`` has rows of."""
    found = X.php_symbols(read_spread(spark, d, "files")).select("file_id", "kind", "line_start", "line_end").distinct()
    return found.join(read(spark, d, "symbols").select("file_id").distinct(), "file_id", "left_semi")


def php_references(spark, d):
    return X.php_references(read_spread(spark, d, "files")).distinct().groupBy("reference_kind").agg(F.count("*").alias("n_references"), F.countDistinct("target_qualified_name").alias("n_targets"))


def ddl_columns(spark, d):
    return X.ddl_columns(read_spread(spark, d, "files")).distinct()


def ddl_keys(spark, d):
    """Keys that the statements of all deliveries declare, each once."""
    texts = read(spark, d, "sql_statements").select("text").distinct()
    rows = X.ddl_keys(texts.select(F.lit(0).alias("file_id"), F.lit("sql").alias("language"), F.col("text").alias("content")))
    return rows.drop("file_id", "line_start").distinct()


def ddl_tables_all(spark, d):
    """Tables that the SQL files of the index create, beside those its catalog lists of SQL files: which side has each."""
    files = read_spread(spark, d, "files")
    made = X.ddl_columns(files).select("file_id", "table_name").distinct().withColumn("made", F.lit(True))
    own = read(spark, d, "files").filter("lower(language) = 'sql' and content <> ''").select("file_id").distinct()
    listed = read(spark, d, "db_tables").select("file_id", F.col("normalized_name").alias("table_name")).filter("table_name is not null").distinct()
    listed = listed.join(own, "file_id", "left_semi").withColumn("listed", F.lit(True))
    sides = [F.coalesce(c, F.lit(False)).alias(c) for c in ("made", "listed")]
    return made.join(listed, ["file_id", "table_name"], "full_outer").select("file_id", "table_name", *sides)


def ddl_tables(spark, d):
    """Tables that the SQL files of the index create and its catalog lists, by name; ``ddl_tables_all`` has the others."""
    made = X.ddl_columns(read_spread(spark, d, "files")).select("file_id", "table_name").distinct()
    return made.join(read(spark, d, "db_tables").select("file_id", F.col("normalized_name").alias("table_name")).distinct(), ["file_id", "table_name"], "left_semi")


def sql_file_statements(spark, d):
    return X.sql_statements(read_spread(spark, d, "files")).distinct().groupBy("file_id").agg(F.count("*").alias("n_statements"), F.max("line_start").alias("last_line"))


def body_previews(spark, d):
    return U.body_previews(files_of(spark, d), symbols_of(spark, d))


def symbol_card(spark, d):
    edges = _edges(spark, d)
    return U.symbol_card(symbols_of(spark, d), references_of(spark, d), G.busiest(edges, "src"))


def table_usage(spark, d):
    return U.table_usage(table_refs(spark, d), files_of(spark, d), symbols_of(spark, d), R.is_test_path("path"))


def column_mentions(spark, d):
    own = tables_of(spark, d).select("table_id", F.col("normalized_name").alias("table_name"))
    columns = keys_of(spark, d).select("table_id", F.explode("source_columns").alias("c")).join(own, "table_id").select("table_name", F.lower("c").alias("column_name"))
    return U.column_mentions(L.file_lines(read_spread(spark, d, "files"), unique=False), columns.filter("table_name is not null"))


def literal_sql_tables(spark, d):
    code = read_spread(spark, d, "files").filter("language <> 'sql'")
    return U.literal_sql_tables(L.file_lines(code, unique=False), read(spark, d, "db_tables"))


def seed_dedup(spark, d):
    """The kind of reference each file makes most."""
    own = symbols_of(spark, d).select(F.col("symbol_id").alias("source_symbol_id"), "file_id")
    counted = references_of(spark, d).join(own, "source_symbol_id").groupBy("file_id", "reference_kind").agg(F.count("*").alias("weight"))
    return U.dedup_seeds(counted, "file_id", "weight", "reference_kind")


def context_requirements(spark, d):
    """Context keys that code within four steps of the busiest symbol reads, at their least depth."""
    edges = _edges(spark, d, ("class_reference", "inheritance"))
    read_keys = X.context_keys(read_spread(spark, d, "files"))
    keys = symbols_of(spark, d).select(F.col("symbol_id").alias("node"), "file_id").join(read_keys, "file_id").select("node", "context_key").distinct()
    return U.requirements(G.reach(edges, G.busiest(edges, "src"), 4), keys)


def upstream_touchpoints(spark, d):
    """Symbols that reach lines with literal SQL through the outer layers."""
    code = L.file_lines(read_spread(spark, d, "files").filter("language <> 'sql'"), unique=False)
    points = U.literal_sql_tables(code, read(spark, d, "db_tables"))
    return U.upstream_touchpoints(points, symbols_of(spark, d), files_of(spark, d), _edges(spark, d), R.layer_of("path"), R.BRIDGES)


_ALL = (
    sql_validate, sql_validate_replayed, table_cards, table_cards_replayed, table_graph_edges, find_table, test_targets, planned_layers, upstream_touchpoints, body_previews, symbol_card, table_usage, column_mentions, literal_sql_tables, seed_dedup, context_requirements, php_symbols_all, php_symbols, php_references, ddl_columns, ddl_keys, ddl_tables_all, ddl_tables, sql_file_statements, resolve, dependents_direct, dependents_min_depth, dependents_paths, deps_forward, deps_tree, flow_tree, flow_calls, blast_radius, blast_radius_top, find_in_path, climb_usage, top_level_container,
    exception_summary, fk_graph_bfs, schema_counts, table_summary, table_search, fk_join_check, line_counts, enclosing_symbol, search_content,
    line_write_context, block_segments, comment_lines, table_refs, table_refs_sql, status, unresolved_categories, source_labels, namespace_prefixes, module_stats,
    module_table, module_dependencies, layer_violations, external_namespaces, kind_counts, interface_adoption, naming_ratios, freshness,
    compare_members, missing_everywhere, find_symbols, suggest_symbols, name_tokens, tested_areas, route_pairs, route_families, changeset,
)
QUERIES = {f.__name__: f for f in _ALL}
