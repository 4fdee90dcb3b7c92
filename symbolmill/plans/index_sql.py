"""SQL of the index queries, for DuckDB."""

from __future__ import annotations

from symbolmill.operators import sqlcheck as Q
from symbolmill.operators import testing as T
from symbolmill.operators.lines import SCOPE_BREAK, SQL_LINE, STATEMENT_BREAK
from symbolmill.operators.reports import ARCHITECTURE, BRIDGES, MODULE_LAYERS, PHP_CLASSES, PLANNED
from symbolmill.operators.traverse import CALL_KINDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_text, values))



_KEY = r"lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\\', ''))"
_BASE = """
WITH RECURSIVE f AS (SELECT DISTINCT file_id, repo_id, path, language, hash, lines_of_code, content, last_indexed_at FROM files),
s AS (SELECT DISTINCT symbol_id, file_id, kind, name, qualified_name, parent_symbol_id, line_start, line_end, signature, metadata FROM symbols WHERE removed_at IS NULL),
r AS (SELECT DISTINCT reference_id, source_symbol_id, target_qualified_name, target_symbol_id, reference_kind, line_number FROM symbol_references),
e AS (SELECT source_symbol_id AS src, target_symbol_id AS dst, reference_kind FROM r WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL),
t AS (SELECT DISTINCT table_id, repo_id, normalized_name FROM db_tables WHERE removed_at IS NULL),
k AS (SELECT DISTINCT foreign_key_id, table_id, normalized_target_table, source_columns, target_columns FROM db_foreign_keys),
ke AS (SELECT t.repo_id, t.normalized_name AS source_table, k.normalized_target_table AS target_table, k.foreign_key_id, k.source_columns, k.target_columns
  FROM k JOIN t USING (table_id) WHERE t.normalized_name IS NOT NULL AND k.normalized_target_table IS NOT NULL),
l AS (SELECT file_id, repo_id, path, language, generate_subscripts(parts, 1) AS line_number, unnest(parts) AS line
  FROM (SELECT DISTINCT file_id, repo_id, path, language, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS parts FROM files WHERE content IS NOT NULL)),
hub AS (SELECT dst AS node FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
root AS (SELECT src AS node FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
caller AS (SELECT src AS node FROM e WHERE reference_kind IN (CALLS) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""".replace("CALLS", ", ".join(f"'{k}'" for k in CALL_KINDS))

_MODULE = "CASE WHEN len(string_split(path, '/')) <= 2 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END"
_TEST = r"regexp_matches(path, '(?i)(?:^|/)(?:tests?|spec)/|test\.php$|spec\.\w+$')"
def _layer(symbol: str) -> str:
    """F13 on path and symbol."""
    whens = [
        rf"WHEN regexp_matches(lower(path), '(^|[\\/])(?:{names})([\\/]|$)') OR regexp_matches(lower(coalesce({symbol}, '')), '(^|\\|::|\$)(?:{names})s?($|\\|::)') THEN '{layer}'"
        for layer, names in ARCHITECTURE
    ]
    pages = r"WHEN regexp_matches(lower(path), '(^|[\\/])staff([\\/]|$)') THEN 'Staff Page' WHEN regexp_matches(lower(path), '(^|[\\/])(pages?|legacy)([\\/]|$)') THEN 'Legacy Page'"
    return f"CASE {' '.join(whens)} {pages} ELSE 'Other' END"


_LAYER = _layer("NULL")
#: The innermost symbol of the points (file_id, line_number) of ``p``.
_INNER = """, inner_ AS (SELECT file_id, line_number, symbol_id, qualified_name FROM (
  SELECT p.file_id, p.line_number, s.symbol_id, s.qualified_name, row_number() OVER (PARTITION BY p.file_id, p.line_number ORDER BY CASE WHEN kind_ IN ('method', 'function') THEN 0 ELSE 1 END, line_end - line_start, line_start, symbol_id) AS n
  FROM (SELECT DISTINCT file_id, line_number FROM p) p JOIN (SELECT *, kind AS kind_ FROM s) s ON s.file_id = p.file_id AND p.line_number BETWEEN s.line_start AND s.line_end) WHERE n = 1)
"""
_WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(replace({0}, '\', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _reach(edges: str, seed: str, depth: int, seen: bool, out: str = "symbol_id") -> str:
    start = f"SELECT node, 0 AS depth FROM {seed}"
    walk = f"""{_BASE}, step AS ({edges}),
w(node, depth) AS ({start} UNION SELECT step.dst, w.depth + 1 FROM w JOIN step ON step.src = w.node WHERE w.depth < {depth})
SELECT node AS {out}, CAST(min(depth) AS INTEGER) AS depth FROM w"""
    return f"{walk} {'' if seen else 'WHERE depth > 0'} GROUP BY node"


def _rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} <= 0 THEN 0.0 WHEN {n} >= {d} THEN 100.0 ELSE least(99.9, floor(CAST({n} AS DOUBLE) / {d} * 1000 + 0.5) / 10) END"


_SECONDS = "(epoch(TIMESTAMP '2026-01-01') - floor(epoch(last_indexed_at)))"
_AGE = "CASE " + " ".join(f"WHEN {_SECONDS} < {most} THEN CAST(floor({_SECONDS} / {size}) AS BIGINT) || '{sign}'" for most, size, sign in ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"))) + f" ELSE CAST(floor({_SECONDS} / 86400) AS BIGINT) || 'd' END"
_FORWARD = "SELECT DISTINCT src, dst FROM e"
_BACK = "SELECT DISTINCT dst AS src, src AS dst FROM e"

SQL = {
    "php_symbols": "SELECT DISTINCT file_id, kind, line_start, line_end FROM symbols",
    "ddl_tables": "SELECT DISTINCT file_id, normalized_name AS table_name FROM db_tables WHERE file_id IN (SELECT file_id FROM files WHERE language = 'sql' AND content <> '') AND normalized_name IS NOT NULL",
    "resolve": _BASE
    + f""", names AS (SELECT {_KEY.format('qualified_name')} AS key, symbol_id, parent_symbol_id FROM s WHERE qualified_name IS NOT NULL),
x AS (SELECT key, max(symbol_id) AS id FROM names GROUP BY 1), c AS (SELECT key, max(symbol_id) AS id FROM names WHERE parent_symbol_id IS NULL GROUP BY 1),
q AS (SELECT reference_id, {_KEY.format('target_qualified_name')} AS k FROM r)
SELECT q.reference_id, coalesce(x.id, c.id) AS resolved_symbol_id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN c.id IS NOT NULL THEN 'class' END AS how
FROM q LEFT JOIN x ON x.key = q.k LEFT JOIN c ON c.key = CASE WHEN instr(q.k, '::') > 1 THEN split_part(q.k, '::', 1) END""",
    "dependents_direct": _BASE
    + "SELECT DISTINCT r.target_symbol_id, f.path, r.source_symbol_id, r.reference_kind, r.line_number FROM r JOIN s ON s.symbol_id = r.source_symbol_id JOIN f USING (file_id) WHERE r.target_symbol_id IS NOT NULL",
    "dependents_min_depth": _reach(_BACK, "hub", 4, False),
    "dependents_paths": _BASE
    + """, w(node, depth) AS (SELECT e.src, 1 FROM e JOIN hub ON e.dst = hub.node UNION ALL SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 3),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT w.node AS symbol_id, CAST(w.depth AS INTEGER) AS depth, count(*) AS n_paths FROM w JOIN m USING (node, depth) GROUP BY 1, 2""",
    "deps_forward": _reach(_FORWARD, "root", 6, True),
    "flow_calls": _reach(_FORWARD + " WHERE reference_kind IN (" + ", ".join(f"'{k}'" for k in CALL_KINDS) + ")", "caller", 10, True),
    "blast_radius": _BASE
    + f""", step AS ({_BACK}), big AS (SELECT file_id FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w(node, depth) AS (SELECT symbol_id, 0 FROM s JOIN big USING (file_id) UNION SELECT step.dst, w.depth + 1 FROM w JOIN step ON step.src = w.node WHERE w.depth < 3),
n AS (SELECT DISTINCT node FROM w WHERE depth > 0)
SELECT f.path, count(*) AS n_symbols, array_to_string(list_sort(list(DISTINCT s.kind)), ',') AS kinds FROM n JOIN s ON s.symbol_id = n.node JOIN f USING (file_id) GROUP BY 1""",
    "climb_usage": _BASE
    + f""", step AS ({_BACK}), up AS (SELECT src, dst FROM step UNION SELECT step.src, s.parent_symbol_id FROM step JOIN s ON s.symbol_id = step.dst WHERE s.parent_symbol_id IS NOT NULL),
w(node, depth) AS (SELECT node, 0 FROM hub UNION SELECT up.dst, w.depth + 1 FROM w JOIN up ON up.src = w.node WHERE w.depth < 3)
SELECT node AS symbol_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""",
    "top_level_container": _BASE
    + """, w(node, top, height) AS (SELECT symbol_id, symbol_id, 0 FROM s UNION ALL SELECT w.node, p.symbol_id, w.height + 1 FROM w JOIN s c ON c.symbol_id = w.top JOIN s p ON p.symbol_id = c.parent_symbol_id WHERE w.height < 32)
SELECT node AS symbol_id, arg_max(top, height) AS top_symbol_id, CAST(max(height) AS INTEGER) AS height FROM w GROUP BY node""",
    "exception_summary": _BASE
    + "SELECT DISTINCT owner_symbol_id, 'throw' AS source, method, exception FROM (SELECT coalesce(parent_symbol_id, symbol_id) AS owner_symbol_id, name AS method, unnest(metadata.thrown_exceptions) AS exception FROM s WHERE kind IN ('method', 'function')) WHERE exception IS NOT NULL",
    "fk_graph_bfs": _BASE
    + """, known AS (SELECT DISTINCT repo_id, normalized_name AS n FROM t WHERE normalized_name IS NOT NULL),
d AS (SELECT DISTINCT ke.repo_id, source_table AS a, target_table AS b FROM ke JOIN known ON known.repo_id = ke.repo_id AND known.n = ke.target_table),
u AS (SELECT repo_id, a, b FROM d UNION SELECT repo_id, b, a FROM d),
seed AS (SELECT known.repo_id, known.n FROM known LEFT JOIN (SELECT repo_id, target_table, count(*) AS c FROM ke GROUP BY 1, 2) i ON i.repo_id = known.repo_id AND i.target_table = known.n ORDER BY coalesce(c, 0) DESC, 1, 2 LIMIT 1),
w(repo_id, n, depth) AS (SELECT repo_id, n, 0 FROM seed UNION SELECT u.repo_id, u.b, w.depth + 1 FROM w JOIN u ON u.repo_id = w.repo_id AND u.a = w.n WHERE w.depth < 5)
SELECT repo_id, n AS table_name, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""",
    "schema_counts": _BASE
    + """SELECT n.repo_id, n_tables, coalesce(n_keys, 0) AS n_keys, coalesce(n_sources, 0) AS n_sources, coalesce(n_targets, 0) AS n_targets
FROM (SELECT repo_id, count(DISTINCT normalized_name) AS n_tables FROM t WHERE normalized_name IS NOT NULL GROUP BY 1) n
LEFT JOIN (SELECT repo_id, count(DISTINCT foreign_key_id) AS n_keys, count(DISTINCT source_table) AS n_sources, count(DISTINCT target_table) AS n_targets FROM ke GROUP BY 1) e USING (repo_id)""",
    "table_summary": _BASE
    + """SELECT n.repo_id, n.table_name, (SELECT count(*) FROM ke WHERE ke.repo_id = n.repo_id AND source_table = n.table_name) AS n_out, (SELECT count(*) FROM ke WHERE ke.repo_id = n.repo_id AND target_table = n.table_name) AS n_in
FROM (SELECT DISTINCT repo_id, normalized_name AS table_name FROM t WHERE normalized_name IS NOT NULL) n""",
    "table_search": _BASE
    + "SELECT DISTINCT repo_id, normalized_name AS table_name, CASE WHEN normalized_name = 'tariff' THEN 0 WHEN suffix(normalized_name, '.tariff') THEN 1 ELSE 2 END AS match_rank FROM t WHERE contains(normalized_name, 'tariff')",
    "line_counts": _BASE
    + "SELECT language, count(*) AS n_files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS n_lines, count(*) FILTER (WHERE sha256(content) = hash) AS n_hash_equal FROM f WHERE content IS NOT NULL GROUP BY 1",
    "enclosing_symbol": _BASE
    + """, p AS (SELECT DISTINCT s.file_id, r.line_number FROM r JOIN s ON s.symbol_id = r.source_symbol_id WHERE r.line_number IS NOT NULL),
h AS (SELECT p.file_id, p.line_number, s.symbol_id, row_number() OVER (PARTITION BY p.file_id, p.line_number ORDER BY CASE WHEN kind IN ('method', 'function') THEN 0 ELSE 1 END, line_end - line_start, line_start, symbol_id) AS n
  FROM p LEFT JOIN s ON s.file_id = p.file_id AND p.line_number BETWEEN s.line_start AND s.line_end)
SELECT file_id, line_number, symbol_id FROM h WHERE n = 1""",
    "search_content": _BASE + "SELECT file_id, path, CAST(line_number AS INTEGER) AS line_number, trim(line) AS preview FROM l WHERE contains(lower(line), 'snapshot') ORDER BY path, file_id, line_number LIMIT 100",
    "line_write_context": _BASE
    + r""", a AS (SELECT file_id, line_number, line, concat_ws(chr(10), lag(line, 2) OVER w, lag(line) OVER w, line, lead(line) OVER w) AS around FROM l WINDOW w AS (PARTITION BY file_id ORDER BY line_number))
SELECT file_id, CAST(line_number AS INTEGER) AS line_number, regexp_matches(around, '(?i)\b(update|insert|set|delete)\b|->(save|persist|update|insert)\(') AS is_write FROM a WHERE contains(lower(line), 'payload')""",
    "comment_lines": _BASE + r"SELECT file_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(trim(line), '^(?://|#|/\*|\*)')) AS n_comment_lines FROM l GROUP BY 1",
    "status": _BASE
    + f""", o AS (SELECT s.symbol_id, f.repo_id FROM s JOIN f USING (file_id)),
a AS (SELECT repo_id, count(*) AS n_files, CAST(sum(lines_of_code) AS BIGINT) AS n_lines FROM f GROUP BY 1), b AS (SELECT repo_id, count(*) AS n_symbols FROM o GROUP BY 1),
c AS (SELECT repo_id, count(*) AS n_references, count(target_symbol_id) AS n_resolved FROM r JOIN o ON o.symbol_id = r.source_symbol_id GROUP BY 1),
j AS (SELECT a.repo_id, n_files, n_lines, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_references, 0) AS n_references, coalesce(n_resolved, 0) AS n_resolved FROM a LEFT JOIN b USING (repo_id) LEFT JOIN c USING (repo_id))
SELECT *, {_rate('n_resolved', 'n_references')} AS resolved_rate FROM j""",
    "source_labels": _BASE + "SELECT CASE WHEN starts_with(path, '@') THEN substring(split_part(path, '/', 1), 2) ELSE 'repo' END AS label, count(*) AS n_files FROM f GROUP BY 1",
    "namespace_prefixes": _BASE + r"SELECT DISTINCT lower(split_part(qualified_name, '\', 1)) AS prefix FROM s WHERE parent_symbol_id IS NULL AND qualified_name IS NOT NULL",
    "module_stats": _BASE
    + f"SELECT {_MODULE} AS module, count(DISTINCT file_id) AS n_files, count(*) AS n_symbols, count(*) FILTER (WHERE kind = 'class') AS n_classes, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM s JOIN f USING (file_id) GROUP BY 1",
    "module_table": _BASE
    + f""", i AS (SELECT target_symbol_id AS symbol_id, count(*) AS n FROM r WHERE target_symbol_id IS NOT NULL GROUP BY 1),
g AS (SELECT source_symbol_id AS symbol_id, {', '.join(f"coalesce(array_to_string(list_sort(list(DISTINCT {_KEY.format('target_qualified_name')}) FILTER (WHERE reference_kind = '{k}')), ','), '') AS {n}" for k, n in (('implementation', 'implements'), ('inheritance', 'extends'), ('trait_use', 'traits')))}
  FROM r WHERE reference_kind IN ('implementation', 'inheritance', 'trait_use') GROUP BY 1)
SELECT s.symbol_id, {_MODULE} AS module, s.qualified_name, s.kind, coalesce(i.n, 0) AS n_incoming, coalesce(g.implements, '') AS implements, coalesce(g.extends, '') AS extends, coalesce(g.traits, '') AS traits
FROM s JOIN f USING (file_id) LEFT JOIN i USING (symbol_id) LEFT JOIN g USING (symbol_id) WHERE s.parent_symbol_id IS NULL""",
    "module_dependencies": _BASE
    + f""", a AS (SELECT symbol_id, {_MODULE} AS v FROM s JOIN f USING (file_id))
SELECT x.v AS source_module, y.v AS target_module, count(*) AS n_references FROM r JOIN a x ON x.symbol_id = r.source_symbol_id JOIN a y ON y.symbol_id = r.target_symbol_id WHERE x.v <> y.v GROUP BY 1, 2""",
    "external_namespaces": _BASE
    + rf"SELECT split_part(t, '\', 1) AS namespace, count(*) AS n_references FROM (SELECT {_KEY.format('target_qualified_name')} AS t FROM r WHERE target_symbol_id IS NULL) WHERE instr(t, '\') > 0 GROUP BY 1",
    "kind_counts": _BASE + "SELECT reference_kind, count(*) AS n_references, count(DISTINCT source_symbol_id) AS n_sources FROM r GROUP BY 1",
    "interface_adoption": _BASE
    + f"""SELECT {_MODULE} AS module, count(*) AS n_classes, {', '.join(f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.source_symbol_id = s.symbol_id AND reference_kind = '{k}')) AS {n}" for k, n in (('implementation', 'n_with_interface'), ('inheritance', 'n_with_base'), ('trait_use', 'n_with_traits')))}
FROM s JOIN f USING (file_id) WHERE kind = 'class' GROUP BY 1""",
    "naming_ratios": _BASE
    + f"""SELECT kind, count(*) AS n_symbols, {', '.join(f"round(avg(CASE WHEN regexp_matches(name, '{p}') THEN 1.0 ELSE 0.0 END), 6) AS {n}" for p, n in (('^[A-Z][A-Za-z0-9]*$', 'pascal_case'), ('^[a-z][A-Za-z0-9]*$', 'camel_case'), ('^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$', 'snake_case')))}
FROM s WHERE name IS NOT NULL GROUP BY 1""",
    "freshness": "SELECT repo_id, CAST(floor((epoch(TIMESTAMP '2026-01-01') - floor(epoch(last_indexed_at))) / 3600) AS BIGINT) AS age_hours, AGE AS age, floor((epoch(TIMESTAMP '2026-01-01') - floor(epoch(last_indexed_at))) / 3600) > 24 AS is_stale FROM repos".replace("AGE", _AGE),
    "find_symbols": _BASE + "SELECT symbol_id, qualified_name, kind FROM s WHERE lower(name) LIKE 'find%ledger' AND qualified_name IS NOT NULL ORDER BY qualified_name, symbol_id LIMIT 50",
    "name_tokens": _BASE
    + f", w AS (SELECT {_WORDS.format('name')} AS w FROM s WHERE name IS NOT NULL) SELECT token, count(*) AS n_symbols FROM (SELECT unnest(list_distinct(list_concat([array_to_string(w, '')], w))) AS token FROM w) GROUP BY 1",
    "tested_areas": _BASE
    + rf"SELECT repo_id, regexp_replace(regexp_replace(regexp_replace(path, '^@[^/]*/', ''), '^tests?/', ''), '/[^/]*$', '') AS area, count(*) FILTER (WHERE NOT {_TEST}) AS n_production, count(*) FILTER (WHERE {_TEST}) AS n_tests FROM f GROUP BY 1, 2",
    "route_pairs": _BASE
    + r""", n AS (SELECT DISTINCT name, string_split(lower(name), '\') AS p FROM (SELECT replace(regexp_replace(path, '/[^/]*$', ''), '/', '\') AS name FROM f)),
flat AS (SELECT array_to_string(p[len(p) - 1:], '\') AS key, min(name) AS flat FROM n WHERE len(p) = 3 GROUP BY 1),
nested AS (SELECT name, p, unnest(range(1, len(p))) AS i FROM n WHERE len(p) > 3)
SELECT DISTINCT name AS nested, flat FROM nested JOIN flat ON flat.key = array_to_string(p[i:], '\')""",
    "changeset": _BASE
    + """, o AS (SELECT repo_id, path, max(sha256(coalesce(content, ''))) AS h FROM f WHERE last_indexed_at < TIMESTAMP '2025-07-01' GROUP BY 1, 2), n AS (SELECT repo_id, path, max(hash) AS h FROM f WHERE content IS NOT NULL AND content <> '' GROUP BY 1, 2)
SELECT repo_id, path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (repo_id, path) WHERE o.h IS DISTINCT FROM n.h""",
}
_PAIRS = ", tops AS (SELECT symbol_id, coalesce(parent_symbol_id, symbol_id) AS top FROM s), pairs AS (SELECT DISTINCT x.top AS a, y.top AS b FROM r JOIN tops x ON x.symbol_id = r.source_symbol_id JOIN tops y ON y.symbol_id = r.target_symbol_id WHERE reference_kind IN ('inheritance', 'implementation', 'trait_use') AND x.top <> y.top), m AS (SELECT parent_symbol_id AS owner, lower(name) AS member, first(coalesce(signature, '') ORDER BY line_start, symbol_id) AS sig FROM s WHERE parent_symbol_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)"
SQL["compare_members"] = (
    _BASE
    + _PAIRS
    + """, x AS (SELECT p.a, p.b, m.member, m.sig FROM pairs p JOIN m ON m.owner = p.a), y AS (SELECT p.a, p.b, m.member, m.sig FROM pairs p JOIN m ON m.owner = p.b)
SELECT a, b, count(*) FILTER (WHERE y.sig IS NULL) AS n_only_a, count(*) FILTER (WHERE x.sig IS NULL) AS n_only_b, count(*) FILTER (WHERE x.sig IS NOT NULL AND y.sig IS NOT NULL) AS n_shared, count(*) FILTER (WHERE x.sig <> y.sig) AS n_differing FROM x FULL JOIN y USING (a, b, member) GROUP BY 1, 2"""
)
SQL["missing_everywhere"] = (
    _BASE + _PAIRS + "SELECT DISTINCT p.a, m.member FROM pairs p JOIN m ON m.owner = p.a WHERE NOT EXISTS (SELECT 1 FROM pairs q JOIN m o ON o.owner = q.b WHERE q.a = p.a AND o.member = m.member)"
)

_REFS = r""", n AS (SELECT DISTINCT normalized_name AS token FROM db_tables WHERE normalized_name IS NOT NULL),
x AS (SELECT file_id, line_number, line, unnest(list_distinct(regexp_extract_all(lower(line), '[a-z_][a-z0-9_]*'))) AS token FROM l WHERE NOT regexp_matches(trim(line), '^(?://|#|/\*|\*)'))"""
SQL["body_previews"] = (
    _BASE
    + """, b AS (SELECT s.symbol_id, list(trim(l.line) ORDER BY l.line_number) AS b FROM s JOIN l ON l.file_id = s.file_id AND l.line_number > s.line_start AND l.line_number <= s.line_end
  WHERE s.kind = 'method' AND s.line_end - s.line_start <= 40 AND trim(l.line) NOT IN ('', '{', '}') GROUP BY 1)
SELECT symbol_id, array_to_string(CASE WHEN len(b) > 8 THEN list_append(b[:8], '...') ELSE b END, chr(10)) AS preview FROM b"""
)
SQL["symbol_card"] = (
    _BASE
    + """, o AS (SELECT node, node AS owner FROM root UNION ALL SELECT root.node, s.symbol_id FROM s JOIN root ON s.parent_symbol_id = root.node)
SELECT node, section, via_symbol_id, other, reference_kind, count(*) AS n FROM (
  SELECT o.node, 'out' AS section, r.source_symbol_id AS via_symbol_id, r.target_qualified_name AS other, r.reference_kind FROM r JOIN o ON o.owner = r.source_symbol_id
  UNION ALL SELECT root.node, 'in', root.node, CAST(r.source_symbol_id AS VARCHAR), r.reference_kind FROM r JOIN root ON r.target_symbol_id = root.node) GROUP BY ALL"""
)
SQL["column_mentions"] = (
    _BASE
    + _REFS
    + """, c AS (SELECT DISTINCT t.normalized_name AS table_name, lower(c) AS column_name FROM (SELECT table_id, unnest(source_columns) AS c FROM k) JOIN t USING (table_id) WHERE t.normalized_name IS NOT NULL)
SELECT DISTINCT x.file_id, CAST(x.line_number AS INTEGER) AS line_number, c.table_name, c.column_name FROM x JOIN c ON c.column_name = x.token WHERE EXISTS (SELECT 1 FROM x y WHERE y.file_id = x.file_id AND y.token = c.table_name)"""
)
SQL["literal_sql_tables"] = (
    _BASE
    + r""", q AS (SELECT DISTINCT file_id, line_number, unnest(regexp_extract_all(lower(line), '\b(?:from|join|into|update)\s+[`"\[]?([a-z_][a-z0-9_.]*)', 1)) AS table_name FROM l
  WHERE language <> 'sql' AND regexp_matches(line, '(?i)\b(select\s.+\sfrom|insert\s+into|update\s+\S+\s+set|delete\s+from)\b') AND NOT regexp_matches(trim(line), '^(?://|#|/\*|\*)'))
SELECT file_id, CAST(line_number AS INTEGER) AS line_number, table_name, EXISTS (SELECT 1 FROM db_tables d WHERE d.normalized_name = q.table_name) AS is_known FROM q"""
)
SQL["seed_dedup"] = (
    _BASE
    + """, c AS (SELECT s.file_id, r.reference_kind, count(*) AS weight FROM r JOIN s ON s.symbol_id = r.source_symbol_id GROUP BY 1, 2)
SELECT file_id, weight, reference_kind FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY weight DESC, reference_kind) = 1"""
)
SQL["context_requirements"] = (
    _BASE
    + r""", ce AS (SELECT src, dst FROM e WHERE reference_kind IN ('class_reference', 'inheritance')), croot AS (SELECT src AS node FROM ce GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w(node, depth) AS (SELECT node, 0 FROM croot UNION SELECT ce.dst, w.depth + 1 FROM w JOIN ce ON ce.src = w.node WHERE w.depth < 4),
x AS (SELECT DISTINCT s.symbol_id AS node, context_key FROM s JOIN (SELECT file_id, unnest(regexp_extract_all(content, '\$this->(?:args|params)\[[''"]([^''"]+)[''"]\]', 1)) AS context_key FROM f) USING (file_id))
SELECT context_key, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN x USING (node) GROUP BY 1"""
)
SQL["upstream_touchpoints"] = (
    SQL["literal_sql_tables"].replace("SELECT file_id, CAST(line_number AS INTEGER) AS line_number, table_name, EXISTS", ", p AS (SELECT DISTINCT file_id, line_number FROM q), unused AS (SELECT file_id, table_name, EXISTS")
    + f"""), h AS (SELECT s.symbol_id, row_number() OVER (PARTITION BY p.file_id, p.line_number ORDER BY CASE WHEN kind IN ('method', 'function') THEN 0 ELSE 1 END, line_end - line_start, line_start, symbol_id) AS n
  FROM p JOIN s ON s.file_id = p.file_id AND p.line_number BETWEEN s.line_start AND s.line_end),
c(node, top, height) AS (SELECT symbol_id, symbol_id, 0 FROM s UNION ALL SELECT c.node, p2.symbol_id, c.height + 1 FROM c JOIN s c2 ON c2.symbol_id = c.top JOIN s p2 ON p2.symbol_id = c2.parent_symbol_id WHERE c.height < 32),
o AS (SELECT node, arg_max(top, height) AS top FROM c GROUP BY 1),
seed AS (SELECT DISTINCT o.top AS node FROM h JOIN o ON o.node = h.symbol_id JOIN s ON s.symbol_id = o.top JOIN f USING (file_id) WHERE h.n = 1 AND {_LAYER} IN ({_list(BRIDGES)})),
step AS ({_BACK}), up AS (SELECT src, dst FROM step UNION SELECT step.src, s.parent_symbol_id FROM step JOIN s ON s.symbol_id = step.dst WHERE s.parent_symbol_id IS NOT NULL),
w(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT up.dst, w.depth + 1 FROM w JOIN up ON up.src = w.node WHERE w.depth < 3)
SELECT node AS symbol_id, CAST(min(depth) + 1 AS INTEGER) AS depth FROM w GROUP BY node"""
)

_REFERRED = (
    r""", x AS (SELECT file_id, repo_id, path, line_number, line, unnest(list_distinct(list_transform(regexp_extract_all(line, '[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*'), lambda q: lower(q)))) AS table_name
  FROM l WHERE language <> 'sql' AND NOT regexp_matches(trim(line), '^(?://|#|/\*|\*)')),
h AS (SELECT x.*, replace(table_name, '.', '\.') AS e FROM x JOIN (SELECT DISTINCT repo_id, normalized_name AS table_name FROM t WHERE normalized_name IS NOT NULL) USING (repo_id, table_name)),
h2 AS (SELECT *, '(?:"' || e || '"|''' || e || '''|`' || e || '`)' AS quoted FROM h),
k0 AS (SELECT file_id, path, line_number, table_name, CASE
  WHEN regexp_matches(line, '(?i)\b(?:from|join|update|into|table|using)\s+(?:if\s+(?:not\s+)?exists\s+)?["''`]?(?:[A-Za-z0-9_]+\.)?' || e || '["''`]?(?:$|[\s,;\)\]])') THEN 'sql_clause'
  WHEN regexp_matches(line, '(?i)(?:->|::|\b)(?:from|join|leftjoin|rightjoin|innerjoin|crossjoin|table)\s*\(\s*' || quoted) THEN 'query_builder_call'
  WHEN regexp_matches(line, '(?i)(?:["''`]?\b(?:table|table_name|tablename|dbtable|source_table|sourcetable)\b["''`]?|\$[A-Za-z_][A-Za-z0-9_]*table[A-Za-z0-9_]*)\s*(?:=>|:|=)\s*' || quoted) THEN 'table_assignment'
  WHEN TEST AND regexp_matches(line, '(?i)' || quoted) THEN 'quoted_literal'
  WHEN regexp_matches(line, '(?i)\breturn\b\s*\(?\s*' || quoted) THEN 'quoted_return' END AS kind FROM h2),
p AS (SELECT * FROM k0 WHERE kind IS NOT NULL)""".replace("TEST", _TEST)
    + _INNER
    + """, refs AS (SELECT DISTINCT p.file_id, p.path, p.line_number, p.table_name, p.kind, i.symbol_id, i.qualified_name
  FROM p LEFT JOIN inner_ i USING (file_id, line_number) WHERE p.kind <> 'quoted_return' OR contains(lower(split_part(coalesce(i.qualified_name, ''), '::', -1)), 'table'))
"""
)
SQL["table_refs"] = _BASE + _REFERRED + "SELECT file_id, CAST(line_number AS INTEGER) AS line_number, table_name, kind, symbol_id FROM refs"
SQL["table_refs_sql"] = SQL["table_refs"].replace("language <> 'sql' AND NOT", "language = 'sql' AND NOT")
SQL["table_usage"] = (
    _BASE
    + _REFERRED
    + f""", u AS (SELECT table_name, {_TEST} AS is_test, qualified_name AS owner, path, line_number, kind FROM refs)
SELECT table_name, {_layer('owner')} AS layer, is_test, owner, path, kind, CAST(line_number AS INTEGER) AS line_number FROM u
QUALIFY row_number() OVER (PARTITION BY table_name, is_test, owner, path ORDER BY line_number, kind) = 1"""
)
SQL["planned_layers"] = (
    _BASE
    + f"""SELECT CASE {' '.join(f"WHEN suffix(name, '{x}') OR contains(lower(path), '/{x.lower()}/') THEN '{x}'" for x in PLANNED)} ELSE 'Other' END AS layer, count(*) AS n_symbols
FROM s JOIN f USING (file_id) WHERE parent_symbol_id IS NULL AND name IS NOT NULL GROUP BY 1"""
)
_RANK = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{x}') THEN {i}" for i, x in enumerate(MODULE_LAYERS)) + " END"
SQL["layer_violations"] = f"SELECT * FROM ({SQL['module_dependencies']}) WHERE {_RANK.format('source_module')} > {_RANK.format('target_module')}"
SQL["unresolved_categories"] = (
    _BASE
    + rf""", u AS (SELECT {_KEY.format('r.target_qualified_name')} AS t, CASE WHEN starts_with(f.path, 'cache/') THEN 'cache' WHEN starts_with(f.path, 'tests/') THEN 'tests' ELSE 'code' END AS place
  FROM r LEFT JOIN s ON s.symbol_id = r.source_symbol_id LEFT JOIN f USING (file_id) WHERE r.target_symbol_id IS NULL AND r.target_qualified_name IS NOT NULL),
v AS (SELECT t, place, split_part(t, '::', 1) AS c, CASE WHEN instr(t, '\') > 1 THEN split_part(t, '\', 1) END AS p FROM u),
own AS (SELECT DISTINCT lower(split_part(qualified_name, '\', 1)) AS p FROM s WHERE parent_symbol_id IS NULL AND qualified_name IS NOT NULL),
ext AS (SELECT DISTINCT {_KEY.format('qualified_name')} AS q FROM external_symbols WHERE qualified_name IS NOT NULL),
c AS (SELECT place, CASE WHEN place = 'cache' THEN 'generated_cache' WHEN regexp_matches(t, '^(phake|phpunit|mockery)(::|\\|$)') OR starts_with(t, 'm::') THEN 'test_framework'
  WHEN split_part(c, '\', -1) IN ('parent', 'self', 'static') THEN 'static_self' WHEN p IS NULL AND (split_part(c, '\', -1) IN ({_list(PHP_CLASSES)}) OR starts_with(t, 'pdo::')) THEN 'php_builtin'
  WHEN place = 'tests' THEN 'test_only' WHEN p IS NOT NULL AND (p IN (SELECT split_part(q, '\', 1) FROM ext WHERE instr(q, '\') > 1) OR p NOT IN (SELECT p FROM own)) THEN 'external_vendor'
  WHEN p IS NULL AND c IN (SELECT q FROM ext WHERE instr(q, '\') = 0) THEN 'external_vendor' WHEN p IS NOT NULL OR c <> '' THEN 'potential_internal_miss' ELSE 'unknown' END AS category FROM v)
SELECT category, count(*) AS n_references, CAST(sum(CASE WHEN category IN ('potential_internal_miss', 'unknown') THEN 1 ELSE 0 END) AS BIGINT) AS n_potential_internal,
  CAST(sum(CASE WHEN category IN ('potential_internal_miss', 'unknown') AND place = 'code' THEN 1 ELSE 0 END) AS BIGINT) AS n_production_internal FROM c GROUP BY 1"""
)
SQL["suggest_symbols"] = (
    _BASE
    + r""", c AS (SELECT symbol_id, qualified_name, CASE WHEN mn = w THEN 120 ELSE 0 END + CASE WHEN mq = w THEN 110 ELSE 0 END + CASE WHEN n = w THEN 100 ELSE 0 END + CASE WHEN suffix(q, '\' || w) OR suffix(q, '::' || w) THEN 70 ELSE 0 END
  + CASE WHEN contains(mn, w) THEN 50 ELSE 0 END + CASE WHEN contains(mq, w) THEN 40 ELSE 0 END
  + CAST(list_sum(list_transform(['findledgerentry', 'find', 'ledger', 'entry'], lambda x: CASE WHEN contains(n, x) THEN 12 ELSE 0 END + CASE WHEN contains(q, x) THEN 8 ELSE 0 END)) AS INTEGER) AS score
  FROM (SELECT symbol_id, qualified_name, lower(name) AS n, lower(qualified_name) AS q, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS mn, regexp_replace(lower(qualified_name), '[^a-z0-9]+', '', 'g') AS mq, 'findledgerentry' AS w FROM s WHERE name IS NOT NULL AND qualified_name IS NOT NULL))
SELECT symbol_id, qualified_name, score FROM c WHERE score > 0 ORDER BY score DESC, qualified_name, symbol_id LIMIT 20"""
)
_BLOCKS = f""", c AS (SELECT file_id, repo_id, line_number, line FROM l WHERE FILTER regexp_matches(line, {_text(SQL_LINE)})),
g AS (SELECT *, CASE WHEN coalesce(lag(line_number) OVER w + 1 <> line_number, true) OR coalesce(lag(regexp_matches(line, {_text(STATEMENT_BREAK)})) OVER w, false) OR regexp_matches(line, {_text(SCOPE_BREAK)}) THEN 1 ELSE 0 END AS fresh
  FROM c WINDOW w AS (PARTITION BY file_id ORDER BY line_number)),
b AS (SELECT file_id, repo_id, line_number, line, sum(fresh) OVER (PARTITION BY file_id ORDER BY line_number) AS block FROM g)
"""
SQL["block_segments"] = (
    _BASE + _BLOCKS.replace("FILTER ", "") + "SELECT file_id, CAST(min(line_number) AS INTEGER) AS first_line, CAST(max(line_number) AS INTEGER) AS last_line, count(*) AS n_lines FROM b GROUP BY file_id, block"
)
_FULL = """, fe AS (SELECT ke.*, list_transform(ke.source_columns, lambda x: lower(x)) AS sc, list_transform(ke.target_columns, lambda x: lower(x)) AS tc FROM ke),
cols AS (SELECT DISTINCT * FROM (SELECT repo_id, source_table AS table_name, unnest(sc) AS column_name FROM fe UNION ALL SELECT repo_id, target_table, unnest(tc) FROM fe) WHERE column_name IS NOT NULL)
"""


def _three(pattern: str) -> str:
    """The pattern between each of the three quotes."""
    return "(?:" + "|".join(q + pattern + q for q in "\"'`") + ")"


def _all(pattern: str, group: int) -> str:
    return f"regexp_extract_all(line, {_text(pattern)}, {group})"


def _merge(pattern: str, *groups: int) -> str:
    """The one of several groups that took part, for all matches."""
    parts = " || ".join(f"coalesce(z[{i + 1}], '')" for i in range(len(groups)))
    return f"list_transform(list_zip({', '.join(_all(pattern, g) for g in groups)}), lambda z: {parts})"


_BUILDER = r"(?i)(?:->|::)(from|join|leftjoin|rightjoin|innerjoin|crossjoin|table)\s*\(\s*" + _three("([^\"'`]+)") + r"(?:\s*,\s*" + _three("([^\"'`]+)") + ")?"
_SET = r"(?i)->set\s*\(\s*" + _three("([A-Za-z_][A-Za-z0-9_]*)")
_NORM = "lower(array_to_string(list_filter(string_split({0}, '.'), lambda q: q <> ''), '.'))"
_SQL_FOUND = (
    _BLOCKS.replace("FILTER", "language <> 'sql' AND")
    + _FULL
    + rf""", z AS (SELECT file_id, repo_id, block, line_number, p, unnest(list_zip(kw, tb, al, range(len(kw)))) AS z FROM (
  SELECT *, 0 AS p, {_all(Q.BINDINGS[0][0], 1)} AS kw, {_all(Q.BINDINGS[0][0], 2)} AS tb, {_all(Q.BINDINGS[0][0], 3)} AS al FROM b
  UNION ALL SELECT *, 1, {_all(Q.BINDINGS[1][0], 1)}, {_all(Q.BINDINGS[1][0], 2)}, {_all(Q.BINDINGS[1][0], 3)} FROM b
  UNION ALL SELECT *, 2, {_all(_BUILDER, 1)}, {_merge(_BUILDER, 2, 3, 4)}, {_merge(_BUILDER, 5, 6, 7)} FROM b)),
bind AS (SELECT file_id, repo_id, block, line_number, line_number * 1000000 + p * 100000 + z[4] AS o, lower(z[1]) AS kw, {_NORM.format("trim(z[2])")} AS wanted, lower(trim(coalesce(z[3], ''))) AS alias FROM z),
known AS (SELECT DISTINCT repo_id, normalized_name AS table_name FROM t WHERE repo_id IS NOT NULL AND normalized_name IS NOT NULL),
bound AS (SELECT bind.*, known.table_name FROM bind LEFT JOIN known ON known.repo_id = bind.repo_id AND known.table_name = bind.wanted),
al AS (SELECT file_id, block, alias, arg_max(table_name, o * 10 + k) AS table_name FROM (
  SELECT file_id, block, o, table_name, unnest([table_name, split_part(table_name, '.', -1), alias]) AS alias, unnest([0, 1, 2]) AS k FROM bound WHERE table_name IS NOT NULL)
  WHERE alias <> '' AND alias NOT IN ({_list(Q.NO_ALIASES)}) GROUP BY 1, 2, 3),
prim AS (SELECT file_id, block, coalesce(arg_max(table_name, o) FILTER (WHERE kw IN ({_list(Q.PRIMARY)})), CASE WHEN count(DISTINCT table_name) = 1 THEN min(table_name) END) AS table_name FROM bound WHERE table_name IS NOT NULL GROUP BY 1, 2),
qu AS (SELECT DISTINCT file_id, repo_id, block, line_number, lower(zz[1]) AS alias, lower(zz[2]) AS column_name FROM (SELECT *, unnest(list_zip({_all(Q.QUALIFIED, 1)}, {_all(Q.QUALIFIED, 2)})) AS zz FROM b)),
qa AS (SELECT qu.*, al.table_name FROM qu LEFT JOIN al USING (file_id, block, alias)),
bare AS (SELECT DISTINCT x.file_id, x.repo_id, x.line_number, prim.table_name, x.column_name FROM (SELECT file_id, repo_id, block, line_number, lower(unnest(list_concat(
    list_transform(string_split(regexp_extract(line, {_text(Q.INSERT_LIST)}, 1), ','), lambda q: regexp_replace(q, '["''`\s]', '', 'g')),
    list_concat(regexp_extract_all(replace(line, '=', '= '), '(?:^|[^.A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*=', 1),
    list_concat({_all(Q.COMPARED.replace("(?<!\\.)", ""), 1)}, {_merge(_SET, 1, 2, 3)}))))) AS column_name FROM b) x JOIN prim USING (file_id, block)
  WHERE prim.table_name IS NOT NULL AND x.column_name <> '' AND x.column_name NOT IN ({_list(Q.NO_ALIASES)})),
used AS (SELECT file_id, repo_id, line_number, table_name, column_name FROM qa WHERE table_name IS NOT NULL UNION SELECT * FROM bare),
jp AS (SELECT file_id, repo_id, block, line_number, lower(zz[1]) AS aa, lower(zz[2]) AS ac, lower(zz[3]) AS ba, lower(zz[4]) AS bc FROM (SELECT *, unnest(list_zip({', '.join(_all(Q.JOIN_PAIR, i) for i in (1, 2, 3, 4))})) AS zz FROM b)),
jt AS (SELECT jp.file_id, jp.repo_id, jp.line_number, a1.table_name AS at_, ac, a2.table_name AS bt, bc FROM jp JOIN al a1 ON a1.file_id = jp.file_id AND a1.block = jp.block AND a1.alias = aa JOIN al a2 ON a2.file_id = jp.file_id AND a2.block = jp.block AND a2.alias = ba
  WHERE EXISTS (SELECT 1 FROM cols WHERE cols.repo_id = jp.repo_id AND cols.table_name = a1.table_name AND cols.column_name = ac) AND EXISTS (SELECT 1 FROM cols WHERE cols.repo_id = jp.repo_id AND cols.table_name = a2.table_name AND cols.column_name = bc)),
one AS (SELECT repo_id, source_table AS a, sc[1] AS ac, target_table AS b, tc[1] AS bc FROM fe WHERE len(sc) = 1 AND len(tc) = 1),
p AS (SELECT file_id, line_number, 'missing_table' AS kind, wanted AS subject FROM bound WHERE table_name IS NULL
  UNION SELECT file_id, line_number, 'unresolved_alias', alias || '.' || column_name FROM qa WHERE table_name IS NULL
  UNION SELECT u.file_id, u.line_number, CASE WHEN cols.column_name IS NOT NULL THEN 'verified_column' ELSE 'missing_column' END, u.table_name || '.' || u.column_name FROM used u LEFT JOIN cols ON cols.repo_id = u.repo_id AND cols.table_name = u.table_name AND cols.column_name = u.column_name
  UNION SELECT file_id, line_number, CASE WHEN EXISTS (SELECT 1 FROM one WHERE one.repo_id = jt.repo_id AND ((one.a = at_ AND one.ac = jt.ac AND one.b = bt AND one.bc = jt.bc) OR (one.a = bt AND one.ac = jt.bc AND one.b = at_ AND one.bc = jt.ac))) THEN 'verified_join' ELSE 'missing_fk' END,
    at_ || '.' || ac || ' = ' || bt || '.' || bc FROM jt)
"""
)
SQL["sql_validate"] = _BASE + _SQL_FOUND + _INNER + "SELECT p.file_id, CAST(p.line_number AS INTEGER) AS line_number, p.kind, p.subject, i.symbol_id FROM p LEFT JOIN inner_ i USING (file_id, line_number)"
SQL["fk_join_check"] = _BASE + _SQL_FOUND + "SELECT kind, subject, count(*) AS n_lines FROM p WHERE kind IN ('verified_join', 'missing_fk') GROUP BY 1, 2"
SQL["table_graph_edges"] = (
    f"WITH g AS ({SQL['fk_graph_bfs']}), edges AS ({_BASE + _FULL} SELECT DISTINCT repo_id, source_table, sc AS source_columns, target_table, tc AS target_columns FROM fe)"
    + """SELECT repo_id, CAST(min(depth) AS INTEGER) AS depth, direction, source_table, source_columns, target_table, target_columns FROM (
  SELECT edges.*, g.depth, 'outbound' AS direction FROM edges JOIN g ON g.repo_id = edges.repo_id AND g.table_name = edges.source_table WHERE g.depth < 5
  UNION ALL SELECT edges.*, g.depth, 'inbound' FROM edges JOIN g ON g.repo_id = edges.repo_id AND g.table_name = edges.target_table WHERE g.depth < 5) GROUP BY ALL"""
)
SQL["table_cards"] = (
    _BASE
    + _FULL
    + """, tt AS (SELECT DISTINCT repo_id, normalized_name AS table_name, file_id, line_start FROM db_tables WHERE removed_at IS NULL AND normalized_name IS NOT NULL),
nk AS (SELECT DISTINCT foreign_key_id, constraint_name FROM db_foreign_keys), fk AS (SELECT fe.*, coalesce(nk.constraint_name, '') AS cn FROM fe JOIN nk USING (foreign_key_id)), tn AS (SELECT DISTINCT repo_id, table_name FROM tt)
SELECT DISTINCT * FROM (SELECT tt.repo_id, table_name, 'file' AS section, coalesce(f.path, '?') AS name, CAST(line_start AS VARCHAR) AS detail FROM tt LEFT JOIN f USING (file_id)
  UNION ALL SELECT cols.repo_id, cols.table_name, 'column', cols.column_name, NULL FROM cols JOIN tn ON tn.repo_id = cols.repo_id AND tn.table_name = cols.table_name
  UNION ALL SELECT repo_id, source_table, 'references', cn, array_to_string(sc, ',') || ' -> ' || target_table || '(' || array_to_string(tc, ',') || ')' FROM fk
  UNION ALL SELECT fk.repo_id, target_table, 'referenced_by', cn, source_table || '(' || array_to_string(sc, ',') || ') -> ' || array_to_string(tc, ',') FROM fk JOIN tn ON tn.repo_id = fk.repo_id AND tn.table_name = fk.target_table)"""
)
SQL["find_table"] = (
    _BASE
    + """, m AS (SELECT DISTINCT repo_id, normalized_name AS table_name, CASE WHEN normalized_name = 'tariff' THEN 0 ELSE 1 END AS r FROM t WHERE normalized_name = 'tariff' OR suffix(normalized_name, '.tariff'))
SELECT repo_id, table_name, CASE WHEN best = 0 THEN 'exact' WHEN n = 1 THEN 'suffix' ELSE 'ambiguous' END AS match FROM (SELECT *, min(r) OVER (PARTITION BY repo_id) AS best, count(*) OVER (PARTITION BY repo_id) AS n FROM m) WHERE r = best"""
)
_TOKENS = r"list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(replace({0}, '\', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')), lambda w: len(w) >= 3 AND w NOT IN (" + _list(T.GENERIC_TOKENS) + "))"
_KEBAB = r"regexp_replace(trim(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g')"
_BASENAME = r"regexp_replace(split_part(path, '/', -1), '(.)\.[^.]*$', '\1')"
_CUT = r"regexp_replace({0}, '(?i)^(.{{3,}}?)(?:" + "|".join(T.STRUCTURAL_SUFFIXES) + r")+$', '\1')"
_DIRS = r"list_filter(list_slice(regexp_split_to_array(lower(path), '[\\/]'), 1, -2), lambda q: q <> '')"


def _stem(base: str) -> str:
    cut = _KEBAB.format(_CUT.format(base))
    return f"CASE WHEN {cut} <> '' THEN {cut} ELSE {_KEBAB.format(base)} END"


SQL["test_targets"] = (
    _BASE
    + rf""", hub2 AS (SELECT dst AS node FROM e JOIN s ON s.symbol_id = e.dst GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), own AS (SELECT s.symbol_id, s.name, s.qualified_name, f.path FROM hub2 JOIN s ON s.symbol_id = hub2.node JOIN f USING (file_id)),
w(node, depth) AS (SELECT node, 0 FROM hub2 UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 2),
dep AS (SELECT f.path, s.qualified_name, m.depth FROM (SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1) m JOIN s ON s.symbol_id = m.node JOIN f USING (file_id)),
seeds AS (SELECT path, weight, symbol_name FROM (SELECT path, greatest(4, 10 - 2 * depth) AS weight, coalesce(qualified_name, '') AS symbol_name FROM dep WHERE NOT {_TEST} UNION ALL SELECT path, 12, coalesce(name, '') FROM own)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY weight DESC, symbol_name) = 1),
tests AS (SELECT DISTINCT path FROM f WHERE {_TEST}),
tl AS (SELECT l.path, l.line, regexp_escape(own.name) AS n, regexp_escape(regexp_replace(own.qualified_name, '^\\+', '')) AS qn, lower(own.qualified_name) AS ql FROM (SELECT * FROM l WHERE {_TEST}) l, own),
hints AS (SELECT DISTINCT * FROM (SELECT path, 'constructs' AS reason, 28 AS score FROM tl WHERE regexp_matches(line, '(?i)\bnew\s+' || n || '\b|\b' || n || '::class\b|\b(?:extends|implements)\s+[^\{{;]*\b' || n || '\b')
  UNION ALL SELECT path, 'names', 8 FROM tl WHERE regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9_])' || n || '(?:$|[^A-Za-z0-9_])')
  UNION ALL SELECT path, 'imports', 36 FROM tl WHERE regexp_matches(line, '(?i)\buse\s+\\?' || qn || '(?:\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?\s*;')
  UNION ALL SELECT path, 'mentions', 18 FROM tl WHERE contains(lower(line), ql)
  UNION ALL SELECT path, 'references', 28 FROM dep WHERE depth <= 1 AND {_TEST})),
st AS (SELECT path AS seed, weight, unnest({_TOKENS.format("path || ' ' || symbol_name")}) AS token FROM seeds), tt AS (SELECT path, unnest({_TOKENS.format('path')}) AS token FROM tests),
ss AS (SELECT {_stem(_BASENAME)} AS stem, weight FROM seeds), ts AS (SELECT path, {_stem(f"regexp_replace({_BASENAME}, {_text(T.TEST_SUFFIX)}, '')")} AS stem FROM tests),
sd AS (SELECT path AS seed, unnest(list_slice(list_reverse({_DIRS}), 1, 2)) AS d FROM seeds), td AS (SELECT DISTINCT path, unnest({_DIRS}) AS d FROM tests),
terms AS (SELECT path, score, reason FROM hints UNION ALL SELECT path, weight + 8, 'companion name' FROM ts JOIN ss USING (stem) WHERE stem <> ''
  UNION ALL SELECT path, 2, 'name tokens' FROM tt JOIN st USING (token) UNION ALL SELECT path, least(weight, 2), NULL FROM (SELECT DISTINCT path, seed, weight FROM tt JOIN st USING (token)) UNION ALL SELECT path, 1, 'same area' FROM td JOIN sd USING (d))
SELECT path, CAST(sum(score) AS BIGINT) AS score, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ', '), '') AS reasons FROM terms JOIN tests USING (path) GROUP BY 1 HAVING sum(score) >= 8"""
)

_OWNED = """, rr AS (SELECT r.*, s.parent_symbol_id AS parent, s.name AS source_name, k.symbol_id AS dst, coalesce(k.qualified_name, r.target_qualified_name) AS tname
  FROM r JOIN s ON s.symbol_id = r.source_symbol_id LEFT JOIN s k ON k.symbol_id = r.target_symbol_id WHERE r.target_symbol_id IS NULL OR k.symbol_id IS NOT NULL),
ow AS (SELECT source_symbol_id AS src, dst, tname AS name, reference_kind, line_number FROM rr UNION ALL SELECT parent, dst, tname, reference_kind, line_number FROM rr WHERE parent IS NOT NULL)
"""
_CALLS = "reference_kind IN (" + _list(CALL_KINDS) + ")"


def _tree(edges: str, depth: int, first: str) -> str:
    return f""", top1 AS (SELECT src AS node FROM {edges} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w(node, depth) AS (SELECT node, 0 FROM top1 UNION SELECT x.dst, w.depth + 1 FROM w JOIN {edges} x ON x.src = w.node WHERE x.dst IS NOT NULL AND w.depth < {depth} AND (x.{_CALLS} OR (w.depth = 0 AND {first}))),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT node, CAST(depth AS INTEGER) AS depth, NULL::VARCHAR AS name, true AS is_resolved, 1::BIGINT AS n FROM m
UNION ALL SELECT NULL, CAST(m.depth + 1 AS INTEGER), x.name, false, count(*) FROM m JOIN {edges} x ON x.src = m.node WHERE x.dst IS NULL AND x.name IS NOT NULL AND (x.{_CALLS} OR (m.depth = 0 AND {first})) GROUP BY m.depth, x.name"""


SQL["deps_tree"] = _BASE + _OWNED + _tree("ow", 3, "true")
SQL["flow_tree"] = (
    _BASE
    + _OWNED
    + f""", fc AS (SELECT * FROM ow WHERE {_CALLS}), bases AS (SELECT DISTINCT src, dst FROM ow WHERE reference_kind = 'inheritance' AND dst IS NOT NULL),
al AS (SELECT *, CASE WHEN reference_kind = 'self_call' AND instr(name, '::') > 0 THEN lower(split_part(name, '::', -1)) END AS method FROM (
  SELECT * FROM fc UNION ALL SELECT b.src, x.dst, x.name, x.reference_kind, x.line_number FROM ow x JOIN bases b ON b.dst = x.src WHERE x.reference_kind = 'self_call')),
ch AS (SELECT parent_symbol_id AS src, name AS method, min(symbol_id) AS child FROM s WHERE parent_symbol_id IS NOT NULL AND name = lower(name) GROUP BY 1, 2),
fl AS (SELECT src, dst, name, reference_kind, line_number FROM al WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.src = al.src AND ch.method = al.method)
  UNION ALL SELECT t.src, fc.dst, fc.name, fc.reference_kind, fc.line_number FROM (SELECT DISTINCT al.src, ch.child FROM al JOIN ch ON ch.src = al.src AND ch.method = al.method) t JOIN fc ON fc.src = t.child WHERE fc.dst IS NOT NULL)
"""
    + _tree("fl", 5, "false")
)

SQL["blast_radius_top"] = (
    f"WITH q AS ({SQL['blast_radius']}), t AS (SELECT path, n_symbols, row_number() OVER (ORDER BY n_symbols DESC, path) AS i FROM q)"
    + "SELECT path, 1::BIGINT AS n_files, n_symbols FROM t WHERE i <= 10 UNION ALL SELECT NULL, count(*), CAST(sum(n_symbols) AS BIGINT) FROM t WHERE i > 10 HAVING count(*) > 0"
)
SQL["find_in_path"] = (
    _BASE + "SELECT qualified_name, kind, path, line_start, line_end FROM s JOIN f USING (file_id) WHERE (lower(name) LIKE 'find%' OR lower(qualified_name) LIKE 'find%') AND qualified_name IS NOT NULL AND kind = 'method' AND contains(lower(path), 'app/') ORDER BY qualified_name, symbol_id LIMIT 50"
)
