"""Report tools on small hand-made inputs: SQL in code, table references, layers, unresolved references, tests to run."""

from pyspark.sql import functions as F

from symbolmill.functions import names
from symbolmill.operators import compare, lines, reports, schema, sqlcheck, testing, traverse, usage

FILES = "file_id long, repo_id long, path string, content string"
SYMBOLS = "symbol_id long, file_id long, kind string, qualified_name string, line_start int, line_end int"
TABLES = "repo_id long, table_name string"
COLUMNS = "repo_id long, table_name string, column_name string"
KEYS = "repo_id long, source_table string, source_columns array<string>, target_table string, target_columns array<string>"


def rows(df):
    return {tuple(r) for r in df.collect()}


CODE = """<?php
class Report
{
    public function load()
    {
        $sql = "SELECT u.id, o.Total
            FROM users u
            JOIN `orders` AS o ON o.user_id = u.id
            JOIN gone g ON g.a = u.id
            WHERE o.missing = 1 AND x.y = 2";
    }
    public function store()
    {
        $this->db->query("INSERT INTO orders (total, nope) VALUES (1, 2)");
        $b->from('users', 'm')->set('id', 3)->where('m.id = o.total');
    }
}
"""


def validated(spark, code, language_rows=()):
    files = spark.createDataFrame([(1, 7, "app/Report.php", code), (2, 7, "n.php", None), (3, None, "x.php", "SELECT a FROM users"), *language_rows], FILES)
    symbols = spark.createDataFrame([(10, 1, "class", "Report", 2, 17), (11, 1, "method", "Report::load", 4, 11), (12, 1, "method", "Report::store", 12, 16)], SYMBOLS)
    tables = spark.createDataFrame([(7, "users"), (7, "orders"), (8, "gone"), (7, None), (7, "users")], TABLES)
    columns = spark.createDataFrame([(7, "users", "ID"), (7, "orders", "total"), (7, "orders", "user_id"), (8, "gone", "a")], COLUMNS)
    keys = spark.createDataFrame([(7, "orders", ["User_Id"], "users", ["id"]), (7, "orders", ["total", "user_id"], "users", ["id", "x"])], KEYS)
    return sqlcheck.validate(lines.file_lines(files), tables, columns, keys, symbols)


def test_sql_in_code(spark):
    got = rows(validated(spark, CODE).filter("file_id = 1").select("line_number", "kind", "subject", "symbol_id"))
    assert got == {
        (6, "verified_column", "users.id", 11), (6, "verified_column", "orders.total", 11), (6, "missing_column", "users.sql", 11),
        (8, "verified_column", "orders.user_id", 11), (8, "verified_column", "users.id", 11), (8, "verified_join", "orders.user_id = users.id", 11),
        (9, "missing_table", "gone", 11), (9, "unresolved_alias", "g.a", 11), (9, "verified_column", "users.id", 11),
        (10, "missing_column", "orders.missing", 11), (10, "unresolved_alias", "x.y", 11),
        (14, "verified_column", "orders.total", 12), (14, "missing_column", "orders.nope", 12),
        (15, "verified_column", "users.id", 12), (15, "unresolved_alias", "o.total", 12),
    }
    assert {r.kind for r in validated(spark, CODE).filter("file_id = 3").collect()} == {"missing_table"}
    assert validated(spark, "").filter("file_id = 1").count() == 0


def test_direct_references_to_tables(spark):
    code = "\n".join([
        "$orders_by = 1; $q = 'select x from orders'", "// from orders", "$this->table('orders')->from(\"app.orders\");", "$table = 'ORDERS';", "return 'orders';",
        "$x = 'orders';", "'select * from app.orders, other'", "update if exists orders set a = 1", "$orders = new Orders();", "'from orders_archive'", "delete from using `orders`",
    ])
    files = spark.createDataFrame([(1, 7, "app/Builder/A.php", code), (2, 7, "tests/A.php", "$x = 'orders';"), (3, 8, "app/B.php", "from orders")], FILES)
    symbols = spark.createDataFrame([(11, 1, "method", "Ns\\A::tableName", 5, 5), (12, 1, "method", "Ns\\A::other", 6, 6)], SYMBOLS)
    tables = spark.createDataFrame([(7, "orders"), (7, "app.orders"), (7, None)], "repo_id long, normalized_name string")
    refs = lines.direct_table_references(lines.file_lines(files), tables, symbols, reports.is_test_path("path"))
    assert rows(refs) == {
        (1, 1, "orders", "sql_clause", None), (1, 3, "orders", "query_builder_call", None), (1, 3, "app.orders", "query_builder_call", None), (1, 4, "orders", "table_assignment", None),
        (1, 5, "orders", "quoted_return", 11), (1, 7, "app.orders", "sql_clause", None), (1, 8, "orders", "sql_clause", None), (1, 11, "orders", "sql_clause", None), (2, 1, "orders", "quoted_literal", None),
    }
    used = usage.table_usage(refs, files.select("file_id", "path"), symbols, reports.is_test_path("path"))
    assert rows(used.select("table_name", "layer", "is_test", "owner", "line_number")) == {
        ("orders", "Builder", False, None, 1), ("app.orders", "Builder", False, None, 3), ("orders", "Builder", False, "Ns\\A::tableName", 5), ("orders", "Other", True, None, 1),
    }


def test_layers(spark):
    df = spark.createDataFrame([("app/Routes/a.php", None), ("app/x.php", "Ns\\Controller"), ("lib/Staff/a.php", ""), ("legacy/a.php", None), ("app/modelss/a.php", None), ("Reports", "A::builders")], "path string, s string")
    assert [r[0] for r in df.select(reports.layer_of("path", "s")).collect()] == ["Route", "Controller", "Staff Page", "Legacy Page", "Other", "Builder"]
    named = spark.createDataFrame([("UserService", "a.php"), ("User", "app/handler/a.php"), ("UserRouteTest", "x/route/y"), ("user", "a")], "name string, path string")
    assert [r[0] for r in named.select(reports.planned_layer("name", "path")).collect()] == ["Service", "Handler", "Route", "Other"]
    modules = spark.createDataFrame([("app/Models",), ("app/Http",), ("x",)], "m string")
    assert [r[0] for r in modules.select(reports.module_layer("m")).collect()] == [4, 1, None]


def test_unresolved_references(spark):
    names = [("Phake::mock", "src/a"), ("\\RuntimeException", "src/a"), ("PDO::FETCH", "src/a"), ("App\\Parent", "src/a"), ("Own\\Gone::x", "cache/a"), ("Own\\Gone", "tests/a"), ("Acme\\Http", "src/a"), ("Other\\X", "src/a"), ("Own\\Gone", "src/a"), ("Own\\Gone", "tests/a"), ("Plain", "src/a"), ("Vendored", "src/a")]
    refs = spark.createDataFrame([(i, i, n, None) for i, (n, _) in enumerate(names)] + [(99, 1, None, None), (98, 1, "Own\\Here", 5)], "reference_id long, source_symbol_id long, target_qualified_name string, target_symbol_id long")
    sources = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(names)], "source_symbol_id long, path string")
    external = spark.createDataFrame([("Acme\\Http\\Client",), ("Vendored",), (None,)], "qualified_name string")
    prefixes = spark.createDataFrame([("own",), ("acme",)], "prefix string")
    got = {r.category: (r.n_references, r.n_potential_internal, r.n_production_internal) for r in reports.unresolved_categories(refs, sources, external, prefixes).collect()}
    assert got == {
        "test_framework": (1, 0, 0), "php_builtin": (2, 0, 0), "static_self": (1, 0, 0), "generated_cache": (1, 0, 0), "test_only": (2, 0, 0), "external_vendor": (3, 0, 0), "potential_internal_miss": (2, 2, 2),
    }


def test_suggestions(spark):
    symbols = spark.createDataFrame([(1, "findUser", "App\\Repo::findUser"), (2, "find_user", "x"), (3, "User", "App\\FindUser"), (4, "zzz", "q"), (5, None, "finduser")], "symbol_id long, name string, qualified_name string")
    got = {r.symbol_id: r.score for r in compare.suggest_symbols(symbols, "FindUser").collect()}
    words = {1: 3 * (12 + 8), 2: 2 * 12, 3: 12 + 3 * 8}
    assert got == {1: 120 + 100 + 70 + 50 + 40 + words[1], 2: 120 + 50 + words[2], 3: 70 + 40 + words[3]}


def test_tests_of_a_symbol(spark):
    paths = spark.createDataFrame([("tests/Billing/InvoiceServiceTest.php",), ("tests/Other/ZebraTest.php",), ("tests/Api/InvoiceMapTest.php",)], "path string")
    dependents = spark.createDataFrame([("app/Billing/InvoicePrinter.php", "B\\InvoicePrinter", 1), ("app/Billing/InvoicePrinter.php", "A\\X", 2)], "path string, qualified_name string, depth int")
    seeds = testing.seeds_of(dependents, "app/Billing/InvoiceService.php", "InvoiceService")
    assert rows(seeds) == {("app/Billing/InvoicePrinter.php", 8, "B\\InvoicePrinter"), ("app/Billing/InvoiceService.php", 12, "InvoiceService")}
    text = spark.createDataFrame([("tests/Other/ZebraTest.php", "use App\\InvoiceService as S;"), ("tests/Other/ZebraTest.php", "new InvoiceService();"), ("tests/Other/ZebraTest.php", "new InvoiceService();"), ("tests/Api/InvoiceMapTest.php", "InvoiceServices")], "path string, line string")
    hints = testing.content_hints(text, "InvoiceService", "App\\InvoiceService")
    assert rows(hints) == {("tests/Other/ZebraTest.php", r, s) for r, s in (("imports", 36), ("mentions", 18), ("constructs", 28), ("names", 8))}
    ranked = {r.path: (r.score, r.reasons) for r in testing.rank_tests(paths, seeds, hints).collect()}
    # companion 12 + 8; tokens billing and invoice of both seeds 2 * 4, and 2 for each seed; folder billing of both seeds
    assert ranked["tests/Billing/InvoiceServiceTest.php"] == (20 + 8 + 4 + 2, "companion name, name tokens, same area")
    assert ranked["tests/Other/ZebraTest.php"] == (90, "constructs, imports, mentions, names")
    assert ranked["tests/Api/InvoiceMapTest.php"] == (4 + 4, "name tokens") and len(ranked) == 3
    stems = spark.createDataFrame([("a/UserServiceTest.php", True), ("a/AService.php", False), ("x/FooReportBuilder.ts", False)], "p string, t boolean")
    assert [r[0] for r in stems.select(testing.comparable_stem("p", F.col("t"))).collect()] == ["user", "aservice", "foo"]


def test_tables_found_and_drawn(spark):
    tables = spark.createDataFrame([(1, 1, "a.users", 5, 3), (2, 1, "b.users", None, 4), (3, 2, "users", 5, 1), (4, 3, "x.users", 5, 1), (5, 1, None, 5, 1)], "table_id long, repo_id long, normalized_name string, file_id long, line_start int")
    assert rows(schema.find_table(tables, "users")) == {(1, "a.users", "ambiguous"), (1, "b.users", "ambiguous"), (2, "users", "exact"), (3, "x.users", "suffix")}
    keys = spark.createDataFrame([(1, 1, "k", ["U"], "b.users", ["Id"]), (2, 2, None, ["z"], "nowhere", ["y"])], "foreign_key_id long, table_id long, constraint_name string, source_columns array<string>, normalized_target_table string, target_columns array<string>")
    edges = schema.full_edges(tables, keys)
    nodes = spark.createDataFrame([(1, "a.users", 0), (1, "b.users", 1)], "repo_id long, table_name string, depth int")
    drawn = {(r.direction, r.source_table, r.target_table, r.depth) for r in schema.graph_edges(edges, nodes, 2).collect()}
    assert drawn == {("outbound", "a.users", "b.users", 0), ("inbound", "a.users", "b.users", 1), ("outbound", "b.users", "nowhere", 1)}
    assert {r.depth for r in schema.graph_edges(edges, nodes, 1).collect()} == {0}
    files = spark.createDataFrame([(5, "db/a.sql")], "file_id long, path string")
    columns = spark.createDataFrame([(1, "a.users", "u", "int"), (9, "a.users", "q", "int")], "repo_id long, table_name string, column_name string, data_type string")
    cards = {(r.section, r["name"], r.detail) for r in schema.table_cards(tables, columns, edges, files).filter("table_name = 'a.users'").collect()}
    assert cards == {("file", "db/a.sql", "3"), ("column", "u", "int"), ("references", "k", "u -> b.users(id)")}


REFS = "reference_id long, source_symbol_id long, target_symbol_id long, target_qualified_name string, reference_kind string, line_number int"
GRAPH = "symbol_id long, parent_symbol_id long, name string, qualified_name string"


def test_flow_and_dependencies(spark):
    symbols = spark.createDataFrame([(i, None, n, f"Ns\\{n}") for i, n in enumerate(["A", "B", "C", "Base", "E"], 1)] + [(11, 1, "make", "Ns\\A::make"), (12, 4, "run", "Ns\\Base::run"), (13, 3, "Own", "Ns\\C::Own")], GRAPH)
    refs = [(1, 1, 2, "ns\\b", "instantiation", 5), (2, 1, 4, "ns\\base", "inheritance", 1), (3, 1, 5, "ns\\e", "class_reference", 6), (4, 2, 3, "ns\\c", "static_call", 5), (4, 2, 3, "ns\\c", "static_call", 5)]
    more = [(5, 12, 11, "ns\\base::make", "self_call", 9), (6, 11, 5, "ns\\e", "instantiation", 3), (7, 5, None, "gone\\x", "static_call", 2), (8, 5, None, "gone\\y", "type_hint", 2), (9, 3, 99, "removed", "static_call", 1)]
    owned = traverse.owned_references(spark.createDataFrame(refs + more, REFS), symbols)
    start = spark.createDataFrame([(1,)], "node long")
    reached = lambda df: {(r.node, r.depth) for r in df.collect() if r.is_resolved}
    leaves = lambda df: {(r["name"], r.depth, r.n) for r in df.collect() if not r.is_resolved}
    calls = traverse.flow_references(owned, symbols)
    # Base::run calls $this->make(), which A overrides: what A::make makes is followed instead
    assert reached(traverse.tree(calls, start, 5, first_kinds=traverse.CALL_KINDS)) == {(1, 0), (2, 1), (5, 1), (3, 2)}
    assert reached(traverse.tree(calls, start, 1, first_kinds=traverse.CALL_KINDS)) == {(1, 0), (2, 1), (5, 1)}
    forward = traverse.tree(owned, start, 2)
    assert reached(forward) == {(1, 0), (2, 1), (4, 1), (5, 1), (3, 2), (11, 2)} and leaves(forward) == {("gone\\x", 2, 1)}
    assert leaves(traverse.tree(owned, spark.createDataFrame([(5,)], "node long"), 1)) == {("gone\\x", 1, 1), ("gone\\y", 1, 1)}
    assert traverse.tree(owned, start.limit(0), 3).count() == 0


def test_routes_names_and_reports(spark):
    paths = ["app/Routes/Root/Companies/CostCenters/Assets.php", "app/Routes/CostCenterAssetsInterface.php", "app/Routes/CostCenterAssets.php", "app/Routes/Jobs/Labors.php", "app/Routes/Labels.php", "app/Other/X.php", "app/Routes/Classes/Entries/Foo_bar.php", "app/Routes/ClassEntryFooBar.php"]
    files = spark.createDataFrame(list(enumerate(paths)), "file_id long, path string")
    symbols = spark.createDataFrame([(i, "class", p, None) for i, p in enumerate(paths)] + [(0, "method", "q", "q")], "file_id long, kind string, name string, qualified_name string")
    families = compare.route_families(symbols, files)
    assert {r.path for r in families.collect() if r.display_path == "CostCenterAssets"} == {"app/Routes/CostCenterAssetsInterface.php"}
    assert rows(compare.family_pairs(families)) == {("CostCenters/Assets", "CostCenterAssets"), ("Jobs/Labors", None), ("Classes/Entries/Foo_bar", None)}
    assert [r[0] for r in spark.createDataFrame([("entries",), ("classes",), ("class",), ("jobs",), ("s",), ("ies",)], "w string").select(names.singular(F.col("w"))).collect()] == ["entry", "classes", "class", "job", "s", "ie"]
    df = spark.createDataFrame([(["A", '"a"', "b", "B.c", "b.C"], "a.b*(c)")], "n array<string>, t string")
    assert df.select(names.distinct_names("n")).first()[0] == ["A", "b", "B.c"] and df.select(names.regex_quoted("t")).first()[0] == r"a\.b\*\(c\)"
    ages = spark.createDataFrame([(5,), (61,), (7200,), (200_000,)], "s long")
    assert [r[0] for r in ages.select(reports.age_text(F.col("s"))).collect()] == ["5s", "1m", "2h", "2d"]
    blast = spark.createDataFrame([(f"f{i:02}", 20 - i) for i in range(13)], "path string, n_symbols long")
    top = reports.blast_top(blast)
    assert top.count() == 11 and top.filter("path is null").select("n_files", "n_symbols").first() == (3, 10 + 9 + 8)
    symbols = spark.createDataFrame([(1, 0, "method", "runAll", "A\\B::runAll", 1, 2), (2, 5, "class", "Run", "A\\Run", 1, 9), (3, 0, "method", None, None, 1, 1)], "symbol_id long, file_id long, kind string, name string, qualified_name string, line_start int, line_end int")
    look = lambda *a, **k: [r.qualified_name for r in compare.find(symbols, files, *a, **k).collect()]
    assert look("a\\b") == ["A\\B::runAll"] and look("run*") == ["A\\B::runAll", "A\\Run"] and look("run", kind="class") == ["A\\Run"] and look("run", path="OTHER") == ["A\\Run"]
    assert look("run", limit=0) == ["A\\B::runAll"] and look("nothing") == []
