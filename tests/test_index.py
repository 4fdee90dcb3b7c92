"""Index operators on small hand-made inputs."""

import random

from pyspark.sql import functions as F

from symbolmill.functions.names import schema_name, unquote_name
from symbolmill.functions.php_source import Source
from symbolmill.operators import compare, extract, lines, reports, schema, traverse, usage
from symbolmill.operators.resolve import resolve_references
from symbolmill.plans import index


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_names(spark):
    df = spark.createDataFrame([(" `Dbo`.[Users] ",), ('"A"..b',), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(schema_name("n")).collect()] == ["dbo.users", "a.b", None, ""]
    assert df.select(unquote_name("n")).first()[0] == "Dbo.Users"


def test_resolution_falls_back_to_the_class(spark):
    symbols = spark.createDataFrame([(1, "A\\B", None), (2, "a\\b", None), (3, "A\\B::m", 1), (4, "f", None)], "symbol_id long, qualified_name string, parent_symbol_id long")
    refs = spark.createDataFrame([(1, "\\A\\B"), (2, "a\\b::M"), (3, "a\\b::none"), (4, "::x"), (5, None), (6, "zz")], "reference_id long, target_qualified_name string")
    got = {(r.reference_id, r.resolved_symbol_id, r.how) for r in resolve_references(refs, symbols).collect()}
    assert got == {(1, 2, "exact"), (2, 3, "exact"), (3, 2, "class"), (4, None, None), (5, None, None), (6, None, None)}


def test_traversals_agree_on_random_graphs(spark):
    rnd = random.Random(7)
    for _ in range(3):
        pairs = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(16)]
        edges, seeds = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,)], "node long")
        loop = rows(traverse.shortest_paths(edges, seeds, 3))
        assert loop == rows(traverse.recursive_reach(edges, seeds, 3))
        assert {(n, d) for n, d, _ in loop} == rows(traverse.reach(edges, seeds, 3, seed_seen=False))


def test_lift_outermost_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 4)], "node long, parent long")
    assert rows(traverse.outermost(nodes)) == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 5, 0), (6, 1, 4)}
    edges = spark.createDataFrame([(10, 3), (1, 20)], "src long, dst long")
    lift = nodes.filter("parent is not null")
    got = rows(traverse.reach(edges, spark.createDataFrame([(10,)], "node long"), 3, lift=lift))
    assert got == {(10, 0), (3, 1), (2, 1)}
    assert traverse.clamp(None, 3, 1, 10) == 3 and traverse.clamp(99, 3, 1, 10) == 10


def test_foreign_key_graph(spark):
    """accounts <- users <- orders <- payments, from users: depths 0, 1, 1, 2."""
    tables = spark.createDataFrame([(i, 1, n) for i, n in enumerate(["accounts", "users", "orders", "payments"])], "table_id long, repo_id long, normalized_name string")
    keys = spark.createDataFrame([(1, 1, "accounts"), (2, 2, "users"), (3, 3, "orders"), (4, 3, "gone"), (3, 3, "orders")], "foreign_key_id long, table_id long, normalized_target_table string")
    seeds = spark.createDataFrame([(1, "users")], "repo_id long, table_name string")
    assert rows(schema.key_neighbourhood(tables, keys, seeds, 2)) == {(1, "users", 0), (1, "accounts", 1), (1, "orders", 1), (1, "payments", 2)}
    assert rows(schema.table_summary(tables, keys)) == {(1, "accounts", 0, 1), (1, "users", 1, 1), (1, "orders", 1, 1), (1, "payments", 2, 0)}


def test_catalog_rows_are_grouped(spark):
    cols = spark.createDataFrame([("t", "b", "int", 2), ("t", "a", "text", 1)], "table_name string, column_name string, data_type string, ordinal_position int")
    keys = spark.createDataFrame([("t", "k", "a", "u", "x", 1), ("t", "k", "b", "u", "y", 2), ("t", "k", "a", "u", "x", 1)], "table_name string, constraint_name string, column_name string, target_table string, target_column string, position int")
    got = schema.catalog_tables(cols, keys).first()
    assert [c.column_name for c in got.columns] == ["a", "b"] and got.foreign_keys[0].source_columns == ["a", "b"] and got.foreign_keys[0].target_columns == ["x", "y"]


def test_rates(spark):
    df = spark.createDataFrame([(1, 6), (999, 1000), (1000, 1000), (0, 0)], "n long, d long")
    assert [r[0] for r in df.select(reports.rate(F.col("n"), F.col("d"))).collect()] == [16.7, 99.9, 100.0, 0.0]


def test_enclosing_symbol_prefers_methods(spark):
    symbols = spark.createDataFrame([(1, 1, "class", 1, 50), (2, 1, "method", 10, 20), (3, 1, "property", 12, 12)], "symbol_id long, file_id long, kind string, line_start int, line_end int")
    points = spark.createDataFrame([(1, 12), (1, 30), (1, 99), (2, 1)], "file_id long, line_number int")
    assert rows(lines.enclosing(points, symbols)) == {(1, 12, 2), (1, 30, 1), (1, 99, None), (2, 1, None)}


def test_members_compared(spark):
    members = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", "z"), (2, "b", None), (2, "c", "y"), (2, "d", "q")], "owner_id long, member string, signature string")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")
    assert rows(compare.compare_members(pairs, members)) == {(1, 2, 1, 1, 2, 1)}
    assert rows(compare.missing_everywhere(pairs, members)) == {(1, "a")}


def test_stems_suggestions_and_changes(spark):
    df = spark.createDataFrame([("tests/app/UserServiceTest.php",), ("app/UserService.php",)], "path string")
    assert [r[0] for r in df.select(compare.stem("path")).collect()] == ["user", "user"]
    files = spark.createDataFrame([(1, 1, "app/UserService.php"), (2, 1, "tests/app/UserServiceTest.php"), (3, 2, "tests/UserTest.php")], "file_id long, repo_id long, path string")
    assert [(r.production_id, r.test_id) for r in compare.companion_tests(files, reports.is_test_path("path")).collect()] == [(1, 2)]
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (1, "z", "3")], "repo_id long, path string, hash string")
    b = spark.createDataFrame([(1, "x", "1"), (1, "y", "9"), (1, "n", "4")], "repo_id long, path string, hash string")
    assert rows(compare.changeset(a, b)) == {(1, "y", "modified"), (1, "z", "deleted"), (1, "n", "added")}


PHP = """<?php
namespace App\\Models;
use Vendor\\Base as Model;
use App\\Contracts\\{Named, Dated};
abstract class User extends Model implements Named, Dated
{
    use HasTimes;
    public const ROLE = 'x';
    private static ?Name $name = null;
    public function __construct(private readonly Mailer $mailer, int $n) {}
    protected function run(Input $in): ?Output
    {
        $x = new Job(); // new Fake()
        Log::write("Nope::call()");
        $this->helper(self::ROLE, Config::KEY, Event::class);
        return null;
    }
    abstract function helper(): void;
}
function top(): void {}
"""


def test_php_source():
    s = Source(PHP)
    assert [(x.kind, x.qualified_name, x.visibility, x.line_start, x.line_end) for x in s.symbols if x.kind not in ("property", "constant")] == [
        ("class", "App\\Models\\User", None, 5, 19), ("method", "App\\Models\\User::__construct", "public", 10, 10),
        ("method", "App\\Models\\User::run", "protected", 11, 17), ("method", "App\\Models\\User::helper", "public", 18, 18), ("function", "App\\Models\\top", None, 20, 20),
    ]
    assert {x.qualified_name for x in s.symbols if x.kind in ("property", "constant")} == {"App\\Models\\User::ROLE", "App\\Models\\User::$name", "App\\Models\\User::$mailer"}
    assert {(r.kind, r.target) for r in s.references} == {
        ("inheritance", "vendor\\base"), ("implementation", "app\\contracts\\named"), ("implementation", "app\\contracts\\dated"), ("trait_use", "app\\models\\hastimes"),
        ("type_hint", "app\\models\\name"), ("type_hint", "app\\models\\mailer"), ("type_hint", "app\\models\\input"), ("type_hint", "app\\models\\output"),
        ("instantiation", "app\\models\\job"), ("static_call", "app\\models\\log::write"), ("self_call", "app\\models\\user::helper"),
        ("static_access", "app\\models\\config::key"), ("class_reference", "app\\models\\event"),
    }


def test_extractors_on_tables(spark):
    files = spark.createDataFrame(
        [(1, "php", PHP), (2, "sql", "-- x; y\nCREATE TABLE a (\n  x INT,\n  CONSTRAINT fk FOREIGN KEY (x) REFERENCES `b` (y)\n);\n\nDROP TABLE c;"), (3, "php", None), (4, "sql", ""), (5, None, PHP)],
        "file_id long, language string, content string",
    )
    assert extract.php_symbols(files).count() == 8
    assert rows(extract.ddl_columns(files)) == {(2, 1, "a", "x", "int", True, None, 1, 3)}
    key = extract.ddl_keys(files).first()
    assert (key.table_name, key.constraint_name, key.source_columns, key.target_table, key.target_columns) == ("a", "fk", ["x"], "b", ["y"])
    assert [(r.line_start, r.text[:4]) for r in extract.sql_statements(files).collect()] == [(1, "-- x"), (7, "DROP")]
    mapped = spark.createDataFrame([(1, "php", '#[ORM\\Table(name: "users")] #[Column(name: "id")] $this->args[\'k\'] $this->args["k"]')], "file_id long, language string, content string")
    assert rows(extract.orm_mappings(mapped)) == {(1, "Table", "users"), (1, "Column", "id")}
    assert rows(extract.context_keys(mapped)) == {(1, "k")}


def test_php_symbols_of_all_files(spark, tmp_path):
    """Against what a generator of sources says it wrote; only one of the files has rows in ``symbols``."""
    rnd, files, want = random.Random(5), [], set()
    for i in range(12):
        text, at = ["<?php", f"namespace N{i};"], 2
        for k in range(rnd.randrange(4)):
            kind, own = rnd.choice(["class", "interface", "trait"]), f"N{i}\\T{k}"
            start, body = at + 1, [f"{kind} T{k}", "{"]
            for m in range(rnd.randrange(3)):
                vis = rnd.choice(["public", "protected", "private"])
                body += [f"    {vis} function m{m}(int $a)", "    {", "        return 'function x() {';", "    }"]
                want.add((i, "method", f"m{m}", f"{own}::m{m}", own, vis, at + len(body) - 3, at + len(body)))
            text, at = text + [*body, "}"], at + len(body) + 1
            want.add((i, kind, f"T{k}", own, None, None, start, at))
        text, at = [*text, "function f() {}"], at + 1
        want.add((i, "function", "f", f"N{i}\\f", None, None, at, at))
        files.append((i, "PHP" if i % 2 else "php", "\n".join(text)))
    spark.createDataFrame([*files, files[0], (90, "php", None), (91, "sql", files[0][2])], "file_id long, language string, content string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(0,)], "file_id long").write.parquet(f"{tmp_path}/symbols.parquet")
    got = index.QUERIES["php_symbols_all"](spark, str(tmp_path))
    cols = ("file_id", "kind", "name", "qualified_name", "parent_name", "visibility", "line_start", "line_end")
    assert rows(got.select(*cols)) == want and got.count() == len(want)
    assert {r.file_id for r in index.QUERIES["php_symbols"](spark, str(tmp_path)).collect()} == {0}


def test_php_metadata(spark):
    text = """<?php
namespace App;
use Lib\\Errors\\{Gone, Late};
use Lib\\Wrong as W;
/** Keeps. */
#[Attr(1)]
final class Box extends W implements \\Countable, Named
{
    use HasA, HasB;
    /** The size. */
    private static ?int $size = 1;
    /** not of the next */ // since this stands between
    const A = 1;
    public function __construct(private readonly Late $late) {}
    /**
     * @throws Gone|\\RuntimeException when full
     */
    public static function put(int $a, string $b = ')'): ?W
    {
        // throw new Commented();
        $x = 'throw new Quoted()' . $this->args['k'] . $this->params["p"] . $this->args['k'];
        try { throw new W\\Deep(); } catch (Gone | \\LogicException $e) { throw new Gone(); } catch (Late) { throw new \\DomainException(); }
    }
}
/** @throws Own */
function f(): void { throw new Own(); }
"""
    df = extract.php_symbols(spark.createDataFrame([(1, "php", text)], "file_id long, language string, content string"))
    s = {r.qualified_name: r.asDict(recursive=True) for r in df.collect()}
    meta = {k: {a: b for a, b in v["metadata"].items() if b is not None} for k, v in s.items()}
    assert meta == {
        "App\\Box": {"extends": "Lib\\Wrong", "implements": ["Countable", "App\\Named"], "traits": ["App\\HasA", "App\\HasB"]},
        "App\\Box::$size": {"static": True}, "App\\Box::A": {}, "App\\Box::__construct": {"magic": True}, "App\\Box::$late": {"promoted": True, "readonly": True},
        "App\\Box::put": {
            "static": True, "contextArgs": ["k"], "contextParams": ["p"], "thrownExceptions": ["DomainException", "Lib\\Errors\\Gone", "Lib\\Wrong\\Deep"],
            "caughtExceptions": ["Lib\\Errors\\Gone", "Lib\\Errors\\Late", "LogicException"], "documentedThrows": ["Lib\\Errors\\Gone", "RuntimeException"],
        },
        "App\\f": {"thrownExceptions": ["App\\Own"], "documentedThrows": ["App\\Own"]},
    }
    put = s["App\\Box::put"]
    assert (put["signature"], put["return_type"]) == ("put(int $a, string $b = ')'): ?W", "?W") and put["docblock"].startswith("/**\n     * @throws Gone")
    assert [s[k]["docblock"] for k in ("App\\Box", "App\\Box::$size", "App\\Box::A", "App\\f")] == ["/** Keeps. */", "/** The size. */", None, "/** @throws Own */"]
    assert [s[k]["return_type"] for k in ("App\\Box::$size", "App\\Box::$late", "App\\f")] == ["?int", "Late", "void"]


def test_ddl_tables_of_all_files(spark, tmp_path):
    files = [(1, "sql", "CREATE TABLE a (x INT); CREATE TABLE b (x INT);"), (2, "sql", "CREATE TABLE c (x INT);"), (3, "sql", None), (4, "php", "<?php")]
    spark.createDataFrame(files, "file_id long, language string, content string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(1, "a"), (1, "gone"), (1, None), (4, "p")], "file_id long, normalized_name string").write.parquet(f"{tmp_path}/db_tables.parquet")
    got = index.QUERIES["ddl_tables_all"](spark, str(tmp_path))
    assert rows(got) == {(1, "a", True, True), (1, "b", True, False), (1, "gone", False, True), (2, "c", True, False)} and got.count() == 4


def test_usage(spark):
    text = "a();\n\n{\n  b();\n}\n" + "".join(f"x{i}();\n" for i in range(20))
    files = spark.createDataFrame([(1, "p", text)], "file_id long, path string, content string")
    symbols = spark.createDataFrame([(1, 1, "method", 1, 5), (2, 1, "method", 5, 25), (3, 1, "class", 1, 25), (4, 1, "method", 1, 99)], "symbol_id long, file_id long, kind string, line_start int, line_end int")
    got = dict(rows(usage.body_previews(files, symbols)))
    assert got[1] == "b();" and got[2].endswith("x7();\n...") and set(got) == {1, 2}
    code = spark.createDataFrame([(1, "p", "$q = 'SELECT id FROM users u JOIN gone g';\n// SELECT x FROM users\n$from = users();"), (2, "q", None)], "file_id long, path string, content string")
    tables = spark.createDataFrame([("users",), (None,)], "normalized_name string")
    assert rows(usage.literal_sql_tables(lines.file_lines(code), tables)) == {(1, 1, "users", True), (1, 1, "gone", False)}
    columns = spark.createDataFrame([("users", "id"), ("other", "id")], "table_name string, column_name string")
    assert rows(usage.column_mentions(lines.file_lines(code), columns)) == {(1, 1, "users", "id")}
    seeds = spark.createDataFrame([("a", 3, "z"), ("a", 5, "y"), ("a", 5, "x"), ("b", 1, "q")], "path string, weight int, via string")
    assert rows(usage.dedup_seeds(seeds, "path", "weight", "via")) == {("a", 5, "x"), ("b", 1, "q")}
    hints = spark.createDataFrame([("a", "r", 8), ("a", "r", 8), ("a", "s", 2)], "path string, reason string, score int")
    assert [(r.score, r.reasons) for r in usage.merge_hints(hints, ["path"]).collect()] == [(10, ["r", "s"])]
    assert [r.score for r in usage.merge_hints(hints, ["path"], False).collect()] == [18]


def test_line_windows_and_blocks(spark):
    text = "UPDATE t\n  SET payload = 1;\nSELECT 1\nFROM t\n\nfunction x() {\nreturn payload;\n"
    df = lines.file_lines(spark.createDataFrame([(1, "p", text)], "file_id long, path string, content string"))
    assert rows(lines.write_context(df, "PAYLOAD")) == {(1, 2, True), (1, 7, False)}
    assert rows(lines.sql_blocks(df)) == {(1, 1, 2, 2), (1, 3, 4, 2)}
