import pytest
from pyspark.sql import functions as F

from symbolmill import catalog
from symbolmill.sources import config, database, files


def test_discovery(spark, tmp_path):
    (tmp_path / "repo/app").mkdir(parents=True)
    (tmp_path / "extra").mkdir()
    (tmp_path / "repo/app/A.php").write_text("<?php\n")
    (tmp_path / "repo/app/b.sql").write_text("SELECT 1")
    (tmp_path / "repo/app/c.txt").write_text("no")
    (tmp_path / "extra/D.php").write_text("<?php")
    got = files.discover(spark, str(tmp_path / "repo"), {"Shared Lib": str(tmp_path / "extra")}).collect()
    assert {(r.path, r.language, r.lines_of_code) for r in got} == {("app/A.php", "php", 2), ("app/b.sql", "sql", 1), ("@shared-lib/D.php", "php", 1)}
    assert files.discover(spark, str(tmp_path / "repo"), exclude=[r"\.sql$"]).count() == 1
    with pytest.raises(ValueError):
        files.source_label(" / ")
    with pytest.raises(ValueError):
        files.discover(spark, str(tmp_path / "repo"), {"a b": "x", "a-b": "y"})


def test_merges(spark, tmp_path):
    schema = "id long, repo_id long, path string, language string, hash string"
    stored = spark.createDataFrame([(1, 1, "a", "php", "h1"), (2, 1, "b", "php", "h2")], schema)
    found = spark.createDataFrame([(8, 1, "b", "sql", "h9"), (9, 1, "c", "sql", "h3")], schema)
    assert {tuple(r) for r in files.upsert_files(stored, found).collect()} == {(1, 1, "a", "php", "h1"), (2, 1, "b", "php", "h9"), (9, 1, "c", "sql", "h3")}
    assert files.replace_by(stored, found, stored.filter("id = 1"), "id").count() == 3
    symbols = spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long")
    refs = spark.createDataFrame([(1, 10, 20), (2, 20, 10), (3, 20, 20)], "id long, source_symbol_id long, target_symbol_id long")
    out = files.delete_files({"files": stored, "symbols": symbols, "symbol_references": refs}, stored.filter("id = 1"))
    assert {tuple(r) for r in out["symbol_references"].collect()} == {(2, 20, None), (3, 20, 20)}
    assert out["symbols"].count() == 1 and out["files"].count() == 1
    empty = {"db_tables": catalog.empty(spark, "db_tables"), "symbols": catalog.empty(spark, "symbols")}
    files.export_index(empty, str(tmp_path / "x"))
    back = files.import_index(spark, str(tmp_path / "x"), list(empty))
    assert back["symbols"].schema == empty["symbols"].schema and back["db_tables"].count() == 0


def test_catalog_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "repo_id long, v string")
    catalog.write(df, str(tmp_path), "t", ("repo_id",))
    catalog.write(df.filter("repo_id = 2").withColumn("v", F.lit("c")), str(tmp_path), "t", ("repo_id",))
    assert {(r.repo_id, r.v) for r in catalog.read(spark, str(tmp_path), "t").collect()} == {(1, "a"), (2, "c")}


def test_config_and_sections():
    got = config.read_config("additionalSources: {lib: /x}\nexclude: [tmp/]\npostgres: {dbName: d}\n")
    assert got["exclude"][-1] == "tmp/" and got["additional_sources"] == {"lib": "/x"} and got["postgres"] == {"db_name": "d"}
    once = config.inject_section("# Title\n", "text", "<!-- b -->", "<!-- e -->")
    assert config.inject_section(once, "text", "<!-- b -->", "<!-- e -->") == once
    assert "new" in config.inject_section(once, "new", "<!-- b -->", "<!-- e -->") and "text" not in config.inject_section(once, "new", "<!-- b -->", "<!-- e -->")
    assert len(config.within("line\n" * 100, 80)) <= 80
    assert database.settings({"host": "h"}, {"port": "1"}, {"PGUSER": "u"}) == {"host": "h", "port": "1", "database": "postgres", "user": "u", "password": ""}


ENTITY = """<?php
namespace App;
use Doctrine\\ORM\\Mapping as ORM;
#[ORM\\Entity]
#[ORM\\Table(name: 'Users')]
class User extends Base
{
    #[ORM\\Column(name: 'user_id', type: 'integer')]
    private int $id;
    /** @ORM\\JoinColumn(name="group_id", referencedColumnName="ID") */
    private ?Group $group = null;
    private string $plain;
    public function __construct(#[ORM\\Column('mail')] private string $mail) { $this->load(); new Job(); }
    public function load(): void { throw new Oops('x'); }
}
/** @Table(name="jobs") */
class Job { /** @Column(name="kind") */ public $kind; }
class None { #[ORM\\Column(name: 'x')] public $x; }
"""


def test_index_from_files_to_queries(spark, tmp_path):
    from symbolmill.plans import index
    from symbolmill.sources import build

    (tmp_path / "repo/app").mkdir(parents=True)
    (tmp_path / "repo/db/initial").mkdir(parents=True)
    (tmp_path / "extra").mkdir()
    (tmp_path / "repo/app/User.php").write_text(ENTITY)
    (tmp_path / "repo/db/initial/source.sql").write_text("CREATE TABLE users (user_id INT NOT NULL, group_id INT REFERENCES groups (id));\nCREATE TABLE groups (id INT DEFAULT 1);\n")
    (tmp_path / "repo/db/1_0_0_1.sql").write_text("ALTER TABLE users RENAME COLUMN group_id TO team_id;\n")
    (tmp_path / "extra/Q.php").write_text("<?php class Q { function a() { return 'select users.user_id from users where users.gone = 1'; } }")
    folder = str(tmp_path / "index")
    assert set(build.build_catalog(spark, {"one": str(tmp_path / "repo")}, folder, {"lib": str(tmp_path / "extra")})) == {"repos", "files", "symbols", "symbol_references", "db_tables", "db_columns", "db_foreign_keys", "sql_statements"}
    run = lambda name: index.QUERIES[name](spark, folder)
    edges = {(r.qualified_name, r.n_incoming) for r in run("module_table").collect()}
    assert edges == {("App\\User", 0), ("App\\Job", 1), ("App\\None", 0), ("Q", 0)}
    assert {(r.table_name, r.n_out, r.n_in) for r in run("table_summary").collect()} == {("users", 1, 0), ("groups", 0, 1)}
    assert {(r.table_name, r.section, r["name"]) for r in run("table_cards_replayed").collect() if r.section == "column"} == {("users", "column", "user_id"), ("users", "column", "team_id"), ("groups", "column", "id")}
    found = {(r.kind, r.subject) for r in run("sql_validate_replayed").collect() if r.subject.startswith("users.")}
    assert {("verified_column", "users.user_id"), ("missing_column", "users.gone")} <= found
    assert {(r.exception, r.source) for r in run("exception_summary").collect()} == {("App\\Oops", "throw")}
    again = build.repositories(spark, {"one": "x", "two": "y"}, catalog.read(spark, folder, "repos").withColumn("created_at", F.lit("2020-01-01").cast("timestamp_ntz")))
    assert sorted((r.name, r.created_at.year == 2020) for r in again.collect()) == [("one", True), ("two", False)]


def test_orm_links(spark):
    from symbolmill.operators import extract

    df = spark.createDataFrame([(1, "php", ENTITY), (2, "php", None), (3, "sql", ENTITY)], "file_id long, language string, content string")
    assert {tuple(r)[1:] for r in extract.orm_links(df).collect()} == {
        ("App\\User", "entity_table", "users", None, None), ("App\\User::$id", "entity_column", "users", "user_id", None), ("App\\User::$group", "entity_join_column", "users", "group_id", "id"),
        ("App\\User::$mail", "entity_column", "users", "mail", None), ("App\\Job", "entity_table", "jobs", None, None), ("App\\Job::$kind", "entity_column", "jobs", "kind", None),
    }


def test_last_root_wins(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.php").write_text(n)
    got = files.discover(spark, str(tmp_path / "a"), {"l": str(tmp_path / "b")})
    assert {(r.path, r.content) for r in got.collect()} == {("x.php", "a"), ("@l/x.php", "b")}
