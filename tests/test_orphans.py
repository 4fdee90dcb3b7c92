import datetime as dt

from symbolmill.operators.orphans import orphans_by_period, reference_orphans

SYMBOLS = "symbol_id long, qualified_name string, indexed_at timestamp_ntz, removed_at timestamp_ntz, recorded_at string"
EXTERNAL = "symbol_id long, qualified_name string, kind string, package_name string"
REFS = "reference_id long, target_qualified_name string, target_symbol_id long, recorded_at timestamp_ntz, key string"
TABLES = "table_id long, repo_id long, normalized_name string, indexed_at timestamp_ntz, removed_at timestamp_ntz"
KEYS = "foreign_key_id long, table_id long, target_table string, normalized_target_table string, recorded_at timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n) if n is not None else None


def run(spark, symbols=(), external=(), refs=(), tables=(), keys=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    df = reference_orphans(make(symbols, SYMBOLS), make(external, EXTERNAL), make(refs, REFS), make(tables, TABLES), make(keys, KEYS))
    return df, {(r.ref_field, r.ref_id, r.cause, r.period) for r in df.collect()}


def test_names_and_ids(spark):
    symbols = [
        (1, "\\A\\B", day(10), day(20), "x"), (2, " a\\b ", day(30), None, "x"), (3, "A\\C", day(0), None, "x"), (3, "A\\C", day(0), None, "x"),
        (4, "A\\C::m", day(50), None, "x"), (5, None, day(0), None, "x"), (6, "A\\Never", None, None, "x"), (7, "A\\Zero", day(5), day(5), "x"),
    ]
    refs = [
        (10, "a\\b", None, day(15), "k"), (11, "\\A\\B", None, day(25), "k"), (12, "A\\B", None, day(5), "k"), (13, "a\\b", None, day(35), "k"), (13, "a\\b", None, day(35), "k"),
        (14, "A\\C::m", None, day(15), "k"), (15, "A\\C::other", None, day(15), "k"), (16, "nothing::x", None, day(1), "k"), (17, None, None, day(1), "k"), (18, "  ", None, day(1), "k"),
        (19, "Ext\\X", 900, day(1), "k"), (20, "a\\c", 1, day(25), "k"), (21, "a\\c", 77, day(1), "k"), (22, "a\\never", None, day(1), "k"), (23, "a\\zero", None, day(6), "k"), (24, "a\\c", None, None, "k"),
        (25, "a\\b", None, day(20), "k"), (26, "a\\b", None, day(10), "k"),
    ]
    df, got = run(spark, symbols, [(900, "Ext\\X", "class", "p")], refs)
    name, sid = "target_qualified_name", "target_symbol_id"
    assert got == {
        (name, 11, "deleted", "2024-01"), (name, 12, "late", "2024-01"), (name, 14, "late", "2024-01"), (name, 16, "missing", "2024-01"), (name, 18, "missing", "2024-01"),
        (sid, 20, "deleted", "2024-01"), (sid, 21, "missing", "2024-01"), (name, 22, "late", "2024-01"), (name, 23, "deleted", "2024-01"), (name, 24, "late", None), (name, 25, "deleted", "2024-01"),
    }
    assert {(r.ref_field, r.cause, r.n_references) for r in orphans_by_period(df).collect()} >= {(sid, "missing", 1), (name, "missing", 2)}


def test_tables(spark):
    tables = [(1, 1, "orders", day(0), None), (2, 1, "users", day(10), day(20)), (3, 2, "users", day(0), None), (1, 1, "orders", day(0), None)]
    keys = [
        (1, 1, "x", "users", day(5)), (2, 1, "`Users`", None, day(15)), (3, 1, "[dbo].[users]", None, day(15)), (4, 99, "users", "users", day(15)), (5, 3, None, None, day(15)),
        (6, 3, "users", "users", day(15)), (7, 1, "users", "users", day(25)), (7, 1, "users", "users", day(25)),
    ]
    _, got = run(spark, tables=tables, keys=keys)
    assert {g[1:3] for g in got} == {(1, "late"), (3, "missing"), (4, "missing"), (7, "deleted")}


def test_hot_key_and_empty(spark):
    refs = [(i, "hot", None, day(i % 40), "k") for i in range(3000)] + [(9999, "cold", None, day(3), "k")]
    _, got = run(spark, [(1, "Hot", day(10), None, "x")], refs=refs)
    assert len(got) == sum(1 for i in range(3000) if i % 40 < 10) + 1
    assert run(spark)[1] == set()
