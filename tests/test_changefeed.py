"""The fold of schema changes against a sequential replay."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from symbolmill.functions.ddl import schema_events, split_top, statement_changes
from symbolmill.operators.changefeed import current_columns, current_keys, current_schema, latest_before, latest_state

SCHEMA = "repo_id long, path string, delivery_no int, delivered_at timestamp, line_start int, text string, extra string"


def rank(path):
    low = path.lower()
    if re.search(r"\binitial\b.*\bsource\b", low):
        return 0
    m = re.search(r"(\d+)[_.](\d+)[_.](\d+)[_.](\d+)", low)
    return 1 + sum(int(x) * f for x, f in zip(m.groups(), (10**6, 10**4, 100, 1), strict=True)) if m else 999_999_999


def replay(rows):
    """Sequential truth over (repo_id, path, delivery_no, line_start, text)."""
    last = {}
    for repo, path, no, *_ in rows:
        last[repo, path] = max(no, last.get((repo, path), no))
    lines = {}
    for repo, path, no, line, text in rows:
        if no == last[repo, path] and text is not None and line is not None:
            lines[repo, path, line] = min(text, lines.get((repo, path, line), text))
    state = {}
    for repo, path, line in sorted(lines, key=lambda k: (k[0], rank(k[1]), k[1], k[2])):
        tables = state.setdefault(repo, {})
        known = None
        for level, op, table, column, other, kind in schema_events(lines[repo, path, line]):
            if level == "table":
                if op == "set":
                    tables[table] = {}
                elif op == "clear":
                    tables.pop(table, None)
                elif other in tables:
                    tables[table] = tables[other]
                continue
            known = tables.get(table)
            if known is None:
                continue
            if op == "set":
                known[column] = kind
            elif op == "clear":
                known.pop(column, None)
            elif op == "touch" and column in known:
                known[column] = kind
            elif op == "move" and other in known:
                known[column] = known[other]
    return {(r, t, c, k) for r, ts in state.items() for t, cs in ts.items() for c, k in cs.items()}


def run(spark, rows):
    df = spark.createDataFrame([(r, p, n, None, li, t, "x") for r, p, n, li, t in rows], SCHEMA)
    got = [tuple(x) for x in current_schema(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_statements():
    ev = schema_events("-- don't drop\nCREATE TABLE `S`.[T] (a DECIMAL(10, 2) COMMENT 'x (old), y', key_no INT, PRIMARY KEY (a))")
    assert ev == [("table", "set", "s.t", None, None, None), ("column", "set", "s.t", "a", None, "decimal(10,2)"), ("column", "set", "s.t", "key_no", None, "int")]
    assert schema_events("UPDATE t SET x = 'drop table t'") == [] == schema_events(None) == schema_events("  ")
    assert schema_events("alter table t add constraint c check (a > 1), drop foreign key c") == []
    assert schema_events("alter table t rename to u, add b int /* drop table z */")[0] == ("column", "set", "t", "b", None, "int")
    assert split_top("a, 'b, c', d(e, f)") == ["a", "'b, c'", "d(e, f)"]


def test_renames_drops_and_late_deliveries(spark):
    v = "db/migrations/1_0_0_{}/a.sql".format
    rows = [
        (1, "db/initial/source/a.sql", 1, 1, "create table a (x int, y text)"),
        (1, "db/initial/source/a.sql", 2, 1, "create table a (x bigint, y text)"),
        (1, "db/initial/source/a.sql", 2, 1, "create table a (x bigint, y text)"),
        (1, v(1), 1, 1, "alter table a rename column x to z, alter column z type date"),
        (1, v(1), 1, 2, "alter table a rename to b"),
        (1, v(2), 1, 1, "create table a (q int)"),
        (1, v(2), 1, 2, "alter table b add w int, drop column y"),
        (1, v(3), 1, 1, "rename table nobody to b"),
        (1, v(3), 1, 2, "alter table b rename column nothing to w"),
        (1, v(4), 1, 1, "drop table a"),
        (1, v(4), 2, None, None),
        (1, v(5), 1, 1, "alter table b change w [V] varchar(3) not null, modify z char(2)"),
        (5, "db/99999999999999999999_1_1_1/x.sql", 1, 1, "create table t (late int)"), (5, "a.sql", 1, 1, "create table t (early int)"),
        (2, v(6), 1, 1, "alter table unknown add x int"),
        (3, v(10), 1, 1, "drop table t"),
        (3, v(9), 1, 1, "create table t (a int)"),
        (4, "x.sql", 1, 1, "create table t (a int)"), (4, "x.sql", 1, 2, "rename table t to u"), (4, "x.sql", 1, 3, "create table t (b int)"),
        (4, "x.sql", 1, 4, "rename table t to u"), (4, "x.sql", 1, 5, "rename table u to t"), (4, "x.sql", 1, 6, "alter table t add c int"),
    ]
    expected = replay(rows)
    assert (1, "b", "z", "char(2)") in expected and (1, "a", "q", "int") in expected and (1, "b", "v", "varchar(3)") in expected
    assert {x for x in expected if x[0] == 4} == {(4, "t", "b", "int"), (4, "t", "c", "int")}
    assert run(spark, rows) == expected
    assert run(spark, rows[::-1] + rows[:5]) == expected


def test_empty(spark):
    assert current_schema(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sql_statements.parquet").select("repo_id", "path", "delivery_no", "line_start", "text")
    assert {tuple(r) for r in current_schema(df).collect()} == replay([tuple(r) for r in df.collect()])


def test_latest_state(spark):
    base = spark.createDataFrame([(1, "base"), (2, "base")], "k long, payload string")
    log = spark.createDataFrame(
        [(1, 5, "delete", None), (1, 3, "update", "late"), (3, 1, "insert", "a"), (3, 2, "update", "b"), (3, 2, "update", "b"), (4, 1, "delete", None)],
        "k long, seq long, op string, v string",
    )
    got = latest_state(log, ["k"], F.col("seq"), F.col("op"), F.col("v"), base)
    assert {(r.k, r.payload) for r in got.collect()} == {(2, "base"), (3, "b")}


def whole_replay(rows):
    """Sequential truth of columns with their attributes and of keys, statement by statement."""
    last, lines = {}, {}
    for repo, path, no, *_ in rows:
        last[repo, path] = max(no, last.get((repo, path), no))
    for repo, path, no, line, text in rows:
        if no == last[repo, path] and text is not None and line is not None:
            lines[repo, path, line] = min(text, lines.get((repo, path, line), text))
    state = {}
    for repo, path, line in sorted(lines, key=lambda k: (k[0], rank(k[1]), k[1], k[2])):
        tables = state.setdefault(repo, {})
        for c in statement_changes(lines[repo, path, line]):
            if c.level == "table":
                if c.op == "set":
                    tables[c.table_name] = ({}, {})
                elif c.op == "clear":
                    tables.pop(c.table_name, None)
                elif c.other in tables:
                    tables[c.table_name] = tables[c.other]
                continue
            if c.table_name not in tables:
                continue
            columns, keys = tables[c.table_name]
            if c.level == "key":
                if c.op == "set":
                    keys[c.column_name] = [c.field, list(c.source_columns), c.other, list(c.target_columns)]
                else:
                    keys.pop(c.column_name, None)
            elif c.op == "set":
                columns[c.column_name] = [c.data_type, c.is_nullable, c.default_value]
            elif c.op == "clear":
                columns.pop(c.column_name, None)
                if c.field == "drop":
                    for k in [k for k, v in keys.items() if c.column_name in v[1]]:
                        del keys[k]
            elif c.op == "touch" and c.column_name in columns:
                i = ("type", "nullable", "default").index(c.field)
                columns[c.column_name][i] = (c.data_type, c.is_nullable, c.default_value)[i]
            elif c.op == "move":
                if c.other in columns:
                    columns[c.column_name] = columns[c.other]
                for v in keys.values():
                    v[1] = [c.column_name if x == c.other else x for x in v[1]]
    columns = {(r, t, n, *v) for r, ts in state.items() for t, (cs, _) in ts.items() for n, v in cs.items()}
    keys = sorted((r, t, v[0] or "", v[1], v[2], v[3]) for r, ts in state.items() for t, (_, ks) in ts.items() for v in ks.values())
    return columns, keys


def whole_run(spark, rows):
    df = spark.createDataFrame([(r, p, n, None, li, t, "x") for r, p, n, li, t in rows], SCHEMA)
    columns = {tuple(x) for x in current_columns(df).collect()}
    keys = sorted((r.repo_id, r.table_name, r.constraint_name or "", r.source_columns, r.target_table, r.target_columns) for r in current_keys(df).collect())
    return columns, keys


def test_chains_of_renames_at_random(spark):
    rnd = random.Random(4)
    rows = []
    for repo in range(40):
        for i in range(rnd.randrange(1, 60)):
            a, b, c, d = rnd.choice("abcd"), rnd.choice("abcd"), rnd.choice("xyz"), rnd.choice("xyz")
            text = rnd.choice([
                f"create table {a} ({c} int, q text default 'q' not null, constraint f foreign key ({c}, q) references {b} (i, j))", f"rename table {a} to {b}", f"rename table {a} to {b}",
                f"alter table {a} rename to {b}", f"drop table {a}", f"alter table {a} rename column {c} to {d}", f"alter table {a} rename column {c} to {d}", f"alter table {a} add {c} int not null",
                f"alter table {a} drop column {c}", f"alter table {a} alter column {c} type text", f"alter table {a} change {c} {d} date", f"alter table {a} alter {c} set default {i}",
                f"alter table {a} alter {c} drop not null", f"alter table {a} alter {c} set not null, alter {c} drop default", f"alter table {a} add foreign key ({c}) references {b} (k)",
                f"alter table {a} drop foreign key f", f"alter table {a} add constraint f foreign key ({c}) references {b}", f"alter table {a} modify {c} bigint null default 3, drop constraint g",
            ])
            rows.append((repo, f"{i // 3:03}.sql", 1, i % 3, text))
    rnd.shuffle(rows)
    assert run(spark, rows) == replay(rows)
    assert whole_run(spark, rows) == whole_replay(rows)


def test_attributes_and_keys_of_the_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sql_statements.parquet").select("repo_id", "path", "delivery_no", "line_start", "text")
    rows = [tuple(r) for r in df.collect()]
    assert whole_run(spark, rows) == whole_replay(rows)


def test_definitions():
    made = statement_changes("create table t (a int[] null default -1, b timestamp with time zone default now()::date not null references u (v), interval_no interval year to month, primary key (a))")
    assert [(c.column_name, c.data_type, c.is_nullable, c.default_value) for c in made if c.level == "column"] == [
        ("a", "int[]", True, "-1"), ("b", "timestampwithtimezone", False, "now()::date"), ("interval_no", "intervalyeartomonth", True, None),
    ]
    assert [(c.field, c.source_columns, c.other, c.target_columns) for c in made if c.level == "key"] == [(None, ["b"], "u", ["v"])]
    assert statement_changes("alter table t drop column c cascade, add index i (a)") == []


def test_latest_before(spark):
    rnd = random.Random(7)
    log = [(rnd.choice("ab"), rnd.randrange(400), i) for i in range(300)]
    log = list({(k, s): (k, s, v) for k, s, v in log}.values())
    probes = [(rnd.choice("abc"), rnd.randrange(-5, 400), i) for i in range(80)]
    got = latest_before(spark.createDataFrame(log, "k string, seq long, v long").withColumn("at", F.col("seq")), spark.createDataFrame(probes, "k string, seq long, id long"), ["k"])
    expected = {i: max(((s, v) for key, s, v in log if key == k and s < at), default=None) for k, at, i in probes}
    assert {r.id: (r.found["at"], r.found["v"]) if r.found else None for r in got.collect()} == expected
