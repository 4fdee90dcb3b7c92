"""Applying a stream of inserts, updates and deletes (problem 2).

``latest_state`` is the commutative fold: per key the maximum of
``struct(sequence, operation, payload)``; base rows take part as changes of the lowest
sequence and a delete stays in the fold as a tombstone, so a late, older change cannot
bring a row back. It aggregates on the map side, so hot keys cost nothing extra, and
the order or repetition of its input is of no consequence.

Renames make the key itself a value. ``settle`` folds such logs with ``latest_state`` all
the same: names whose last change is no rename are done after that one aggregation. A
rename hands on the state its source had just before it, or, where the source was gone, is
void, and the name's own earlier state counts. Both are again last changes (before a
sequence), found for all renames at once by ``latest_before``. What remains is a graph of
renames pointing at renames; pointers are followed by doubling, so rounds grow as the
logarithm of the longest chain and carry renames only, never the log.

``current_columns`` and ``current_keys`` use it: tables in repositories, then columns and
keys in the tables that survived. Changes belong to a surviving table through the intervals
of (name, sequence) in which it bore a name.

Edge cases: null or blank statements, statements of other kinds and changes to unknown
tables or columns have no effect; a script whose latest delivery is withdrawn (null
line and text) has no statements; several texts for one line of a delivery count as
the smallest of them; empty inputs give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symbolmill.functions.ddl import statement_changes
from symbolmill.session import checkpointed

_SEQ = "struct<rank:double,path:string,line:int,idx:int>"
_FIELDS = ("data_type", "is_nullable", "default_value", "field", "source_columns", "target_columns")
_EVENTS = (
    "repo_id long, rank double, path string, line int, idx int, level string, op string, table_name string, column_name string, other string, "
    "data_type string, is_nullable boolean, default_value string, field string, source_columns array<string>, target_columns array<string>"
)
_KINDS = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def latest_state(
    changes: DataFrame, keys: Sequence[str], sequence: Column, operation: Column, payload: Column, base: DataFrame | None = None, delete: str = "delete"
) -> DataFrame:
    """Current rows of a keyed table: (keys, sequence, operation, payload) of keys whose last change is no ``delete``.

    Any other operation sets the row. ``base`` holds (keys, payload) of the state before
    all changes. Ties of the sequence go to the greater operation and payload, so the
    result never depends on the order of rows.
    """
    rows = changes.select(*keys, F.struct(sequence.alias("sequence"), operation.alias("operation"), payload.alias("payload")).alias("change"))
    if base is not None:
        kinds = rows.schema["change"].dataType
        first = base.select(*keys, F.struct(F.lit(None).cast(kinds["sequence"].dataType).alias("sequence"), F.lit("insert").alias("operation"), F.col("payload")).alias("change"))
        rows = rows.unionByName(first)
    last = rows.groupBy(*keys).agg(F.max("change").alias("change"))
    return last.filter(F.col("change.operation") != delete).select(*keys, "change.sequence", "change.operation", "change.payload")


def latest_before(log: DataFrame, probes: DataFrame, keys: Sequence[str], sequence: str = "seq") -> DataFrame:
    """``probes`` with ``found``: of the rows of ``log`` with the probe's keys the last one before its sequence, null if there is none.

    An as-of join of two levels: rows are range-partitioned by (keys, sequence), which cuts
    a hot key into blocks; the last row inside a block is a window over the block, the last
    one of earlier blocks a window over one row per block.
    """
    keys = list(keys)
    items = F.struct(*[c for c in log.columns if c not in keys])
    kind = log.select(items.alias("e")).schema["e"].dataType
    extra = [c for c in probes.columns if c not in (*keys, sequence)]
    asks = probes.select(*keys, sequence, F.lit(0).alias("_log"), F.lit(None).cast(kind).alias("_e"), F.struct(F.lit(True).alias("_asked"), *extra).alias("_p"))
    none = F.lit(None).cast(asks.schema["_p"].dataType)
    rows = log.select(*keys, sequence, F.lit(1).alias("_log"), items.alias("_e"), none.alias("_p")).unionByName(asks)
    rows = checkpointed(rows.repartitionByRange(*keys, sequence).withColumn("_block", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_block").orderBy(sequence, "_log").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last("_e", ignorenulls=True).over(inside)).filter("_p is not null")
    tails = rows.groupBy(*keys, "_block").agg(F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col(sequence))).alias("_e"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select(*keys, "_block", F.last("_e", ignorenulls=True).over(earlier).alias("_far"))
    return near.join(tails, [*keys, "_block"]).select(*keys, sequence, *[F.col(f"_p.{c}").alias(c) for c in extra], F.coalesce("_near", "_far").alias("found"))


#: What the parts of a version weigh in the order of scripts, the rank of scripts without one, the patterns of both.
VERSION_WEIGHTS, UNVERSIONED = (1_000_000, 10_000, 100, 1), 999_999_999
INITIAL_PATTERN, VERSION_PATTERN = r"(?s)\binitial\b.*\bsource\b", r"(\d+)[_.](\d+)[_.](\d+)[_.](\d+)"


def script_rank(path: Column) -> Column:
    """Initial sources first, then by version, the rest at a fixed rank (a double, so no version is too large)."""
    low = F.lower(path)
    part = lambda i: F.regexp_extract(low, VERSION_PATTERN, i).try_cast("double")
    number = sum((part(i + 1) * w for i, w in enumerate(VERSION_WEIGHTS)), F.lit(1.0))
    return (
        F.when(F.regexp_like(low, F.lit(INITIAL_PATTERN)), F.lit(0.0)).when(F.regexp_like(low, F.lit(VERSION_PATTERN)), number).otherwise(F.lit(float(UNVERSIONED)))
    )


def current_statements(statements: DataFrame) -> DataFrame:
    """The statements of the latest delivery of each script, each line once."""
    g = ["repo_id", "path"]
    last = statements.groupBy(*g).agg(F.max("delivery_no").alias("delivery_no"))
    rows = statements.select(*g, "delivery_no", "line_start", "text").join(last, [*g, "delivery_no"], "left_semi")
    return rows.filter(F.col("text").isNotNull() & F.col("line_start").isNotNull()).groupBy(*g, "line_start").agg(F.min("text").alias("text"))


def change_events(statements: DataFrame) -> DataFrame:
    """Schema changes of statements, with the sequence in which they apply inside a repository."""
    fields = [f.split(" ") for f in _EVENTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (*where, i, *change[:-1])
                for *where, text in zip(*(b.column(c).to_pylist() for c in ("repo_id", "rank", "path", "line_start", "text")), strict=True)
                for i, change in enumerate(statement_changes(text))
            ]
            cols = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    # other statements (data, indexes, views) stay in the JVM
    schema = statements.filter(F.regexp_like("text", F.lit(r"(?is)^(?:\s|--[^\r\n]*|/\*.*?\*/)*+(?:create|alter|drop|rename)\b")))
    cols = schema.select(F.col("repo_id").cast("long"), script_rank(F.col("path")).alias("rank"), "path", F.col("line_start").cast("int"), "text")
    events = cols.mapInArrow(read, _EVENTS)
    return events.select("repo_id", F.struct("rank", "path", "line", "idx").alias("seq"), "level", "op", "table_name", "column_name", "other", F.struct(*_FIELDS).alias("payload"))


_WAY = "struct<state:string,ref:struct<name:string,seq:{seq}>,trail:array<struct<name:string,since:{seq}>>,payload:{payload}>"


def settle(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Names alive after all ``events`` (scope, name, seq, op, other, payload); op is set, clear or move.

    Result: (scope, name, payload, trail); payload is that of the ``set`` the state goes
    back to, ``trail`` the array of (name, since, until) it lived through: it bore
    ``name`` from the event at ``since`` on, until before the event at ``until`` (null:
    to the end).
    """
    scope = list(scope)
    kind = events.schema["payload"].dataType.simpleString()
    way = _WAY.format(seq=_SEQ, payload=kind)
    steps = f"array<struct<name:string,since:{_SEQ}>>"
    last = latest_state(events, [*scope, "name"], F.col("seq"), F.col("op"), F.struct("other", "payload"), delete="clear")
    plain = last.filter("operation = 'set'").select(*scope, "name", F.col("payload.payload").alias("payload"), F.array(F.struct("name", F.col("sequence").alias("since"))).cast(steps).alias("trail"))
    moves = _resolved_moves(events, scope, way, steps)
    if moves is not None:
        led = last.filter("operation = 'move'").select(*scope, "name", F.struct("name", F.col("sequence").alias("seq")).alias("ref"))
        led = led.join(moves, [*scope, "ref"]).filter("way.state = 'alive'").select(*scope, "name", "way.payload", "way.trail")
        plain = plain.unionByName(led)
    until = lambda x, i: F.struct(x["name"].alias("name"), x["since"].alias("since"), F.when(i > 0, F.element_at("trail", i)["since"]).alias("until"))
    return plain.withColumn("trail", F.transform("trail", until))


def _resolved_moves(events: DataFrame, scope: list[str], way: str, steps: str) -> DataFrame | None:
    """(scope, ref, way) of every move (name, seq): whether a state survives it, the state and its trail, newest first.

    A move has two ways on: its source just before it, or else its own name just before it.
    """
    moves = events.filter("op = 'move'").select(*scope, "name", "seq", "other").distinct()
    asks = moves.select(*scope, F.explode(F.array(F.struct(F.col("other").alias("at"), F.lit(0).alias("side")), F.struct(F.col("name").alias("at"), F.lit(1).alias("side")))).alias("p"), "seq", "name")
    asks = checkpointed(asks.select(*scope, F.col("p.at").alias("at"), "seq", F.col("p.side").alias("side"), "name"))
    if asks.isEmpty():
        return None
    touched = asks.select(*scope, "at").distinct()
    log = events.select(*scope, F.col("name").alias("at"), "seq", "op", "payload").withColumn("when", F.col("seq")).join(touched, [*scope, "at"], "left_semi")
    found = latest_before(log, asks, [*scope, "at"])
    e = F.col("found")
    here = F.struct(F.col("at").alias("name"), e["when"].alias("since"))
    own = F.when(F.col("side") == 0, F.array(F.struct(F.col("name").alias("name"), F.col("seq").alias("since"))).cast(steps)).otherwise(F.array().cast(steps))
    state = F.when(e["op"] == "set", "alive").when(e["op"] == "move", "wait").otherwise("gone")
    step = F.struct(
        state.alias("state"), F.when(e["op"] == "move", F.struct(F.col("at").alias("name"), e["when"].alias("seq"))).alias("ref"),
        F.when(e["op"] == "set", F.concat(own, F.array(here).cast(steps))).otherwise(own).alias("trail"), F.when(e["op"] == "set", e["payload"]).alias("payload"),
    ).cast(way)
    sides = found.select(*scope, F.struct("name", "seq").alias("ref"), "side", step.alias("way")).groupBy(*scope, "ref")
    pairs = sides.agg(F.max_by("way", F.when(F.col("side") == 0, 0)).alias("a"), F.max_by("way", F.when(F.col("side") == 1, 0)).alias("b"))
    gone = F.struct(*[F.lit(x).alias(n) for x, n in (("gone", "state"), (None, "ref"), (None, "trail"), (None, "payload"))]).cast(way)
    while True:
        # a source that is gone leaves the other way; one that lives, or whose other way is gone, is the only way
        source_gone = F.col("a.state") == "gone"
        pairs = pairs.select(*scope, "ref", F.when(source_gone, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(source_gone | (F.col("a.state") == "alive"), gone).otherwise(F.col("b")).alias("b"))
        pairs = checkpointed(pairs)
        waiting = pairs.agg(*[F.count_if(F.col(f"{side}.state") == "wait").alias(side) for side in ("a", "b")]).first()
        if not waiting["a"]:
            return pairs.select(*scope, "ref", F.col("a").alias("way"))
        single = (F.col("a.state") != "wait") | (F.col("b.state") == "gone")
        known = pairs.filter(single).select(*scope, "ref", F.col("a").alias("w"))
        for side in (side for side in ("a", "b") if waiting[side]):
            to = known.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("ref").alias("_ref"), F.col("w").alias("_w"))
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope] + [F.col(f"{side}.ref") == F.col("_ref")]
            joined = pairs.join(to, on, "left")
            further = F.struct(F.col("_w.state").alias("state"), F.col("_w.ref").alias("ref"), F.concat(f"{side}.trail", "_w.trail").alias("trail"), F.col("_w.payload").alias("payload")).cast(way)
            reached = (F.col(f"{side}.state") == "wait") & F.col("_w").isNotNull()
            moved = F.when(~reached, F.col(side)).when(F.col("_w.state") == "gone", gone).otherwise(further)
            pairs = joined.withColumn(side, moved).select(*scope, "ref", "a", "b")


def _surviving(statements: DataFrame) -> DataFrame:
    """The changes to columns and keys of the tables that survive (repo_id, table)."""
    events = checkpointed(change_events(current_statements(statements)))
    tables = settle(events.filter("level = 'table'").select("repo_id", F.col("table_name").alias("name"), "seq", "op", "other", "payload"), ["repo_id"])
    lives = tables.select("repo_id", F.col("name").alias("table"), F.explode("trail").alias("t")).select("repo_id", "table", F.col("t.name").alias("table_name"), "t.since", "t.until")
    mine = (
        events.filter("level <> 'table'")
        .join(lives, ["repo_id", "table_name"])
        .filter((F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
        .select("repo_id", "table", "level", F.col("column_name").alias("name"), "seq", "op", "other", "payload")
    )
    return checkpointed(mine)


_SCOPE = ["repo_id", "table"]


def _columns(mine: DataFrame) -> DataFrame:
    """(repo_id, table, name, payload, trail) of the columns that survive, with their later touches (type, nullability, default)."""
    columns = mine.filter("level = 'column'")
    alive = settle(columns.filter("op <> 'touch'"), _SCOPE)
    touches = columns.filter("op = 'touch'").select(*_SCOPE, F.col("name").alias("was"), "seq", "payload")
    steps = alive.select(*_SCOPE, "name", F.explode("trail").alias("t")).select(*_SCOPE, "name", F.col("t.name").alias("was"), "t.since", "t.until")
    last = lambda field, value: F.max(F.when(F.col("payload.field") == field, F.struct("seq", F.col(f"payload.{value}").alias("v")))).alias(field)
    touched = (
        touches.join(steps, [*_SCOPE, "was"])
        .filter((F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
        .groupBy(*_SCOPE, "name")
        .agg(last("type", "data_type"), last("nullable", "is_nullable"), last("default", "default_value"))
    )
    later = lambda field, value: F.when(F.col(field).isNotNull(), F.col(f"{field}.v")).otherwise(F.col(f"payload.{value}")).alias(value)
    return alive.join(touched, [*_SCOPE, "name"], "left").select(
        "repo_id", F.col("table").alias("table_name"), F.col("name").alias("column_name"), F.coalesce("type.v", "payload.data_type").alias("data_type"),
        later("nullable", "is_nullable"), later("default", "default_value"),
    )


def current_columns(statements: DataFrame) -> DataFrame:
    """(repo_id, table_name, column_name, data_type, is_nullable, default_value) of the state after all statements."""
    return _columns(_surviving(statements))


def current_schema(statements: DataFrame) -> DataFrame:
    """(repo_id, table_name, column_name, data_type) of the state after all statements."""
    return current_columns(statements).select("repo_id", "table_name", "column_name", "data_type")


def current_keys(statements: DataFrame) -> DataFrame:
    """(repo_id, table_name, constraint_name, source_columns, target_table, target_columns) of the foreign keys after all statements.

    Keys are folded by their identity; a key goes with any of its columns that is dropped
    later, and follows renames of its columns. Target names stay as they were written.
    """
    mine = _surviving(statements)
    keys = latest_state(mine.filter("level = 'key'"), [*_SCOPE, "name"], F.col("seq"), F.col("op"), F.struct("other", "payload"), delete="clear")
    columns = mine.filter("level = 'column'")
    fates = columns.filter("op = 'clear' and payload.field = 'drop'").select(*_SCOPE, F.col("name").alias("at"), "seq", F.lit(None).cast("string").alias("to"))
    fates = checkpointed(fates.unionByName(columns.filter("op = 'move'").select(*_SCOPE, F.col("other").alias("at"), "seq", F.col("name").alias("to"))))
    walk = keys.select(*_SCOPE, "name", "sequence", F.posexplode("payload.payload.source_columns").alias("pos", "at")).withColumnRenamed("sequence", "seq")
    settled: DataFrame | None = None
    while True:
        walk = checkpointed(walk.select(*_SCOPE, "name", "pos", "at", "seq"))
        later = fates.withColumnRenamed("seq", "then").select(*_SCOPE, "at", "then", "to")
        met = walk.join(later, [*_SCOPE, "at"]).filter("then > seq").groupBy(*_SCOPE, "name", "pos").agg(F.min(F.struct("then", "to")).alias("f"))
        met = checkpointed(met)
        rest = walk.join(met, [*_SCOPE, "name", "pos"], "left_anti")
        ended = rest.unionByName(met.filter("f.to is null").select(*_SCOPE, "name", "pos", F.lit(None).cast("string").alias("at"), F.col("f.then").alias("seq")))
        settled = ended if settled is None else settled.unionByName(ended)
        walk = met.filter("f.to is not null").select(*_SCOPE, "name", "pos", F.col("f.to").alias("at"), F.col("f.then").alias("seq"))
        if walk.isEmpty():
            break
    now = settled.groupBy(*_SCOPE, "name").agg(F.count_if(F.col("at").isNull()).alias("n_dropped"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "at"))), lambda x: x["at"]).alias("cols"))
    return (
        keys.join(now, [*_SCOPE, "name"], "left")
        .filter("coalesce(n_dropped, 0) = 0")
        .select(
            "repo_id", F.col("table").alias("table_name"), F.col("payload.payload.field").alias("constraint_name"), F.coalesce("cols", "payload.payload.source_columns").alias("source_columns"),
            F.col("payload.other").alias("target_table"), F.col("payload.payload.target_columns").alias("target_columns"),
        )
    )
