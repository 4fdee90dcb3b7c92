"""Graph traversals as frontier loops over edge DataFrames.

All loops share one shape: join the frontier with the edges on the node, aggregate per
new node, drop what was seen at a smaller depth (left anti), checkpoint, go on until the
frontier is empty or the depth is reached. State is one row per node, never a path, so
hubs and cycles cost what their edges cost. Hot nodes: a hub's edges are many rows of
one join key on the edge side only; the frontier side has one row per node, so AQE can
split the hub.

Edge cases: seeds that are no nodes, empty edges and cycles end the loop; null ends are
no edges; repeated edges count once where the caller made them unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.session import checkpointed

CALL_KINDS = ("static_call", "self_call", "instantiation", "class_reference")
PLANNING_KINDS = ("class_reference", "instantiation", "implementation", "type_hint")


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    """a parameter with its default, kept in its range."""
    return max(low, min(default if value is None else value, high))


def symbol_edges(references: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """(src, dst) of resolved references, one row per reference."""
    rows = references.filter(F.col("target_symbol_id").isNotNull() & F.col("source_symbol_id").isNotNull()).dropDuplicates(["reference_id"])
    if kinds:
        rows = rows.filter(F.col("reference_kind").isin(*kinds))
    return rows.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, seed_seen: bool = True, lift: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds (node) along src -> dst, at their least depth.

    ``lift`` (node, parent) adds a node's container to the frontier at the same depth.
    Without ``seed_seen`` the seeds themselves may be reached again. Nodes of ``stop`` (node) are never entered.
    """
    frontier = checkpointed(seeds.select("node").distinct())
    visited = frontier.withColumn("depth", F.lit(0))
    seen = visited if seed_seen else visited.limit(0)
    if stop is not None:
        edges = edges.join(stop.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = checkpointed(edges.select("src", "dst").distinct())  # made once, met by every round
    for step in range(1, depth + 1):
        nxt = frontier.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct()
        if lift is not None:
            up = nxt.join(lift, "node").select(F.col("parent").alias("node"))
            nxt = nxt.unionByName(up).distinct()
        frontier = checkpointed(nxt.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(step)))
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth, n_paths): number of walks of least length from the seeds, seeds may be reached again (G2, bag).

    A walk of least length visits every node at that node's least depth, so counts add up
    over the pruned frontier just as rows multiply in a recursive UNION ALL.
    """
    weighted = checkpointed(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    frontier = checkpointed(seeds.select("node").distinct().withColumn("n_paths", F.lit(1).cast("long")))
    out = frontier.withColumn("depth", F.lit(0)).limit(0)
    for step in range(1, depth + 1):
        nxt = frontier.join(weighted.withColumnRenamed("src", "node"), "node").groupBy("dst").agg(F.sum(F.col("n_paths") * F.col("w")).alias("n_paths"))
        nxt = nxt.withColumnRenamed("dst", "node").join(out.select("node"), "node", "left_anti")
        frontier = checkpointed(nxt.select("node", "n_paths"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.withColumn("depth", F.lit(step)))
    return out.select("node", "depth", "n_paths")


def recursive_reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The same as ``shortest_paths`` through a recursive CTE: the second path, for cross-checks on small graphs."""
    spark = edges.sparkSession
    return spark.sql(
        """WITH RECURSIVE walk(node, depth) AS (
             SELECT e.dst, 1 FROM {edges} e JOIN {seeds} s ON e.src = s.node
             UNION ALL
             SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.node WHERE w.depth < {depth}),
           least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
           SELECT w.node, w.depth, count(*) AS n_paths FROM walk w JOIN least l ON w.node = l.node AND w.depth = l.depth GROUP BY 1, 2""",
        edges=edges, seeds=seeds, depth=int(depth),
    )


def outermost(parents: DataFrame, limit: int = 32) -> DataFrame:
    """(node, top, height) from (node, parent) rows; pointer doubling, so rounds are the logarithm of the nesting.

    A parent that is no node ends the climb there; a cycle of parents ends at ``limit``.
    """
    state = parents.select("node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("height"))
    nodes = parents.select("node")
    state = state.join(nodes.select(F.col("node").alias("top"), F.lit(True).alias("known")), "top", "left")
    state = state.select("node", F.when(F.col("known"), F.col("top")).otherwise(F.col("node")).alias("top"), F.when(F.col("known"), F.col("height")).otherwise(0).alias("height"))
    steps = 1
    while steps < limit:
        state = checkpointed(state)
        if state.filter("height > 0").join(state.filter("height > 0").select(F.col("node").alias("top")), "top", "left_semi").isEmpty():
            break
        up = state.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("height").alias("more"))
        state = state.join(up, "top", "left").select("node", F.coalesce("next", "top").alias("top"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"))
        steps *= 2
    return state


def busiest(rows: DataFrame, key: str, where: Column | None = None, n: int = 1) -> DataFrame:
    """(node): the ``n`` values of ``key`` with most rows, ties by value."""
    rows = rows if where is None else rows.filter(where)
    counted = rows.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "node").limit(n).select("node")


def owned_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, name, reference_kind, line_number, via): references of a symbol and of its direct children.

    ``dst`` is null where the target is unknown to ``symbols``, ``name`` is the target's own name or the written one,
    ``via`` the child that refers. Owners are exploded, so that both cases are one equi-join.
    """
    own = symbols.select(F.col("symbol_id").alias("source_symbol_id"), "parent_symbol_id", F.col("name").alias("source_name"))
    known = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("qualified_name").alias("target_name"))
    rows = references.dropDuplicates(["reference_id"]).select("source_symbol_id", "target_symbol_id", "target_qualified_name", "reference_kind", "line_number").join(own, "source_symbol_id")
    rows = rows.join(known.withColumn("dst", F.col("target_symbol_id")), "target_symbol_id", "left").filter(F.col("dst").isNotNull() | F.col("target_symbol_id").isNull())
    owners = F.array_compact(F.array(F.struct(F.col("source_symbol_id").alias("src"), F.lit(None).cast("string").alias("via")), F.when(F.col("parent_symbol_id").isNotNull(), F.struct(F.col("parent_symbol_id").alias("src"), F.col("source_name").alias("via")))))
    return rows.withColumn("o", F.explode(owners)).select("o.src", "dst", F.coalesce("target_name", "target_qualified_name").alias("name"), "reference_kind", "line_number", "o.via")


def flow_references(owned: DataFrame, symbols: DataFrame, overrides_any_case: bool = False) -> DataFrame:
    """``owned`` cut to calls, with what a symbol inherits and overrides.

    A symbol also has the self calls of the classes it extends. A self call of a method that the symbol itself has as
    a child becomes the calls of that child. As in the reference a child counts only if its name is written in lower
    case; ``overrides_any_case`` compares without case.
    """
    calls = owned.filter(F.col("reference_kind").isin(*CALL_KINDS))
    bases = owned.filter("reference_kind = 'inheritance' and dst is not null").select(F.col("src").alias("heir"), F.col("dst").alias("src")).distinct()
    inherited = owned.filter("reference_kind = 'self_call'").join(bases, "src").select(F.col("heir").alias("src"), "dst", "name", "reference_kind", "line_number", "via")
    rows = calls.unionByName(inherited).withColumn("method", F.when((F.col("reference_kind") == "self_call") & (F.instr("name", "::") > 0), F.lower(F.substring_index("name", "::", -1))))
    children = symbols.filter("parent_symbol_id is not null and name is not null").select(F.col("parent_symbol_id").alias("src"), F.lower("name").alias("method"), F.col("symbol_id").alias("child"), "name")
    children = children if overrides_any_case else children.filter("name = method")
    children = children.groupBy("src", "method").agg(F.min("child").alias("child"))
    own = rows.join(children.select("src", "method"), ["src", "method"], "left_anti").drop("method")
    through = rows.filter("method is not null").select("src", "method").distinct().join(children, ["src", "method"])
    led = through.select("src", F.col("child").alias("owner")).join(calls.filter("dst is not null").withColumnRenamed("src", "owner"), "owner").select(*owned.columns)
    return own.select(*owned.columns).unionByName(led)


def tree(owned: DataFrame, seeds: DataFrame, depth: int, deeper_kinds: Sequence[str] = CALL_KINDS, first_kinds: Sequence[str] | None = None) -> DataFrame:
    """(node, depth, name, is_resolved, n): symbols reached from the seeds (node) and unknown targets as leaves.

    The seeds follow ``first_kinds`` (null: all), deeper symbols ``deeper_kinds``; symbols at ``depth`` still show their leaves.
    A leaf is one row per name and the least depth it hangs at, with the number of references.
    """
    resolved = owned.filter("dst is not null")
    deeper = resolved.filter(F.col("reference_kind").isin(*deeper_kinds)).select("src", "dst").distinct()
    first = (resolved if first_kinds is None else resolved.filter(F.col("reference_kind").isin(*first_kinds))).select("src", "dst").distinct()
    seeds = checkpointed(seeds.select("node").distinct())
    next_ = seeds.join(first.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct().join(seeds, "node", "left_anti")
    rest = reach(deeper, next_, depth - 1, stop=seeds).select("node", (F.col("depth") + 1).alias("depth"))
    nodes = checkpointed(seeds.withColumn("depth", F.lit(0)).unionByName(rest))
    leaves = owned.filter("dst is null and name is not null").join(nodes.withColumnRenamed("node", "src"), "src")
    kinds = F.col("reference_kind").isin(*deeper_kinds)
    leaves = leaves.filter(kinds | ((F.col("depth") == 0) & (F.lit(True) if first_kinds is None else F.col("reference_kind").isin(*first_kinds))))
    leaves = leaves.groupBy("name", (F.col("depth") + 1).alias("depth")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    return nodes.select("node", "depth", F.lit(None).cast("string").alias("name"), F.lit(True).alias("is_resolved"), F.lit(1).cast("long").alias("n")).unionByName(
        leaves.select(none.alias("node"), "depth", "name", F.lit(False).alias("is_resolved"), "n")
    )


def exception_summary(symbols: DataFrame) -> DataFrame:
    """(owner_symbol_id, source, exception, method) of each container's methods; functions own themselves.

    ``source`` is throw, docblock or catch, as far as the metadata hold them.
    """
    rows = symbols.filter(F.col("kind").isin("method", "function"))
    held = rows.schema["metadata"].dataType.fieldNames()
    fields = {"throw": ("thrown_exceptions", "thrownExceptions"), "docblock": ("documented_throws", "documentedThrows"), "catch": ("caught_exceptions", "caughtExceptions")}
    lists = [_entries(f, s) for s, names in fields.items() for f in names if f in held]
    rows = rows.select(F.coalesce("parent_symbol_id", "symbol_id").alias("owner_symbol_id"), F.col("name").alias("method"), F.explode(F.concat(*lists)).alias("x"))
    return rows.select("owner_symbol_id", "x.source", "x.exception", "method").filter(F.col("exception").isNotNull()).distinct()


def _entries(field: str, source: str) -> Column:
    return F.coalesce(F.transform(F.col(f"metadata.{field}"), lambda x: F.struct(F.lit(source).alias("source"), x.alias("exception"))), F.array().cast("array<struct<source:string,exception:string>>"))
