"""A few keys holding most records (problem 3): results per key without a long last task.

The input is combined in chunks of a fixed number of rows where they lie (``combined_chunks``),
so a key leaves a chunk as one state per source, however many rows it has there. Keys that
hold more than 1/``HOT_SHARE`` of all rows - at most ``HOT_SHARE`` of them, whatever the
input - go through ``tree_aggregate``: their states are spread over chunks by what a state is,
never by the key, combined there, and the states of ``fan_in`` neighbouring chunks are merged
in each further round until one is left. A key that holds half of all rows therefore reaches
a reducer as at most ``fan_in`` states in every round, and rounds grow as the logarithm of the
input. The states of all other keys meet once, by key, and do not enter the tree.

Edge cases: rows with a null key form a group of their own (the callers below drop it
after counting it); null measures count for nothing; an empty table gives an empty
result; repeated deliveries of a reference count once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import class_part, symbol_key
from symbolmill.session import checkpointed

#: Rows a chunk holds at the lowest level, and states merged at once above it.
CHUNK_ROWS, FAN_IN = 50_000, 8
#: A key is hot if it holds at least one in HOT_SHARE of all rows.
HOT_SHARE = 1000


def tree_aggregate(
    rows: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    spread: Sequence[str],
    n_rows: int,
    sets: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Sums (and small sets) of ``rows`` per ``keys``, combined over a tree of chunks.

    ``spread`` names the columns by whose hash rows fall into chunks: rows alike in them
    share a chunk, so distinct counts over them add up. ``sets`` are array columns whose
    distinct items are gathered; they must be drawn from a bounded domain.
    """
    chunks = max(1, math.ceil(n_rows / chunk_rows))
    state = rows.withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.lit(chunks)))
    state = state.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.array_distinct(F.flatten(F.collect_set(s))).alias(s) for s in sets]
    )
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in))
        state = state.groupBy(*keys, "_chunk").agg(
            *[F.sum(n).alias(n) for n in sums], *[F.array_distinct(F.flatten(F.collect_list(s))).alias(s) for s in sets]
        )
    return state.drop("_chunk")


def combined_chunks(unique: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(target, source_symbol_id, n, kinds, first_id): rows combined per target and source, ``chunk_rows`` of them at a time, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def combined() -> Iterator[pa.RecordBatch]:
            groups = pa.Table.from_batches(parts).group_by(["target", "source_symbol_id"]).aggregate(
                [("reference_id", "count", pc.CountOptions(mode="all")), ("reference_kind", "distinct", pc.CountOptions(mode="only_valid")), ("reference_id", "min")]
            )
            names = {"reference_id_count": "n", "reference_kind_distinct": "kinds", "reference_id_min": "first_id"}
            groups = groups.rename_columns([names.get(c, c) for c in groups.column_names]).select(["target", "source_symbol_id", "n", "kinds", "first_id"])
            yield from groups.combine_chunks().to_batches()

        for b in batches:
            parts.append(b)
            if sum(map(len, parts)) >= chunk_rows:
                yield from combined()
                parts = []
        if parts:
            yield from combined()

    return unique.mapInArrow(run, "target string, source_symbol_id long, n long, kinds array<string>, first_id long")


def target_statistics(references: DataFrame) -> DataFrame:
    """(target, n_references, n_sources, n_kinds) per normalised target, null target included.

    Deliveries are first made unique (a shuffle by reference_id, which has no hot value),
    then combined in chunks per (target, source), so that no later step sees single rows.
    """
    unique = references.select(
        F.col("reference_id").cast("long"), symbol_key("target_qualified_name").alias("target"), F.col("source_symbol_id").cast("long"), "reference_kind"
    ).dropDuplicates(["reference_id"])
    n_rows = references.count()  # a count over Parquet footers
    states = checkpointed(combined_chunks(unique))
    sizes = states.groupBy("target").agg(F.sum("n").alias("size"))
    hot = sizes.filter(F.col("size") * HOT_SHARE >= n_rows).select(F.col("target").alias("hot_target"), F.lit(True).alias("hot"))  # at most HOT_SHARE rows
    marked = states.join(F.broadcast(hot), F.col("target").eqNullSafe(F.col("hot_target")), "left")
    per_source = lambda rows, *keys: rows.groupBy(*keys, "target", "source_symbol_id").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    source = F.when(F.col("source_symbol_id").isNotNull(), 1).otherwise(0)
    calm = per_source(marked.filter("hot is null").repartition("target")).groupBy("target").agg(
        F.sum("n").alias("n_references"), F.sum(source).alias("n_sources"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")
    )
    # sources of a hot target are spread; rows without a source by their first reference
    spread = F.pmod(F.xxhash64(F.coalesce("source_symbol_id", "first_id")), F.lit(1 + n_rows // CHUNK_ROWS)).alias("_spread")
    pairs = per_source(marked.filter("hot").select("target", "source_symbol_id", "n", "kinds", spread), "_spread")
    tree = tree_aggregate(pairs, ["target"], {"n_references": F.col("n"), "n_sources": source}, ["_spread"], n_rows, sets=["kinds"])
    columns = ("target", "n_references", F.col("n_sources").cast("long").alias("n_sources"), F.size("kinds").cast("long").alias("n_kinds"))
    return calm.select(*columns).unionByName(tree.select(*columns))


def heavy_targets(statistics: DataFrame, share: float = 0.01) -> DataFrame:
    """Targets that hold at least ``share`` of all distinct references."""
    statistics = checkpointed(statistics)
    total = statistics.agg(F.sum("n_references").alias("total")).first()["total"] or 0
    heavy = statistics.filter(F.col("target").isNotNull() & (F.col("n_references") >= F.lit(total) * F.lit(share)))
    return heavy.select(F.col("target").alias("target_qualified_name"), "n_references", "n_sources", "n_kinds")


def fresh_reference_counts(module_symbols: DataFrame, statistics: DataFrame) -> DataFrame:
    """module_symbols with the count of references to the symbol and its members made anew.

    Repeated rows count once; a symbol without references has 0; ``stored`` is the count
    of the earlier report (null if it was null).
    """
    owned = statistics.groupBy(class_part("target").alias("key")).agg(F.sum("n_references").alias("n"))
    modules = module_symbols.select("module_path", "qualified_name", "kind", F.col("reference_count").alias("stored_count")).distinct()
    return (
        modules.withColumn("key", symbol_key("qualified_name"))
        .join(owned, "key", "left")
        .select("module_path", "qualified_name", "kind", "stored_count", F.coalesce("n", F.lit(0)).cast("long").alias("reference_count"))
    )
