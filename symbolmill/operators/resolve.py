"""Reference resolution: names of targets to symbols of the index.

Edge cases: names compare without a leading backslash, outer blanks and case; of several
symbols with one name the greatest id counts; ``Class::member`` without such a member
falls back to the top-level symbol of its class part; null names resolve to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import class_part, symbol_key


def current(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are not removed, each id once."""
    alive = rows.filter(F.col("removed_at").isNull()) if "removed_at" in rows.columns else rows
    return alive.dropDuplicates([key])


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(reference_id, target, resolved_symbol_id, how); ``how`` is exact, class or null.

    Distinct target names are resolved, not references: the joins run on one row per
    name, and the hot names meet their many references once, in a join that AQE splits.
    """
    named = symbols.filter(F.col("qualified_name").isNotNull()).select(symbol_key("qualified_name").alias("key"), "symbol_id", "parent_symbol_id")
    exact = named.groupBy("key").agg(F.max("symbol_id").alias("exact_id"))
    tops = named.filter(F.col("parent_symbol_id").isNull()).groupBy("key").agg(F.max("symbol_id").alias("class_id"))
    refs = references.select("reference_id", symbol_key("target_qualified_name").alias("target")).dropDuplicates(["reference_id"])
    names = refs.select("target").distinct().filter(F.col("target").isNotNull())
    names = names.withColumn("class_key", F.when(F.instr("target", "::") > 1, class_part("target")))
    known = names.join(exact.withColumnRenamed("key", "target"), "target", "left").join(tops.withColumnRenamed("key", "class_key"), "class_key", "left")
    known = known.select(
        "target", F.coalesce("exact_id", "class_id").alias("resolved_symbol_id"),
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("class_id").isNotNull(), "class").alias("how"),
    )
    return refs.join(known, "target", "left").select("reference_id", "target", "resolved_symbol_id", "how")
