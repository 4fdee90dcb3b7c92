"""References to records that do not exist (problem 1).

Parents and child keys are united in one tagged long form and grouped by
``(parent_kind, key)``; the group's verdict (life spans of all candidates, earliest
birth, whether there is a candidate at all) is then applied to the single references.

Shapes at scale: child keys are pre-aggregated before the shuffle, so a key that a
third of all references name is one row in the grouping. Applying the verdicts joins
each reference once; keys that hold at least 1/``HOT_SHARE`` of the references are at
most ``HOT_SHARE`` in number whatever the input, so exactly those verdicts are
broadcast and the rest is an ordinary shuffled join without skew.

Edge cases: a null target names nothing and yields no row; a blank target is looked up
like any other and is ``missing``; repeated rows give one row; a null ``recorded_at``
is never inside a life span, so the reference is a case with a null period and, having
candidates, the cause ``late``. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symbolmill.functions.names import class_part, schema_name, symbol_key
from symbolmill.session import checkpointed

#: A key is hot if it holds at least one in HOT_SHARE of all references.
HOT_SHARE = 1000
_CASE = ("ref_table", "ref_field", "ref_id", "recorded_at", "has_parent", "spans", "earliest")


def _table_key(repo: Column, name: Column) -> Column:
    return F.concat_ws(":", F.coalesce(repo.cast("string"), F.lit("?")), name)


def parent_spans(symbols: DataFrame, external: DataFrame, tables: DataFrame) -> DataFrame:
    """All parents in long form: (parent_kind, key, born, died, never); ``born`` null means alive from the beginning.

    ``never``: an index time that is missing is no eternal life but a candidate that never lives.
    """
    always = F.lit(None).cast("timestamp_ntz")
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    own = symbols.select(
        "symbol_id", "qualified_name", ts("indexed_at").alias("born"), ts("removed_at").alias("died"), F.col("indexed_at").isNull().alias("never")
    )
    ext = external.select("symbol_id", "qualified_name", always.alias("born"), always.alias("died"), F.lit(False).alias("never"))
    kinds = F.array(
        F.struct(F.lit("name").alias("parent_kind"), symbol_key("qualified_name").alias("key")),
        F.struct(F.lit("id").alias("parent_kind"), F.col("symbol_id").cast("string").alias("key")),
    )
    named = own.unionByName(ext).select("born", "died", "never", F.explode(F.filter(kinds, lambda x: x["key"].isNotNull())).alias("k"))
    db = tables.filter(F.col("normalized_name").isNotNull()).select(
        F.lit("table").alias("parent_kind"), _table_key(F.col("repo_id"), F.col("normalized_name")).alias("key"),
        ts("indexed_at").alias("born"), ts("removed_at").alias("died"), ts("indexed_at").isNull().alias("never"),
    )
    return named.select("k.parent_kind", "k.key", "born", "died", "never").unionByName(db)


def child_references(references: DataFrame, foreign_keys: DataFrame, tables: DataFrame) -> DataFrame:
    """All references in long form: (ref_table, ref_field, ref_id, parent_kind, key, recorded_at)."""
    ts = F.col("recorded_at").cast("timestamp_ntz")
    refs = references.select("reference_id", "target_qualified_name", "target_symbol_id", ts.alias("recorded_at")).select(
        "recorded_at",
        F.col("reference_id").alias("ref_id"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("target_qualified_name").alias("ref_field"), F.lit("name").alias("parent_kind"), symbol_key("target_qualified_name").alias("key")),
                    F.struct(F.lit("target_symbol_id").alias("ref_field"), F.lit("id").alias("parent_kind"), F.col("target_symbol_id").cast("string").alias("key")),
                ),
                lambda x: x["key"].isNotNull(),
            )
        ).alias("f"),
    )
    refs = refs.select(F.lit("symbol_references").alias("ref_table"), "f.ref_field", "ref_id", "f.parent_kind", "f.key", "recorded_at")
    owner = tables.groupBy("table_id").agg(F.min("repo_id").alias("owner_repo"))
    fks = (
        foreign_keys.select("foreign_key_id", "table_id", F.coalesce("normalized_target_table", schema_name("target_table")).alias("target"), ts.alias("recorded_at"))
        .filter(F.col("target").isNotNull())
        .join(owner, "table_id", "left")
    )
    fks = fks.select(
        F.lit("db_foreign_keys").alias("ref_table"), F.lit("normalized_target_table").alias("ref_field"), F.col("foreign_key_id").alias("ref_id"),
        F.lit("table").alias("parent_kind"), _table_key(F.col("owner_repo"), F.col("target")).alias("key"), "recorded_at",
    )
    return refs.unionByName(fks)


def verdicts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(parent_kind, key, has_parent, spans, earliest, n_refs, first_ref, last_ref) of every key.

    Parents with one end keep their earliest birth (a later birth with the same end adds
    nothing), and what overlaps is merged before the lists are made, so a key that many
    rows declare still has few spans.
    """
    g = ["parent_kind", "key"]
    ntz = lambda v: F.lit(v).cast("timestamp_ntz")
    rows = parents.groupBy(*g, "died", "never").agg(F.min(F.coalesce("born", ntz("0001-01-01"))).alias("born"))
    lives = ~F.col("never") & (F.coalesce("died", ntz("9999-12-31")) > F.col("born"))
    rows = rows.select(*g, "born", F.when(lives, F.coalesce("died", ntz("9999-12-31"))).alias("end"), F.when(~F.col("never"), F.col("born")).alias("seen"))
    order = W.partitionBy(*g).orderBy("born", "end")
    running = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("end").isNotNull() & (running.isNull() | (F.col("born") > running)), 1).otherwise(0)
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = rows.groupBy(*g, "island").agg(
        F.min(F.when(F.col("end").isNotNull(), F.col("born"))).alias("born"), F.max("end").alias("end"), F.min("seen").alias("earliest")
    )
    none = ntz(None)
    parent_rows = spans.select(*g, F.lit(True).alias("is_parent"), "born", "end", "earliest", F.lit(0).cast("long").alias("n"), none.alias("a"), none.alias("b"))
    child_keys = children.groupBy(*g).agg(F.count("*").alias("n"), F.min("recorded_at").alias("a"), F.max("recorded_at").alias("b"), F.count("recorded_at").alias("dated"))
    child_rows = child_keys.select(
        *g, F.lit(False).alias("is_parent"), none.alias("born"), none.alias("end"), none.alias("earliest"), "n",
        F.when(F.col("dated") == F.col("n"), F.col("a")).alias("a"), "b",
    )
    return parent_rows.unionByName(child_rows).groupBy(*g).agg(
        F.max("is_parent").alias("has_parent"),
        F.collect_list(F.when(F.col("born").isNotNull(), F.struct("born", "end"))).alias("spans"),
        F.min("earliest").alias("earliest"),
        F.sum("n").alias("n_refs"),
        F.min("a").alias("first_ref"),
        F.max("b").alias("last_ref"),
    )


def with_fallback(grouped: DataFrame) -> DataFrame:
    """Give names without candidates those of their class part; keep only keys that are referred to."""
    named = grouped.filter(F.col("n_refs") > 0)
    lacking = (F.col("parent_kind") == "name") & ~F.col("has_parent") & (F.instr("key", "::") > 0)
    classes = grouped.filter((F.col("parent_kind") == "name") & F.col("has_parent")).select(
        F.col("key").alias("class_key"), F.col("spans").alias("class_spans"), F.col("earliest").alias("class_earliest")
    )
    fell = (
        named.filter(lacking)
        .withColumn("class_key", class_part("key"))
        .join(classes, "class_key", "left")
        .withColumn("has_parent", F.col("class_spans").isNotNull())
        .withColumn("spans", F.coalesce("class_spans", "spans"))
        .withColumn("earliest", F.col("class_earliest"))
        .select(*grouped.columns)
    )
    return named.filter(~lacking).unionByName(fell)


def reference_orphans(
    symbols: DataFrame, external: DataFrame, references: DataFrame, tables: DataFrame, foreign_keys: DataFrame
) -> DataFrame:
    """One row per reference whose candidates all fail to live when it is recorded, with cause and month."""
    children = child_references(references, foreign_keys, tables)
    grouped = checkpointed(verdicts(parent_spans(symbols, external, tables), children))
    # a key whose candidates live from its first to its last reference holds no case
    covered = F.exists("spans", lambda s: (s["born"] <= F.col("first_ref")) & (s["end"] > F.col("last_ref")))
    judged = with_fallback(grouped).filter(~F.coalesce(covered, F.lit(False)))
    total = 2 * references.count() + foreign_keys.count()  # counts over Parquet footers
    judged = checkpointed(judged.select("parent_kind", "key", "has_parent", "spans", "earliest", (F.col("n_refs") * HOT_SHARE >= total).alias("hot")))
    hot = judged.filter("hot").withColumnRenamed("key", "hot_key").withColumnRenamed("parent_kind", "hot_kind")
    marked = children.join(F.broadcast(hot), (F.col("parent_kind") == F.col("hot_kind")) & (F.col("key") == F.col("hot_key")), "left")
    calm = marked.filter("hot is null").select(*children.columns).join(judged.filter("not hot"), ["parent_kind", "key"])
    met = marked.filter("hot").select(*_CASE).unionByName(calm.select(*_CASE))
    alive = F.exists("spans", lambda s: (s["born"] <= F.col("recorded_at")) & (s["end"] > F.col("recorded_at")))
    cause = F.when(~F.col("has_parent"), "missing").when(F.col("earliest") <= F.col("recorded_at"), "deleted").otherwise("late")
    return (
        met.filter(~F.coalesce(alive, F.lit(False)))
        .select("ref_table", "ref_field", "ref_id", cause.alias("cause"), F.date_format("recorded_at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, cause and month."""
    return orphans.groupBy("ref_table", "ref_field", "cause", "period").agg(F.count("*").alias("n_references"))
