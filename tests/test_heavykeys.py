import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from symbolmill.operators.heavykeys import fresh_reference_counts, heavy_targets, target_statistics, tree_aggregate

REFS = "reference_id long, target_qualified_name string, source_symbol_id long, reference_kind string, n string"


def made(n=4000):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        t = rnd.choice(["\\Hot\\A", "hot\\a", " HOT\\A "]) if rnd.random() < 0.4 else f"cold\\{rnd.randrange(300)}::m"
        rows.append((i, t, rnd.choice([None, rnd.randrange(50)]), rnd.choice(["x", "y", None]), "z"))
    return rows + rows[:500]


def test_statistics_and_heavy(spark):
    rows = made()
    truth, sources, kinds = Counter(), defaultdict(set), defaultdict(set)
    for _, t, s, k, _ in set(rows):
        key = t.strip().lstrip("\\").lower()
        truth[key] += 1
        sources[key] |= {s} - {None}
        kinds[key] |= {k} - {None}
    stats = target_statistics(spark.createDataFrame(rows, REFS))
    assert {tuple(r) for r in stats.collect()} == {(k, n, len(sources[k]), len(kinds[k])) for k, n in truth.items()}
    assert {r.target_qualified_name for r in heavy_targets(stats).collect()} == {k for k, n in truth.items() if n >= 0.01 * len(set(rows))}


def test_tree_is_independent_of_its_shape(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("string").alias("k"), "id", F.array((F.col("id") % 3).cast("string")).alias("kinds"))
    shapes = [tree_aggregate(df, ["k"], {"n": F.lit(1), "s": F.col("id")}, ["id"], 5000, ["kinds"], c, f) for c, f in ((10_000, 2), (100, 2), (37, 5))]
    results = [{(r.k, r.n, r.s, tuple(sorted(r.kinds))) for r in x.collect()} for x in shapes]
    assert results[0] == results[1] == results[2] and len(results[0]) == 2


def test_module_counts_nulls_and_empty(spark):
    refs = spark.createDataFrame([(1, "A\\B", 1, "x", "z"), (2, "a\\b::m", 1, "x", "z"), (3, None, 1, "x", "z"), (2, "a\\b::m", 1, "x", "z")], REFS)
    modules = spark.createDataFrame(
        [("m", "A\\B", "class", None), ("m", "A\\B", "class", None), ("m", "A\\C", "class", 5), ("m", None, "class", 5)], "module_path string, qualified_name string, kind string, reference_count long"
    )
    got = {(r.qualified_name, r.stored_count, r.reference_count) for r in fresh_reference_counts(modules, target_statistics(refs)).collect()}
    assert got == {("A\\B", None, 2), ("A\\C", 5, 0), (None, 5, 0)}
    assert heavy_targets(target_statistics(refs.limit(0))).count() == 0
    assert {r.target_qualified_name for r in heavy_targets(target_statistics(refs)).collect()} == {"a\\b", "a\\b::m"}
