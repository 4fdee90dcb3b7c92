"""Structural comparison, look-up and suggestion.

Comparisons run for whole sets of pairs at once as equi-joins on the owner and the
member's name; nothing is compared pair by pair outside of a shared key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import as_column, resource_key


def member_names(symbols: DataFrame) -> DataFrame:
    """(owner_id, member, signature) of all members, the first of a name."""
    rows = symbols.filter("parent_symbol_id is not null and name is not null")
    first = rows.groupBy(F.col("parent_symbol_id").alias("owner_id"), F.lower("name").alias("member")).agg(F.min(F.struct("line_start", "symbol_id", "signature")).alias("m"))
    return first.select("owner_id", "member", "m.signature")


def compare_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """J12/J13 for pairs (a, b): (a, b, n_only_a, n_only_b, n_shared, n_differing).

    One full outer join on (pair, member) instead of two anti joins and an inner one.
    """
    pairs = pairs.select("a", "b").distinct()
    left = pairs.join(members.select(F.col("owner_id").alias("a"), "member", F.coalesce("signature", F.lit("")).alias("sig_a")), "a")
    right = pairs.join(members.select(F.col("owner_id").alias("b"), "member", F.coalesce("signature", F.lit("")).alias("sig_b")), "b")
    both = left.join(right, ["a", "b", "member"], "full_outer")
    return both.groupBy("a", "b").agg(
        F.count_if(F.col("sig_b").isNull()).alias("n_only_a"), F.count_if(F.col("sig_a").isNull()).alias("n_only_b"),
        F.count_if(F.col("sig_a").isNotNull() & F.col("sig_b").isNotNull()).alias("n_shared"), F.count_if(F.col("sig_a") != F.col("sig_b")).alias("n_differing"),
    )


def missing_everywhere(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, member) that no b of a's pairs has."""
    pairs = pairs.select("a", "b").distinct()
    have = pairs.join(members.select(F.col("owner_id").alias("b"), "member"), "b").select("a", "member").distinct()
    return pairs.select("a").distinct().join(members.select(F.col("owner_id").alias("a"), "member"), "a").join(have, ["a", "member"], "left_anti").select("a", "member")


def find_symbols(symbols: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Symbols whose name matches a ``LIKE`` pattern without case and escapes, the first ``limit`` by qualified name."""
    rows = symbols.filter(F.lower("name").like(pattern.lower().replace("\\", "\\\\")) & F.col("qualified_name").isNotNull())
    return rows.select("symbol_id", "qualified_name", "kind").orderBy("qualified_name", "symbol_id").limit(limit)


def find(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    """(qualified_name, kind, path, line_start, line_end) of symbols whose name or qualified name matches, optionally of a kind and in a path.

    ``*`` and ``%`` stand for any text and ``_`` for one character; without them the text may stand anywhere. ASCII case does not
    matter, backslashes are literal.
    """
    pattern = query.lower().replace("*", "%")
    pattern = (pattern if "%" in pattern else f"%{pattern}%").replace("\\", "\\\\")
    hit = F.lower("name").like(pattern) | F.lower("qualified_name").like(pattern)
    rows = symbols.filter(hit & F.col("qualified_name").isNotNull())
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    rows = rows.join(files.select("file_id", "path"), "file_id")
    rows = rows if path is None else rows.filter(F.contains(F.lower("path"), F.lit(path.lower())))
    return rows.orderBy("qualified_name", "symbol_id").limit(max(1, min(limit, 50))).select("qualified_name", "kind", "path", "line_start", "line_end")


def name_tokens(name: Column | str) -> Column:
    """Lower-case words of a camel-case or namespaced name, the merged form first, distinct."""
    split = F.lower(F.regexp_replace(F.regexp_replace(as_column(name), r"\\", " "), r"([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.split(split, r"[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.concat(F.array(F.array_join(words, "")), words))


def merged(name: Column) -> Column:
    """A name's letters and digits in lower case, signs taken out."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "")


def suggestion_score(wanted: str, name: Column | str, qualified: Column | str) -> Column:
    """C4: the sum of the weights of all tests that hold; words of ``wanted`` (its merged form among them) count each.

    Fixed values: the weights. Every symbol is scored; there is no limit before.
    """
    name, qualified = as_column(name), F.coalesce(as_column(qualified), as_column(name))
    query, low, whole = merged(F.lit(wanted)), F.lower(name), F.lower(qualified)
    tests = [
        (merged(name) == query, 120), (merged(qualified) == query, 110), (low == query, 100),
        (F.endswith(whole, F.concat(F.lit("\\"), query)) | F.endswith(whole, F.concat(F.lit("::"), query)), 70),
        (F.contains(merged(name), query), 50), (F.contains(merged(qualified), query), 40),
    ]
    per_word = [(low, 12), (whole, 8)]
    words = F.aggregate(name_tokens(F.lit(wanted)), F.lit(0), lambda acc, w: reduce(lambda x, t: x + F.when(F.contains(t[0], w), t[1]).otherwise(0), per_word, acc))
    return reduce(lambda x, t: x + F.when(t[0], t[1]).otherwise(0), tests, words)


def suggest_symbols(symbols: DataFrame, wanted: str, limit: int = 5) -> DataFrame:
    """T4: the ``limit`` best suggestions for a name nobody has."""
    rows = symbols.filter("qualified_name is not null and name is not null").withColumn("score", suggestion_score(wanted, "name", "qualified_name"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "qualified_name", "symbol_id").limit(limit).select("symbol_id", "qualified_name", "score")


_SUFFIXES = "Controller|Command|Listener|Service|Builder|Report|Repository|Model|Record|Interface|Trait|Test"


def stem(path: Column | str) -> Column:
    """A file's name without extension and structural suffixes, lower case."""
    base = F.regexp_replace(F.substring_index(as_column(path), "/", -1), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(base, f"(?<=.{{3}})(?:{_SUFFIXES})+$", ""))


def path_tokens(path: Column | str) -> Column:
    """Distinct words of three characters and more of a path."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(as_column(path), r"\.[^.]*$", ""), r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3)


def companion_tests(files: DataFrame, is_test: Column) -> DataFrame:
    """(production_id, test_id, score) of tests with a production file's stem, by shared path words (2 each).

    The reference scores every test against every seed; here only files with one stem
    meet, in an equi-join, and the words only rank them.
    """
    rows = files.select("file_id", "repo_id", stem("path").alias("stem"), path_tokens("path").alias("words"), is_test.alias("is_test"))
    prod = rows.filter("not is_test").select(F.col("file_id").alias("production_id"), "repo_id", "stem", F.col("words").alias("p"))
    test = rows.filter("is_test").select(F.col("file_id").alias("test_id"), "repo_id", "stem", F.col("words").alias("t"))
    return prod.join(test, ["repo_id", "stem"]).select("production_id", "test_id", (2 * F.size(F.array_intersect("p", "t"))).alias("score"))


def tested_areas(files: DataFrame, is_test: Column) -> DataFrame:
    """C9/R17 per repository and folder (without its root label and ``tests/``): production and test files."""
    area = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^@[^/]*/", ""), r"^tests?/", ""), r"/[^/]*$", "")
    rows = files.select("repo_id", area.alias("area"), is_test.alias("t"))
    return rows.groupBy("repo_id", "area").agg(F.count_if(~F.col("t")).alias("n_production"), F.count_if("t").alias("n_tests"))


def suffix_slices(parts: Column, least: int = 2) -> Column:
    """All suffixes with at least ``least`` items."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.slice(parts, i, F.size(parts))), lambda s: F.size(s) >= least)


def route_pairs(routes: DataFrame, flat_size: int = 4) -> DataFrame:
    """(nested, flat) names: a flat name of ``flat_size`` segments whose last two stand somewhere at the end of a longer one.

    ``routes`` has (name) with ``\\``-separated segments; of a family's flat names the smallest counts.
    """
    parts = F.split(F.lower("name"), r"\\")
    rows = routes.select("name").distinct().withColumn("parts", parts)
    flat = rows.withColumn("key", F.array_join(F.slice("parts", -2, 2), "\\")).filter(F.size("parts") == flat_size).groupBy("key").agg(F.min("name").alias("flat"))
    nested = rows.filter(F.size("parts") > flat_size).select(F.col("name").alias("nested"), F.explode(F.transform(suffix_slices(F.col("parts")), lambda s: F.array_join(s, "\\"))).alias("key"))
    return nested.join(flat, "key").select("nested", "flat").distinct()


#: Leading folders of a route that say nothing of its resource.
SCAFFOLDING = ("root", "companies", "company")


def route_families(symbols: DataFrame, files: DataFrame, folder: str = "routes?") -> DataFrame:
    """(family, display_path, qualified_name, path, segments) of classes below a ``folder``, one per family: interface files before others, then the smaller path."""
    rows = symbols.filter("kind = 'class'").join(files.select("file_id", "path"), "file_id").select("path", F.coalesce("qualified_name", "name").alias("qualified_name"))
    parts = F.split(F.regexp_replace("path", r"\.[^.]+$", ""), "/")
    rows = rows.withColumn("parts", parts).withColumn("at", F.array_position(F.transform("parts", lambda p: F.regexp_like(p, F.lit(rf"(?i)^(?:{folder})$"))), F.lit(True)))
    rows = rows.filter((F.col("at") > 0) & (F.col("at") < F.size("parts"))).withColumn("tail", F.slice("parts", F.col("at") + 1, F.size("parts")))
    stem = F.regexp_replace(F.element_at("tail", -1), "Interface$", "")
    above = F.slice("tail", 1, F.size("tail") - 1)
    # leading scaffolding is cut: what follows the first folder that is none
    free = F.array_position(F.transform(above, lambda p: ~F.lower(p).isin(*SCAFFOLDING)), F.lit(True))
    kept = F.when(free > 0, F.slice(above, F.greatest(free, F.lit(1)), F.size(above))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("path", "qualified_name", F.array_join(F.concat(above, F.array(stem)), "/").alias("family"), F.concat(kept, F.array(stem)).alias("segments"))
    best = rows.groupBy("family").agg(F.min(F.struct((~F.endswith("path", F.lit("Interface.php"))).alias("other"), "path", "qualified_name", "segments")).alias("b"))
    return best.select("family", F.array_join("b.segments", "/").alias("display_path"), "b.qualified_name", "b.path", "b.segments")


def family_pairs(families: DataFrame) -> DataFrame:
    """(nested, flat) display paths: a nested family with the flat ones that one of its aliases names, null without any.

    Aliases are the keys of all endings of at least two segments; they meet the keys of flat families in an equi-join.
    """
    flat = families.filter("size(segments) = 1").select(resource_key(F.col("segments")).alias("key"), F.col("display_path").alias("flat"))
    nested = families.filter("size(segments) > 1").select("family", F.col("display_path").alias("nested"), F.explode(suffix_slices(F.col("segments"))).alias("ending"))
    named = nested.select("family", "nested", resource_key(F.col("ending")).alias("key")).distinct()
    found = named.join(flat, "key").select("family", "nested", "flat").distinct()
    return named.select("family", "nested").distinct().join(found, ["family", "nested"], "left").select("nested", "flat")


def changeset(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, path, change) between stored and found (repo_id, path, hash); equal hashes are no change."""
    s = stored.groupBy("repo_id", "path").agg(F.max("hash").alias("old"))
    f = found.groupBy("repo_id", "path").agg(F.max("hash").alias("new"))
    both = s.join(f, ["repo_id", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("repo_id", "path", change.alias("change")).filter("change is not null")
