"""Likely tests of a symbol.

The reference scores every test against every seed file. A test's score is a sum over
seeds, and all its terms but one are sums over what test and seed have in common (a stem, a
token, a folder), so seeds are first counted per stem, token and folder, and tests meet these
counts in equi-joins; only the number of seeds that share any token is counted over pairs.

Edge cases: files without a path and symbols without a name give nothing; a seed named by
several references keeps its greatest weight, then its smallest name; empty tables give an
empty result; repeated rows count once where the caller made them unique.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import as_column

#: Words that say nothing of a file, endings of file names, what hints are worth, the least score.
GENERIC_TOKENS = (
    "test tests spec specs src app php interface controller route builder model entity repository service handler page report factory manager provider "
    "resource module restapi rest api application integration feature unit data object dataobject"
).split()
STRUCTURAL_SUFFIXES = (
    "Interface Controller Route Builder Model Entity Repository Service Handler Page Report Factory Manager Provider Resource Resolver Action Module "
    "APIEntity ApiEntity DataObject"
).split()
TEST_SUFFIX = r"(?i)(?:IntegrationTest|FeatureTest|UnitTest|ApiTest|UITest|TestCase|Tests|Test|Specs|Spec|IT)$"
REFERENCES, IMPORTS, MENTIONS_QUALIFIED, CONSTRUCTS, MENTIONS = 28, 36, 18, 28, 8
LEAST_SCORE, OWN_WEIGHT, COMPANION_BONUS = 8, 12, 8


def _kebab(value: Column) -> Column:
    split = F.lower(F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.regexp_replace(F.trim(F.regexp_replace(split, r"[^a-z0-9]+", " ")), r" +", "-")


def comparable_stem(path: Column | str, is_test: Column) -> Column:
    """A file's name without extension, test ending and structural endings (three letters stay), in kebab case."""
    base = F.regexp_replace(F.substring_index(as_column(path), "/", -1), r"(?<=.)\.[^.]*$", "")
    base = F.when(is_test, F.regexp_replace(base, TEST_SUFFIX, "")).otherwise(base)
    stripped = _kebab(F.regexp_replace(base, rf"(?i)^(.{{3,}}?)(?:{'|'.join(STRUCTURAL_SUFFIXES)})+$", "$1"))
    return F.when(stripped != "", stripped).otherwise(_kebab(base))


def path_tokens(value: Column | str) -> Column:
    """Distinct words of three letters and more that are not generic."""
    split = F.lower(F.regexp_replace(F.regexp_replace(as_column(value), r"\\", " "), r"([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.array_distinct(F.split(split, r"[^a-z0-9]+")), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*[F.lit(w) for w in GENERIC_TOKENS]))


def folders(path: Column | str) -> Column:
    """The folders of a path, in lower case."""
    parts = F.split(F.lower(as_column(path)), r"[\\/]")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p != "")


def content_hints(lines: DataFrame, name: str, qualified: str | None) -> DataFrame:
    """(path, reason, score) of test lines (path, line) that import, mention, construct or name a symbol; once per file and reason."""
    word = re.escape(name)
    uses = rf"(?i)\bnew\s+{word}\b|\b{word}::class\b|\b(?:extends|implements)\s+[^\{{;]*\b{word}\b|\b(?:createMock|getMockBuilder|prophesize|stub|spy)\s*\(\s*{word}::class"
    tests = [("constructs", CONSTRUCTS, F.regexp_like("line", F.lit(uses))), ("names", MENTIONS, F.regexp_like("line", F.lit(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")))]
    if qualified:
        path = re.escape(qualified.lstrip("\\"))
        tests += [
            ("imports", IMPORTS, F.regexp_like("line", F.lit(rf"(?i)\buse\s+\\?{path}(?:\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?\s*;"))),
            ("mentions", MENTIONS_QUALIFIED, F.contains(F.lower("line"), F.lit(qualified.lower()))),
        ]
    signs = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("reason"), F.lit(s).alias("score"))) for r, s, c in tests]))
    return lines.select("path", F.explode(signs).alias("h")).select("path", "h.reason", "h.score").distinct()


def seeds_of(dependents: DataFrame, own_path: str, own_name: str) -> DataFrame:
    """(path, weight, symbol_name) of production files, from ``dependents`` (path, qualified_name, depth): the heaviest per path."""
    weight = F.greatest(F.lit(4), F.lit(10) - 2 * F.col("depth"))
    own = dependents.sparkSession.createDataFrame([(own_path, OWN_WEIGHT, own_name)], "path string, weight int, symbol_name string")
    rows = dependents.select("path", weight.cast("int").alias("weight"), F.col("qualified_name").alias("symbol_name")).unionByName(own)
    best = rows.groupBy("path").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.coalesce("symbol_name", F.lit("")).alias("symbol_name"))).alias("b"))
    return best.select("path", (-F.col("b.w")).alias("weight"), "b.symbol_name")


def rank_tests(tests: DataFrame, seeds: DataFrame, hints: DataFrame) -> DataFrame:
    """(path, score, reasons) of test files (path) against seeds (path, weight, symbol_name) and hints (path, reason, score)."""
    tests = tests.select("path").distinct()
    hinted = hints.groupBy("path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    stems = seeds.select(comparable_stem("path", F.lit(False)).alias("stem"), "weight").filter("stem <> ''").groupBy("stem").agg(F.sum(F.col("weight") + COMPANION_BONUS).alias("score"))
    named = tests.withColumn("stem", comparable_stem("path", F.lit(True))).join(stems, "stem").select("path", "score", F.array(F.lit("companion name")).alias("reasons"))
    seed_tokens = seeds.select(F.col("path").alias("seed"), "weight", F.explode(path_tokens(F.concat_ws(" ", "path", "symbol_name"))).alias("token"))
    test_tokens = tests.select("path", F.explode(path_tokens("path")).alias("token"))
    per_token = seed_tokens.groupBy("token").agg((2 * F.count("*")).alias("score"))
    shared = test_tokens.join(per_token, "token").groupBy("path").agg(F.sum("score").alias("score")).withColumn("reasons", F.array(F.lit("name tokens")))
    touched = test_tokens.join(seed_tokens, "token").select("path", "seed", "weight").distinct().groupBy("path").agg(F.sum(F.least("weight", F.lit(2))).alias("score"))
    areas = seeds.select(F.explode(F.slice(F.reverse(folders("path")), 1, 2)).alias("folder")).groupBy("folder").agg(F.count("*").alias("score"))
    near = tests.select("path", F.explode(F.array_distinct(folders("path"))).alias("folder")).join(areas, "folder").groupBy("path").agg(F.sum("score").alias("score")).withColumn("reasons", F.array(F.lit("same area")))
    terms = [hinted, named, shared, touched.withColumn("reasons", F.array().cast("array<string>")), near]
    every = reduce(DataFrame.unionByName, [t.select("path", F.col("score").cast("long").alias("score"), "reasons") for t in terms])
    total = every.join(tests, "path", "left_semi").groupBy("path").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), ", ").alias("reasons"))
    return total.filter(F.col("score") >= LEAST_SCORE)
