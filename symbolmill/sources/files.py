"""File discovery and the index's merge sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolmill import catalog

#: Languages by extension.
LANGUAGES = {"php": "php", "sql": "sql", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go"}


def source_label(label: str) -> str:
    """C20: a label of ``[a-z0-9._-]``; nothing left is an error."""
    clean = re.sub(r"[^a-z0-9._-]+", "-", label.strip().lower()).strip("-")
    if not clean:
        raise ValueError(f"no usable label in {label!r}")
    return clean


def language_of(path: Column) -> Column:
    """By extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, language in LANGUAGES.items():
        out = F.when(extension == ext, language).otherwise(out)
    return out


def discover(
    spark: SparkSession, root: str, additional: Mapping[str, str] | None = None, exclude: Sequence[str] = (), languages: Sequence[str] = ("php", "sql")
) -> DataFrame:
    """(path, language, hash, lines_of_code, content) of all source files under the roots.

    Files of additional roots carry ``@label/``. ``exclude`` holds regular expressions on
    the path. Unreadable and undecodable bytes become replacement characters; an empty
    language list gives no files.
    """
    labels = [source_label(x) for x in additional or {}]
    if len(set(labels)) != len(labels):
        raise ValueError("two additional roots have the same label")
    parts = []
    for label, folder in [("", root), *zip(labels, (additional or {}).values(), strict=True)]:
        base = folder.rstrip("/")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        inner = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(base) + "/", "")
        parts.append(raw.select(F.concat(F.lit(f"@{label}/" if label else ""), inner).alias("path"), F.col("content").cast("string").alias("content"), F.lit(len(parts)).alias("root")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isin(*languages))
    for pattern in exclude:
        rows = rows.filter(~F.regexp_like("path", F.lit(pattern)))
    # of one path under several roots the last one counts; contents meet only where a path occurs twice
    last = rows.groupBy("path").agg(F.max("root").alias("root"))
    rows = rows.join(last, ["path", "root"], "left_semi") if len(parts) > 1 else rows
    return rows.select("path", "language", F.sha2("content", 256).alias("hash"), F.size(F.split("content", "\n", -1)).alias("lines_of_code"), "content")


def upsert_files(stored: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """By (repo_id, path) the found row replaces the stored one, whose id (``key``) and language stay."""
    keep = stored.select("repo_id", "path", F.col(key).alias("old_id"), F.col("language").alias("old_language"))
    fresh = found.join(keep, ["repo_id", "path"], "left")
    fresh = fresh.withColumn(key, F.coalesce("old_id", key)).withColumn("language", F.coalesce("old_language", "language")).select(*stored.columns)
    return stored.join(found.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select(*stored.columns).unionByName(fresh)


def replace_by(stored: DataFrame, fresh: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of the given keys are dropped, the fresh ones added."""
    return stored.join(keys.select(on).distinct(), on, "left_anti").select(*stored.columns).unionByName(fresh)


def delete_files(tables: Mapping[str, DataFrame], gone: DataFrame, file_key: str = "id", symbol_key: str = "id") -> dict[str, DataFrame]:
    """Drop files, their symbols, links and direct table references; references to them lose their target, those from them go."""
    ids = gone.select(F.col(file_key).alias("file_id")).distinct()
    dead = tables["symbols"].join(ids, "file_id", "left_semi").select(F.col(symbol_key).alias("dead_id"))
    refs = tables["symbol_references"].join(dead, F.col("source_symbol_id") == F.col("dead_id"), "left_anti")
    refs = refs.join(dead, F.col("target_symbol_id") == F.col("dead_id"), "left")
    refs = refs.withColumn("target_symbol_id", F.when(F.col("dead_id").isNull(), F.col("target_symbol_id"))).drop("dead_id")
    out = {
        "files": tables["files"].join(gone.select(file_key).distinct(), file_key, "left_anti"),
        "symbols": tables["symbols"].join(ids, "file_id", "left_anti"),
        "symbol_references": refs,
    }
    for name in ("symbol_table_links", "symbol_column_links"):
        if name in tables:
            out[name] = tables[name].join(dead, F.col("source_symbol_id") == F.col("dead_id"), "left_anti")
    if "direct_table_references" in tables:
        out["direct_table_references"] = tables["direct_table_references"].join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti")
    return out


def export_index(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """All given tables as Parquet or JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}.{kind}")


def import_index(spark: SparkSession, folder: str, names: Sequence[str], kind: str = "parquet") -> dict[str, DataFrame]:
    """The tables of an export, with the catalog's schemas."""
    return {n: spark.read.schema(catalog.SCHEMAS[n]).format(kind).load(f"{folder}/{n}.{kind}") for n in names}
