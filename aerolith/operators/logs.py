"""Logs, lists and what is stored of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.text import MAX_STRING, sanitised


def own_prefs(log: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Entries whose key is the application's, without the versions of its configuration."""
    k, own = F.col("key"), F.lit(False)
    for p in prefixes:
        own = own | k.startswith(p)
    return log.where(own & ~k.endswith(".__cfgv"))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The newest n entries, numbered from the newest."""
    top = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long"))  # n rows


def script_line(key: Column, value: Column) -> Column:
    """A line of script that stores a preference again."""
    quoted = lambda c: F.substring_index(F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', "$1"), "\0", 1)
    return F.concat(F.lit("  localStorage.setItem("), quoted(key), F.lit(", "), quoted(value), F.lit(");"))


def capped_batches(events: DataFrame, most: int, *request: str, size: str | None = None, most_bytes: int = 65_536) -> DataFrame:
    """The first events of each request, and how many it had; requests whose sizes sum to too much are refused."""
    w = Window.partitionBy(*request)
    e = events.withColumns({"n": F.row_number().over(w.orderBy("ts", "event_id")), "offered": F.count("*").over(w)})
    if size:
        e = e.withColumn("_bytes", F.sum(size).over(w)).where(F.col("_bytes") <= most_bytes).drop("_bytes")
    return e.where(F.col("n") <= most).drop("n")


def snapshot_list(files: DataFrame, rows: DataFrame) -> DataFrame:
    """name, origin: all files, and the table's names that are no files."""
    f = files.select("name").distinct()
    return f.withColumn("origin", F.lit("file")).unionByName(rows.select("name").distinct().join(f, "name", "left_anti").withColumn("origin", F.lit("table")))


def cache_name(url: Column) -> Column:
    """Name of a cached copy (S3)."""
    return F.substring(F.sha1(url), 1, 12)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes of the files of a stored table, last name first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes")).orderBy(F.desc("name"))


def stored_mb(spark: SparkSession, path: str) -> float:
    return stored_files(spark, path).agg(F.coalesce(F.sum("bytes"), F.lit(0)) / 1e6).first()[0]


def pruned(df: DataFrame, path: str, newest: str, days: int, size_mb: float | None = None, most_mb: float | None = None) -> None:
    """Writes the rows of the last days to a new folder (K7); of half as many if the store is too large (K8)."""
    if size_mb is not None and most_mb is not None and size_mb > most_mb:
        days = max(1, days // 2)
    df.where(F.col("date") > F.date_sub(F.lit(newest).cast("date"), days)).write.partitionBy("date").parquet(path)


def meta_json(meta: Column) -> Column:
    """A map's JSON, null if it is empty."""
    return F.when(F.size(meta) > 0, F.to_json(meta))


def robust_bounds(places: DataFrame, radius_m: float) -> DataFrame:
    """Upper medians of lat and lon, how many places are near them, and their bounds."""
    upper = lambda c: -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})")
    mid = places.agg(upper("lat").alias("mid_lat"), upper("lon").alias("mid_lon"))  # one row
    near = places.crossJoin(F.broadcast(mid)).where(haversine_m(F.col("lat"), F.col("lon"), F.col("mid_lat"), F.col("mid_lon")) <= radius_m)
    return near.agg(F.first("mid_lat").alias("mid_lat"), F.first("mid_lon").alias("mid_lon"), F.count("*").alias("inliers"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"), F.round(F.min("lon"), 6).alias("west"), F.round(F.max("lon"), 6).alias("east"))


MAX_DEPTH, MAX_KEY, MAX_BYTES = 50, 200, 50_000_000


def sanitised_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, path, kind, text of every leaf of JSON objects, strings cleaned as ``sanitised`` does (X6). Texts that aren't an
    object, or are too long, have none; what lies too deep is left out; keys are cut. Rows of leaves keep a large object
    from being held in one value, and the cleaning in Spark's own functions."""
    def leaves(x, path: str, depth: int):
        if depth > MAX_DEPTH:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k[:MAX_KEY]}" if path else k[:MAX_KEY], depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]", depth + 1)
        else:
            kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string"
            yield path, kind, None if x is None else x[: MAX_STRING + 1] if kind == "string" else json.dumps(x)

    def run(batches):
        for pdf in batches:
            rows = []
            for values, text in zip(pdf[keep].itertuples(index=False), pdf[column]):
                try:
                    root = json.loads(text) if text is not None and len(text.encode("utf-8", "surrogatepass")) <= MAX_BYTES else None
                except (ValueError, RecursionError):
                    root = None
                if isinstance(root, dict):
                    rows += [(*values, *leaf) for leaf in leaves(root, "", 0)]
            yield pd.DataFrame(rows, columns=[*keep, "path", "kind", "text"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    out = df.select(*keep, column).mapInPandas(run, f"{kinds}, path string, kind string, text string")
    return out.withColumn("text", F.when(F.col("kind") == "string", sanitised(F.col("text"))).otherwise(F.col("text")))
