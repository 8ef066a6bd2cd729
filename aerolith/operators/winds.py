"""Wind snapshots: files of JSON by their times of day, and a store in which a snapshot is there whole or not at all
(S23, K9, Z1).

The store has a folder of rows for each version, and an empty file whose name is the version's number and name for each
committed one. The file is made after all rows are written, in one step on any file system, so rows of a writer that was
killed are never read. Of each date and time of day the newest committed version counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A file's JSON: a grid, row by row from the south-west, or points.
FILE = """grid struct<gw:int, gh:int, bounds:struct<latMin:double, latMax:double, lonMin:double, lonMax:double>, uGrid:array<double>, vGrid:array<double>>,
 points array<struct<lat:double, lon:double, u:double, v:double>>"""
ROWS = "kind string, lat double, lon double, u double, v double"


def wind_files(spark: SparkSession, path: str) -> DataFrame:
    """key, kind, lat, lon, u, v of a folder's files whose names are four digits. Of a file with both, the grid counts.
    Files that aren't such JSON, and those with neither, have no rows (S23)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([0-9]{4})\.json$", 1).alias("key"), F.from_json("value", FILE).alias("d"))
    files = files.where("key <> ''").select("key", "d.grid", "d.points")
    b = F.col("grid.bounds")
    grids = files.where("grid.uGrid IS NOT NULL").select("key", "grid", F.posexplode(F.arrays_zip("grid.uGrid", "grid.vGrid")).alias("at", "wind"))
    iy, ix = F.floor(F.col("at") / F.col("grid.gw")), F.pmod("at", F.col("grid.gw"))
    grids = grids.select("key", F.lit("grid").alias("kind"), (b.latMin + (iy + 0.5) * (b.latMax - b.latMin) / F.col("grid.gh")).alias("lat"), (b.lonMin + (ix + 0.5) * (b.lonMax - b.lonMin) / F.col("grid.gw")).alias("lon"), F.col("wind.uGrid").alias("u"), F.col("wind.vGrid").alias("v"))
    points = files.where("grid.uGrid IS NULL").select("key", F.lit("points").alias("kind"), F.inline("points"))
    return grids.unionByName(points)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_version(rows: DataFrame, path: str) -> str:
    """Writes rows (date, key, kind, lat, lon, u, v) as a version that nobody reads yet, and gives its name."""
    version = uuid.uuid4().hex
    # each task gets rows of few folders, and of a large one a part, whatever the input's files are: it sorts what it writes
    rows.hint("rebalance", "date", "key").write.partitionBy("date", "key").parquet(f"{path}/rows/version={version}")
    return version


def commit_version(spark: SparkSession, path: str, version: str) -> None:
    """Makes a written version the newest one. Doing so again makes no difference."""
    fs, commits = _folder(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(commits)] if fs.exists(commits) else []
    if not any(n.endswith(version) for n in names):
        number = max((int(n.split("-")[0]) for n in names), default=0) + 1
        fs.createNewFile(_folder(spark, f"{path}/commits/{number:012d}-{version}")[1])


def save_snapshots(rows: DataFrame, path: str) -> None:
    """Adds snapshots, or replaces those of the same date and key, all at once (K9)."""
    commit_version(rows.sparkSession, path, write_version(rows, path))


def saved_snapshots(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """date, key, kind, lat, lon, u, v: the newest committed version of each snapshot, its grid if it has one."""
    fs, commits = _folder(spark, f"{path}/commits")
    if not fs.exists(commits):
        return spark.createDataFrame([], f"date date, key string, {ROWS}")
    names = [f.getPath().getName().split("-") for f in fs.listStatus(commits)]  # one for each commit, as for each folder of rows
    done = spark.createDataFrame([(v, int(n)) for n, v in names], "version string, number long")
    rows = spark.read.schema(f"{ROWS}, version string, date date, key string").parquet(f"{path}/rows")
    if date is not None:
        rows = rows.where(F.col("date") == F.lit(date).cast("date"))  # other days' folders aren't read
    rows = rows.join(F.broadcast(done), "version")  # two versions would be two tasks
    snapshot = rows.groupBy("date", "key", "number").agg(F.max((F.col("kind") == "grid").cast("int")).alias("has_grid"))
    newest = F.row_number().over(Window.partitionBy("date", "key").orderBy(F.desc("number")))
    snapshot = snapshot.withColumn("n", newest).where("n = 1").drop("n")
    snapshot = F.broadcast(snapshot)  # a row for each folder, which the driver has listed
    return rows.join(snapshot, ["date", "key", "number"]).where("has_grid = 0 OR kind = 'grid'").select("date", "key", "kind", "lat", "lon", "u", "v")
