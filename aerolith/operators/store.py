"""The store: partitioned tables, archive, retention, snapshots (K1-K8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_readings(df: DataFrame, path: str) -> None:
    """Adds readings to the store, a folder for each UTC day and source (K1, K3)."""
    df.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date", "source").parquet(path)


def replace_days(df: DataFrame, path: str, by: str = "date") -> None:
    """Writes rows and replaces the days that they have; other days stay (K2, K4)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def latest_by_key(df: DataFrame, *key: str, order: str = "ts") -> DataFrame:
    """The row of each key that was written last: an upsert on reading (K2)."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def month_of(df: DataFrame, year: int, month: int, ts: str = "ts") -> DataFrame:
    """Rows of a UTC calendar month, end excluded (K6, P5)."""
    a = f"{year}-{month:02d}-01"
    b = f"{year + month // 12}-{month % 12 + 1:02d}-01"
    return df.where((F.col(ts) >= F.lit(a).cast("timestamp_ntz")) & (F.col(ts) < F.lit(b).cast("timestamp_ntz")))


def kept_days(df: DataFrame, newest: str, days: int) -> DataFrame:
    """Rows of the last so many days up to the newest; with a date column as partition only those are read (K7)."""
    return df.where(F.col("date") > F.date_sub(F.lit(newest).cast("date"), days))


def snapshot_is_whole(mobile: DataFrame, points: DataFrame, least_points: int = 10) -> bool:
    """One mobile sensor and so many trail points at least (K5)."""
    return not mobile.isEmpty() and points.limit(least_points).count() >= least_points


JOURNAL = "table string, date date, bytes long, rule string"


def journal(spark: SparkSession, root: str) -> DataFrame:
    """What retention has dropped: a row for each table and day."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_dropped")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(JOURNAL).parquet(f"{root}/_dropped") if there else spark.createDataFrame([], JOURNAL)


def drop_old_days(spark: SparkSession, root: str, tables: list[str], newest: str, days: int, most_mb: float | None = None) -> int:
    """Deletes the folders of days beyond the last ``days`` up to the newest from these tables of the store (K7), beyond
    half as many if the tables hold over ``most_mb`` (K8). Tables that aren't named, such as daily snapshots, stay.

    What is to go is written to a journal first, then deleted: after a stop in between, a repeat deletes the rest and
    writes nothing twice. Whole folders go, so that no row is read; the driver handles a name and a size for each day.
    Gives the number of folders deleted."""
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    folders = []
    for t in tables:
        at = path(f"{root}/{t}")
        for f in fs.listStatus(at) if fs.exists(at) else []:
            name = f.getPath().getName()
            if name.startswith("date=") and name[5:] != "__HIVE_DEFAULT_PARTITION__":
                folders.append((t, dt.date.fromisoformat(name[5:]), fs.getContentSummary(f.getPath()).getLength(), f.getPath()))
    rule = "age"
    if most_mb is not None and sum(f[2] for f in folders) > most_mb * 1e6:
        days, rule = max(1, days // 2), "size"
    before = dt.date.fromisoformat(newest) - dt.timedelta(days=days)
    old = [f for f in folders if f[1] <= before]
    if old:
        rows = spark.createDataFrame([(t, d, n, rule) for t, d, n, _ in old], JOURNAL)
        new = rows.join(journal(spark, root), ["table", "date", "bytes"], "left_anti").select("table", "date", "bytes", "rule")
        new.coalesce(1).write.mode("append").parquet(f"{root}/_dropped")
    for *_, at in old:
        fs.delete(at, True)
    return len(old)
