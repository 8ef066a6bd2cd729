"""What tasks need: this package on the executors, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it on any machine."""
    sc = spark.sparkContext
    if getattr(sc, "_aerolith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp()) / "aerolith_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(out))
    sc._aerolith_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset on local masters, a new folder."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    sc = spark.sparkContext
    if not getattr(sc, "_aerolith_shared", None):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc._aerolith_shared = tempfile.mkdtemp(prefix="aerolith-")
        sc.setCheckpointDir(sc._aerolith_shared)
    return sc._aerolith_shared


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of ``stored`` once its last reader is done."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
