"""What the corpus operators share: reading tables, shipping this package to executors, tables in the shared folder."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, ship, stored  # noqa: F401

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space. Bytes of other characters stay,
#: so that splitting the result gives the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of the lower-cased text.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all non-ASCII characters, as UTF-8. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_to_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(batches, column: str, limit: int):
    """Cuts Arrow batches so that a part's texts have about ``limit`` bytes at most, or it is a single row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, end - at)
            at = end


_KEPT: dict = {}


def kept_in_process(key, make):
    """What a worker process keeps for the next tasks of an operator; what another operator's tasks have left there goes."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drops what operators have kept in this process, as workers live on from one stage of a pipeline to the next."""
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Memory that Arrow and the C library hold for later goes back to the system: it would stay beside what comes next."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """rows with the columns of table (one row a key, with its number of rows in ``count``), null being a key like any other.

    Keys with over a thousandth of all rows, a thousand at most, are sent to all tasks, so that no key's rows meet in one;
    the others are shuffled. Both are stored tables, as they are read twice."""
    total = table.agg(F.sum(count)).first()[0] or 0
    table = table.withColumnRenamed(key, "key_")
    meets = F.col(key).eqNullSafe(F.col("key_"))
    hot = F.broadcast(table.where(F.col(count) * 1000 > total))
    often = rows.join(hot, meets).drop("key_", count)
    seldom = rows.join(hot, meets, "left_anti").join(table.where(F.col(count) * 1000 <= total), meets).drop("key_", count)
    return often.unionByName(seldom)
