"""Shared folders, materialised tables and joins whose small side is measured first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import saved, shared_dir

__all__ = ["file_system", "only_ids", "plan_bytes", "sample_by_hash", "saved", "shared_dir", "spread", "without_ids"]

#: Rows of 8-byte ids that may be broadcast; beyond that the same join is shuffled.
BROADCAST_IDS = 2_000_000


def _ids(df: DataFrame, ids: DataFrame, column: str, how: str, count: int | None) -> DataFrame:
    """df semi- or anti-joined with distinct ids; the id side is broadcast only below BROADCAST_IDS rows."""
    count = ids.count() if count is None else count
    key = f"__{uuid.uuid4().hex[:8]}"
    side = ids.select(F.col(column).alias(key))
    return df.join(F.broadcast(side) if count <= BROADCAST_IDS else side, df[column] == F.col(key), how)


def only_ids(df: DataFrame, ids: DataFrame, column: str, count: int | None = None) -> DataFrame:
    return _ids(df, ids, column, "left_semi", count)


def without_ids(df: DataFrame, ids: DataFrame, column: str, count: int | None = None) -> DataFrame:
    return _ids(df, ids, column, "left_anti", count)


def sample_by_hash(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """About n rows of df, the same ones each time: those whose id hash is below a threshold; all rows if n is not less.

    No task returns more than its share, so the sample costs the same at every size.
    The last limit only matters where most rows repeat one id.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.xxhash64(F.col(id_col)) < int(n / total * 2**64) - 2**63).limit(4 * n)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a shared folder or file; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def spread(spark: SparkSession, rows: list[tuple], schema: str, tasks: int) -> DataFrame:
    """A small table, one task for about each row; `tasks` bounds their number."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(tasks, len(rows))))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a table: its files' bytes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
