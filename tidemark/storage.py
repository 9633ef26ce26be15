"""Tables written to the folder that all executors share, to cut a lineage.

Operators that read an intermediate result more than once write it here, so that a lost executor
costs a re-read and not a re-computation whose partitions might fall differently. The folder is
the session's ``spark.checkpoint.dir``; only a local session may go without that setting.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below both bounds; beyond them it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_local_dirs: dict[str, str] = {}
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return f"file://{_local_dirs[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    """At the end of the application its tables go, as far as the session still answers."""
    for spark, path in _tables:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001
            return


atexit.register(_delete_all)


def written(df: DataFrame, name: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with a folder for each value of ``folders``, and return the table's rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` marked for a broadcast if it is counted to have at most ``rows`` rows and ``size`` bytes, else as it is.

    It is read twice, so give a written or otherwise cheap one.
    """
    one = side.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
    found = one.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    return F.broadcast(side) if found["n"] <= rows and (found["size"] or 0) <= size else side


def dropped(table: DataFrame) -> None:
    """Remove a table made by ``written`` once nothing will read it again."""
    for file in table.inputFiles()[:1]:
        _delete(table.sparkSession, file.rpartition("/")[0])
