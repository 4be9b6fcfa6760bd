"""Session defaults, and where intermediate tables go.

The library never builds its own session inside an operator; ``get_session`` is for scripts. Intermediate tables and
checkpoints go to the shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only when
that setting is missing on a local master.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "setsift") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("SETSIFT_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only when unset on a local master."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder the cluster can read.")
        d = tempfile.mkdtemp(prefix="setsift-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, ends the lineage. Spark removes its files with the last reference
    to it when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``get_session`` does."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: as safe as a checkpoint, and the planner knows the
    size of what it joins, so it broadcasts the table only below its own threshold."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once an application: their workers run functions of it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not package.is_dir():  # else it runs from such an archive itself
        return
    path = Path(tempfile.mkdtemp(prefix="setsift-code-")) / "setsift-code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
