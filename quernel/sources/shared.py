"""Scratch tables in the folder all executors share, to cut lineage and to scan an input once.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent and Spark runs in local mode is a temporary folder of this machine used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quernel-")
        _roots[app] = f"{base.rstrip('/')}/quernel-{app}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; what follows has a short lineage
    and survives the loss of executors, since the files belong to none of them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this module, through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove every scratch table of this application. DataFrames that still read them become invalid."""
    delete(spark, shared_dir(spark))


def _forget(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # noqa: BLE001  the session is gone; the cluster's own retention removes the folder
        return
