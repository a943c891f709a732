"""Sessions, and how the package reaches Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
CHECKPOINT_KEY = "spark.checkpoint.dir"
FALLBACK_DIR = "file:///tmp/checkpoints/driftwell"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("driftwell")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, once per application.

    On a cluster it is always sent, as a zip: what the driver can import says nothing about other machines.  In one
    process, workers that were started with the repository on PYTHONPATH, or in it, need nothing.
    """
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    at_hand = is_local(spark) and (str(ROOT) in seen or os.getcwd() == str(ROOT))
    if not at_hand and app not in _shipped:
        folder = tempfile.mkdtemp(prefix="driftwell-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/driftwell", "zip", ROOT, "driftwell"))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset a local folder stands in, but only in one
    process (tests, a laptop): on a cluster no local folder is shared, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not is_local(spark):
            raise ValueError(f"{CHECKPOINT_KEY} is unset; it must name a folder that all executors share")
        root = FALLBACK_DIR
    return f"{root.rstrip('/')}/driftwell/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs a reread.

    Hashes and ids hardly compress; tables of texts are worth ``zstd``.
    """
    path = path or shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
