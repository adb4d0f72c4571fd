"""A session with the settings the engine expects; on a cluster, submit-time settings win."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "folium", master: str | None = None, partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return b.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that workers find it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_folium_sent", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(os.path.realpath(tempfile.mkdtemp(prefix="folium-"))) / "folium.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"folium/{f.relative_to(root)}")
    sc.addPyFile(str(to))
    sc._folium_sent = True


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, also set for checkpoints. Where it is unset and all runs on one machine, a
    temporary folder, made once; on a cluster such a folder isn't shared, so there that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_folium_root", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folium-")
        sc._folium_root = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared root, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/folium-{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
