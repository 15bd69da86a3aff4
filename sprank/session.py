"""Session helpers: builder defaults and the shared folder for durable state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "sprank",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Builder with the settings every job here relies on.

    UTC session zone (metric windows), AQE on (partition coalescing and skew
    splitting at run time), Arrow for the Pandas UDF paths, no UI server.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder for checkpoints and written tables.

    Taken from ``spark.checkpoint.dir`` as configured for the cluster. Only
    on a local master (tests) an unset one is replaced by a private folder; on
    a cluster that would lose data, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sprank-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return os.path.join(shared_dir(spark), "sprank", f"{name}-{uuid.uuid4().hex[:12]}")


def _zip_package() -> bytes:
    import io
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    return buf.getvalue()


def _write_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write a small file into the shared folder, local or distributed."""
    if "://" not in uri or uri.startswith("file:"):
        local = uri[len("file:"):] if uri.startswith("file:") else uri
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as fh:
            fh.write(data)
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Make ``sprank`` importable on executors (UDF / mapInArrow closures refer
    to its functions): zip the package once per context into the shared folder
    (any Hadoop file system) and register it with ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_sprank_shipped", False):
        return
    uri = os.path.join(shared_dir(spark), "sprank-pkg", uuid.uuid4().hex[:12], "sprank.zip")
    _write_bytes(spark, uri, _zip_package())
    sc.addPyFile(uri)
    sc._sprank_shipped = True


def checkpoint_small(df):
    """Materialise a small, bounded intermediate (e.g. queries x k hits) once
    with a reliable checkpoint into the shared folder, so that plans using it
    twice do not recompute what produced it, and its lineage is cut."""
    shared_dir(df.sparkSession)
    # Without the persist, a reliable checkpoint computes the plan twice: once
    # for the eager action, once more to write the checkpoint files.
    df = df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
