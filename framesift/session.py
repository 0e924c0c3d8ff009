"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "framesift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings frame jobs want.  Anything in `conf` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Image rows are large: bound a batch by bytes, not by row count alone.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever they run.

    The sources go through the shared folder once per application.
    """
    context = spark.sparkContext
    if any(name.startswith("framesift-") for name in context._python_includes):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("framesift", os.path.relpath(full, root)))
    target = qualified(spark, f"{shared_dir(spark)}/framesift/framesift-{uuid.uuid4().hex}.zip")
    stream = file_system(spark, target).create(spark._jvm.org.apache.hadoop.fs.Path(target), True)
    stream.write(bytearray(body.getvalue()))
    stream.close()
    context.addPyFile(target)
    # Stateful streaming also starts a Python process next to the driver, which is
    # not given added files; there the package is where the driver found it.
    known = context.environment.get("PYTHONPATH", "")
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (os.path.dirname(root), known) if p)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf._jconf.getOption("spark.checkpoint.dir")
    if configured.isDefined():
        return configured.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="framesift-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path (on the driver)."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark itself understands it, with its scheme and from the root."""
    where = file_system(spark, path).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path))
    return re.sub(r"^file:/+", "file:///", where.toString())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/framesift/{what}-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the scratch tables made inside when it ends; what is returned must not read them."""
    mine: list[str] = []
    token = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


#: Bytes of column data that are sent to every task at most.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if its data is measured to be small enough;
    beyond that the join is left to Catalyst."""
    wide = {"string", "binary"}
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in wide:
            size = size + F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0)) + 16
        elif kind.startswith("array"):
            size = size + F.greatest(F.size(f"`{field.name}`"), F.lit(0)) * 8 + 24
        else:
            size = size + 8
    total = df.agg(F.sum(size + 16)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
