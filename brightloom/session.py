"""Session settings and shipping of this package to Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "brightloom", **conf: str) -> SparkSession:
    """A session with the settings that results rely on (UTC) and adaptive execution; `conf` adds or overrides, with _ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder of the storage that driver and executors share, as spark.checkpoint.dir names it; only a local master may leave it unset and gets the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def few_at_once(spark: SparkSession, rows: int) -> SparkSession:
    """A session beside this one, for tables whose rows are large: its Python workers get `rows` of them at a time. Settings of the caller's session stay as they are."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(name, spark.conf.get(name))
    return beside


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared storage and read from it: computed once, and of a size that the planner knows."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, at = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    files, at = _at(spark, path)
    files.delete(at, True)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first, then renamed. A file that is there already is an error."""
    files, at = _at(spark, path)
    _, draft = _at(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(draft, at):
        files.delete(draft, False)
        raise FileExistsError(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        into = Path(tempfile.mkdtemp(prefix="ship-"))
        shutil.copytree(root, into / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(into / root.name), "zip", into / "src"))
        _shipped.add(app)
