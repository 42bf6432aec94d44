"""What needs the session itself: the shared scratch folder and the executors' copy of this package."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder that every executor reaches: spark.checkpoint.dir, else one inside the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the scratch folder through Spark's file systems, once; its full path."""
    jvm = spark.sparkContext._jvm
    folder = scratch_dir(spark)
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}.{name}")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        fs.rename(part, path)
    return fs.makeQualified(path).toString()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it; executors that start later get it too."""
    if any("prismal-" in f for f in spark.sparkContext._python_includes):
        return
    root, held = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(f"prismal/{f.relative_to(root).as_posix()}"), f.read_bytes())
    data = held.getvalue()
    spark.sparkContext.addPyFile(put(spark, f"prismal-{hashlib.sha256(data).hexdigest()[:16]}.zip", data))


#: While a stage() is being set up, the paths that it stores; and those of the stage before, which nothing reads any more once the next one begins.
_open: list[list[str]] = []
_left: list[str] = []


@contextmanager
def stage(spark: SparkSession):
    """Tables stored inside are deleted when the next stage begins: by then its result must have been written and read back."""
    while _left:
        _deleted(spark, _left.pop())
    _open.append([])
    try:
        yield
    finally:
        _left.extend(_open.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    This cuts the lineage and gives Catalyst the table's true size, so that
    it broadcasts only what is small and shuffles the rest. Unlike checkpoint(),
    it computes `df` once.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete what stored() wrote for these; nothing that is still to be computed may read them."""
    for df in tables:
        _deleted(df.sparkSession, df._stored_at)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()
