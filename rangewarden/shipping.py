"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once for each."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="rangewarden-")) / "rangewarden_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _DONE.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="rangewarden-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, for Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared folder, deleted afterwards."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        fs, p = _files(spark, folder)
        fs.delete(p, True)


def share(spark: SparkSession, local: str, to: str) -> str:
    """Moves a file of the driver to a path that the executors can read."""
    fs, p = _files(spark, to)
    fs.copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.realpath(local)}"), p)
    return to


def shared_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of a text table in the order of its parts. The driver holds one part at a time, as a file."""
    fs, p = _files(spark, path)
    parts = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
    number = lambda name: int(re.match(r"part-(\d+)", name)[1])
    with tempfile.TemporaryDirectory(prefix="rangewarden-") as folder:
        local = f"{os.path.realpath(folder)}/part"
        for part in sorted((x for x in parts if x.getName().startswith("part-")), key=lambda x: (number(x.getName()), x.getName())):
            fs.copyToLocalFile(False, part, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
            with open(local, encoding="utf-8", newline="\n") as f:
                for line in f:
                    yield line.removesuffix("\n")
            os.unlink(local)
