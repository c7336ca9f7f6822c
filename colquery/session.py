"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings the engine's semantics depend on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build_session(master: str | None = None, app: str = "colquery", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="colquery-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


class Scratch:
    """Paths made while it is open."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, *frames) -> None:
        """The tables of these frames stay."""
        self.kept += [vars(f)["_written"] for f in frames]


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What is written inside is deleted at the end, but for what is kept; that belongs to the scratch around this one, if any."""
    made = Scratch()
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made.paths:
            if path not in made.kept:
                _delete(spark, path)
        if _open:
            _open[-1].paths += made.kept


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    return path


def materialize(spark: SparkSession, df, name: str = "step"):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(spark: SparkSession, *frames) -> None:
    """Delete the tables that ``materialize`` wrote for these frames; nothing may read them any more."""
    for f in frames:
        if path := vars(f).get("_written"):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of a batch that goes to a Python worker, where the session sets none: texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers, once per application, unless PYTHONPATH already names its folder."""
    bound_batches(spark)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="colquery-"), "colquery.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(home, "colquery")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), home))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
