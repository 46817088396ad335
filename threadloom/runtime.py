"""Session, table access and lineage cutting shared by every plan."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(app: str = "threadloom", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors of a cluster (a no-op in local mode)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_threadloom_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="threadloom-ship-"))
    target = folder / "threadloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    sc.addPyFile(str(target))
    sc._threadloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave it unset (tests, local runs): a folder of our own is made then. A cluster
    without it is an error, as a folder of one machine would be lost to the others.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_threadloom_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="threadloom-")
        sc._threadloom_dir = own
        import atexit

        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut and survives lost executors.

    Parquet rather than RDD checkpoints keeps the copy columnar, so later passes read only the
    columns they need and the planner sees real sizes (broadcast and skew decisions rest on them).
    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/threadloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)
