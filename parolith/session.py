"""Session helpers: one place for settings that a run leaves open, and for cutting lineage."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "sayings_raw items ratings page_captures people_metadata sources pack_specs mix_targets"
).split()


def build_session(app: str = "parolith", master: str = "local[8]", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAROLITH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application: they need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="parolith-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))
    _SHIPPED.add(sc.applicationId)


#: Tables whose rows cost much work each; the others are small or cheap.
_HEAVY = frozenset("sayings_raw items documents page_captures".split())


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where the files make fewer partitions than there are cores; a large table stays as it is read."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df._jdf.rdd().getNumPartitions() < width else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in _HEAVY else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a folder of our own only where none is set and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="parolith-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


_WRITTEN: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    """Removes the tables cut() wrote, when the driver's Python ends."""
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  (the session may be gone; the folder is then the cluster's to clean)
            return


atexit.register(_sweep)


def cut(df: DataFrame, **options: str | int) -> DataFrame:
    """A copy of df as a table in the shared checkpoint folder: computed once, read as often as needed, lineage ends.

    The files outlive every executor, and their sizes are known to the optimizer. A table that is such a copy already is not written again.
    """
    if getattr(df, "_cut_path", None) and not options:
        return df
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def free(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote and nothing reads any more; the driver's JVM then lets go of shuffle files of ended plans, too."""
    for df in tables:
        spark, path = df.sparkSession, df._cut_path
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove((spark, path))
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: A table of at most so many rows, of a few numbers each, is sent to all executors where it is joined; a larger one is shuffled.
SENT_ROWS = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_ROWS else df
