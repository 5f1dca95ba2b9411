"""Session helpers.

``get_session`` is only a convenience for tests, the bench and the entry
point; library functions take whatever session their input DataFrame
belongs to and never change cluster settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for plan shape.  AQE re-plans joins against
# aggregated nuisance tables into broadcast joins once their real size is
# known, coalesces the tiny post-aggregation shuffles and splits skewed
# partitions of the remaining sort-merge joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "panelfx") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PANELFX_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    ``spark.checkpoint.dir`` names a folder that driver and executors share
    and is used as is.  Only a session on a ``local`` master may go without
    it (tests); a private folder is made for that one.  Any other master
    without the setting is an error, because the folder of one machine is
    not seen by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        conf_dir = tempfile.mkdtemp(prefix="panelfx-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def is_local(master: str) -> bool:
    """True when driver and executor are one process (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """The paths of the tables that ``stored`` makes inside, so that a caller can delete those that nothing reads any more."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [p for p in _SCOPES if p is not paths]  # an outer scope may hold an equal list


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables by path."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    for name in paths:
        if name.startswith(f"{root}/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage like a checkpoint, but keeps column pruning and pushdown for
    the plans that read the table again, and survives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    for paths in _SCOPES:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.rsplit("/", 1)[-1] in folder:
            path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
