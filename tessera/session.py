"""Session, table access and shared intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table of the folder, projected to `columns` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one only where that is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _MADE:
        _MADE.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _MADE[0], True)
    return _MADE[0]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage, keeps one computation for several readers, and survives the loss of any executor since the files
    lie in the shared folder. The folder's owner removes them after the application (local runs remove them at exit).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
