"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=base)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quirework-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


_written: list[str] = []
_registered: list = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that queries write into the shared folder inside are removed at the end: take their results inside."""
    before = len(_written)
    try:
        yield
    finally:
        _clean(before)


def _clean(first: int = 0) -> None:
    """Removes what this process wrote into the shared folder (from the first-th table on), if Spark is still there."""
    session = SparkSession.getActiveSession()
    if session is None or session.sparkContext._jsc is None:
        return
    try:
        conf = session.sparkContext._jsc.hadoopConfiguration()
        for path in _written[first:]:
            p = session._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del _written[first:]
    except Exception:  # noqa: BLE001 - the process is ending
        return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. Partitioning columns are not kept.
    """
    path = f"{shared_dir(df.sparkSession)}/quirework-{tag}-{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(atexit.register(_clean))
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once a context: their Python may not have it on its path."""
    sc = spark.sparkContext
    if _shipped.get("to") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quirework-code-")) / f"quirework-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped["to"] = sc.applicationId


_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table's parquet; with columns, only those."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer partitions than there are cores (a small file): for work that is dear a row.

    Larger inputs stay as they are read, and so do plans with a shuffle, whose partitions only show when they run.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else df, so that Spark shuffles both sides."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows else df


def small_rows(df: DataFrame, max_rows: int) -> list:
    """All rows of a table that is small by definition (configuration, units); more than max_rows is an error."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows of configuration")
    return rows


def config_value(spark: SparkSession, sf_dir: str, setting: str, default: int) -> int:
    """A setting of the pipeline_config table, or default where it is absent or null."""
    rows = small_rows(table(spark, sf_dir, "pipeline_config").filter(F.col("setting") == setting), 100)
    values = [r["setting_value"] for r in rows if r["setting_value"] is not None]
    return int(values[0]) if values else default
