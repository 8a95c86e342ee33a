"""Session defaults and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applied by ``session`` only; a session that is given keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lorebase", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a context, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lorebase_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        out = Path(tempfile.mkdtemp(prefix="lorebase-ship-")) / "lorebase_package.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
    sc._lorebase_shipped = True


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, as in tests; a cluster has none that all executors share, and raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorebase-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a path, through Spark's own file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.getContentSummary(p)
    return found.getLength(), found.getFileCount(), fs.getFileStatus(p).getModificationTime()
