"""Small helpers every module shares: reading tables, time as integers, checkpoints."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: clock values without a zone are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context: they may run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_pathloom", None):
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(root.parent))), f.read_bytes())
    sc.addPyFile(write_shared(spark, content.getvalue(), "pathloom", ".zip"))
    sc._pathloom = True


def write_shared(spark: SparkSession, content: bytes, kind: str, ending: str = "") -> str:
    """Write a file into the shared folder, named after its content; its whole path."""
    path, fs = _file_system(spark, f"{shared_folder(spark).rstrip('/')}/{kind}-{hashlib.sha256(content).hexdigest()[:24]}{ending}")
    if not fs.exists(path):
        stream = fs.create(path, True)
        for i in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[i : i + (1 << 20)]))
        stream.close()
    return fs.makeQualified(path).toString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder, whole."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str | Column) -> Column:
    """Microseconds since 1970 UTC of a timestamp with or without a zone (the session zone must be UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def seconds(col: str | Column) -> Column:
    """Unix seconds as a double."""
    return micros(col) / F.lit(float(US))


def floor_div(col: Column, step: int) -> Column:
    """Whole-number floor division that stays in bigint, also for negative numbers."""
    return ((col - F.pmod(col, F.lit(step))) / F.lit(step)).cast("bigint")


def usable(col: str) -> Column:
    """Neither null nor NaN."""
    return F.col(col).isNotNull() & ~F.isnan(F.col(col))


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    """A path and its file system, as the cluster sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's own checkpoint folder. Only in local mode, where one machine is
    all there is, a temporary one may stand in; on a cluster a missing folder is an error."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    found = sc.getConf().get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pathloom-")
        p, fs = _file_system(spark, f"file://{found}")
        fs.deleteOnExit(p)
    if own.isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Cut the lineage with a table written into the shared folder, of which readers take only the columns they need. It is removed when the
    driver ends; `instead`, an earlier such table which nothing reads any more (a former round's), at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    if instead is not None:
        fs.delete(_file_system(spark, instead._written)[0], True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out
