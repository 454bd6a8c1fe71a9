"""Session helpers: a session for local work, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where a session has none (a local one, as in tests) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        found = spark.sparkContext.getCheckpointDir()
    return _whole_path(spark, found).rstrip("/")


def _whole_path(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, as Spark understands it; file:/x is file:///x."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def open_folder(path: str):
    """The file system of a shared folder's path and the path within it, for tasks that read and write files themselves."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def fenced(df: DataFrame, name: str = "_fence") -> DataFrame:
    """df with a column of numbers of 0 or more that no filter is pushed through.

    Spark moves filters below projections by putting the projections' expressions into them, even
    costly ones that are used many times. A filter that also asks for fence >= 0 stays above.
    """
    from pyspark.sql import functions as F

    return df.withColumn(name, F.monotonically_increasing_id())


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that cut() returned and that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_parts(docs: DataFrame, column: str, bytes_per_part: int) -> int:
    """How many parts of about bytes_per_part the whole of a string column makes (one aggregate over it)."""
    from pyspark.sql import functions as F

    total = docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // bytes_per_part))
