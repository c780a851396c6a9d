"""Tables that several plans read, and settings taken from the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings under which an execution deletes its own shuffle files when it ends.
_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")
#: Bytes of rows that go to a Python worker at once, so that its memory follows no table's row size.
BATCH_BYTES = 4 << 20
_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}
_SENT: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and the session runs in one process (tests, notebooks) a
    temporary folder is made, and removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="rollatlas-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/rollatlas-{app}"


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write a table that is read more than once, and read it back.

    It survives lost executors and cuts the lineage, so later reads repeat nothing. The shuffle
    files behind it are of no use once it is written, and go. At most so many ``files`` are
    written: on a local disk without Hadoop's native library, each makes its executor start
    processes (chmod), which share the executor's memory until they run.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.coalesce(files)
    path = new_folder(spark, label)
    before = {k: spark.conf.get(k, None) for k in _CLEANUP}
    try:
        for k in _CLEANUP:
            spark.conf.set(k, "true")
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once for each application, and bound
    what a worker gets at once.

    The workers need not find the repository in a folder of their own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    # Spark's file server reads the archive from the driver as long as the session lasts.
    folder = tempfile.mkdtemp(prefix="rollatlas-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED[context.applicationId] = path


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's to all executors, once; the name by which they find it."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _SENT:
        context.addFile(path)
        _SENT.add((context.applicationId, path))
    return Path(path).name
