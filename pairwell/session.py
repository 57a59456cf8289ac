"""Session helpers: a local session for tests, and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What of the repository workers may need.
SHIPPED = ("pairwell", "suite", "corpus_pipeline.py")


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pairwell") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local run without either gets a temporary folder; anything else raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pairwell-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for a new table or spool below the shared folder; nothing is created."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: lineage is cut, and no executor's loss undoes it."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame._pairwell_path = path
    return frame


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove folders made by :func:`new_folder`, whatever file system they are on."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_stored(*frames: DataFrame) -> None:
    """Remove the folders of frames made by :func:`stored`, or selected from such, that nothing reads any more."""
    for df in frames:
        own = getattr(df, "_pairwell_path", None)
        for folder in [own] if own else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            discard(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let executors remove the shuffle files of jobs that are over.

    Spark removes them when the driver collects its garbage; a driver that holds little rarely does, and a job of many stored tables would keep all.
    """
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within remove their shuffle files at once, whatever the driver holds. For frames that are read once only: a second read computes them anew."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def ship(spark: SparkSession, root: str) -> None:
    """Send the Python sources below ``root`` to the workers, once for each application, unless they find them there."""
    context = spark.sparkContext
    if not needs_shipping(root) or getattr(context, "_pairwell_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="pairwell-ship-"))  # the driver serves the file from here
    path = os.path.join(folder, "pairwell_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, names, files in os.walk(root):
            names[:] = [n for n in names if n in SHIPPED or at != root]
            for f in files:
                if f.endswith(".py") and (at != root or f in SHIPPED):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), root))
    context.addPyFile(path)
    context._pairwell_shipped = True


def needs_shipping(root: str) -> bool:
    """Whether workers started like this process would not find modules at ``root``."""
    given = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return os.path.realpath(root) not in [*given, os.path.realpath(os.getcwd())]


class Tables:
    """The tables that a run keeps below the shared folder, until ``close`` removes them all.

    A table kept by a key is bucketed by it, into as many buckets as a shuffle has partitions: joins, groupings and windows by that key, or by it and
    more, then need no exchange. Buckets of a hot key would not be divided, so keep such a table without one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.names: list[str] = []

    def keep(self, df: DataFrame, label: str, key: str | None = None, seen: Observation | None = None, metrics: tuple = ()) -> DataFrame:
        """``df`` written and read back. ``metrics`` are observed by ``seen`` in the stage that writes, which counts no row twice."""
        path = new_folder(self.spark, label)
        self.paths.append(path)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(buckets, key) if key else df
        rows = rows.observe(seen, *metrics) if seen else rows
        if not key:
            rows.write.option("compression", "zstd").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        name = f"{label}_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.names.append(name)
        rows.write.insertInto(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, *self.paths)
        self.names, self.paths = [], []


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder with ``checkpoint()`` and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
