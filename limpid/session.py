"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame of at most this many cells may be kept in executor memory between the passes of one
# analysis. Larger inputs are scanned again with column pruning instead.
CACHE_CELLS = 50_000_000


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("limpid")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


# Folders made for local sessions without the setting, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only in a local session without that setting (tests) a folder of this process is used instead;
    a cluster without the setting is refused, since executors do not see each other's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="limpid-")
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/limpid/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage with a columnar table that survives the loss of executors and can be
    column-pruned by every later pass.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/limpid/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own not in folder:
            raise ValueError(f"not a staged table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs begun here are deleted when each ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def kept_if_small(df: DataFrame, rows: int, width: int) -> Iterator[DataFrame]:
    """Yield ``df`` persisted when its counted size is below CACHE_CELLS, else ``df`` itself.

    A small input usually comes from one file split; it is spread over the cores first.
    """
    if rows * max(width, 1) > CACHE_CELLS or df.is_cached:
        yield df
        return
    spread = df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows > 50_000 and cores > 1:
        spread = df.repartition(cores)
    spread = spread.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield spread
    finally:
        spread.unpersist()


def one_row(df: DataFrame, **columns) -> dict:
    """Result of a global aggregate as a dict."""
    if not columns:
        return {}
    return df.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def aggregate_in_groups(df: DataFrame, columns: dict, width: int = 240) -> dict:
    """A wide global aggregate, split so that one job holds at most ``width`` expressions.

    Each part reads only the columns it needs, so a columnar input is still read once in total.
    """
    items = list(columns.items())
    out: dict = {}
    for start in range(0, len(items), width):
        out.update(one_row(df, **dict(items[start:start + width])))
    return out


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
