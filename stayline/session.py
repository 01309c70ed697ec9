"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "stayline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs still deserve every core: do not merge tiny partitions here.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`, else one in the warehouse, which is shared as well."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stayline-stages"


#: Tables of `cut_lineage` that are still there, and the JVM's settings for their file systems.
_WRITTEN: dict[str, object] = {}


def _delete(path: str, settings) -> None:
    place = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(settings).delete(place, True)


def _remove_tables() -> None:
    """Remove the tables of `cut_lineage` when the driver ends; what a killed driver leaves follows the folder's retention."""
    if SparkContext._gateway is not None:
        for path, settings in _WRITTEN.items():
            _delete(path, settings)


def _remember(spark: SparkSession, path: str) -> str:
    """Have `path` removed when the driver ends; the settings of the session find its file system."""
    if not _WRITTEN:
        atexit.register(_remove_tables)
    _WRITTEN[path] = spark._jsparkSession.sessionState().newHadoopConf()
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    return _remember(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def driver_folder(spark: SparkSession, name: str) -> str:
    """The same folder for all calls of a driver, removed with it."""
    return _remember(spark, f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Used where a frame is read many times (fits, several passes): a lost
    executor re-reads files instead of replaying the feature job, later passes
    read only the columns they need, and Spark knows the size for its joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(_remember(spark, path))
    out._stored_at = path
    return out


def drop_table(stored: DataFrame) -> None:
    """Remove a table of `cut_lineage` that nothing reads any more (a frame derived from one is left alone)."""
    path = getattr(stored, "_stored_at", None)
    if path in _WRITTEN:
        _delete(path, _WRITTEN.pop(path))
