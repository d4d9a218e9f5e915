"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_STAGED: list[str] = []


def build_session(master: str | None = None, app: str = "tidegauge", **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings always win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="stage-")
    return _LOCAL["folder"]


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, not made yet."""
    return f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files when the write is done, and not when the JVM happens to collect its plan
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, *partition_by: str, since: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage where several branches read one expensive input.  A lost executor
    costs a re-read, later branches still prune columns and push filters.  ``since``, a
    number from ``staged``, deletes what was written after it and only led to this table.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    steps = [] if since is None else _STAGED[since:]
    _STAGED.append(path)
    writer = (df.write.partitionBy(*partition_by) if partition_by else df.write).option("compression", "zstd")
    given = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, given) if given is not None else spark.conf.unset(_CLEANUP)
    for old in steps:
        _STAGED.remove(old)
        _delete(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many tables are written by now, for ``since``."""
    return len(_STAGED)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def discard(table: DataFrame) -> None:
    """Deletes the files of one staged table whose readers are done."""
    folders = {re.sub(r"(/stage-[0-9a-f]{32})/.*", r"\1", f).rsplit("/", 1)[-1] for f in table.inputFiles()}
    for path in [p for p in _STAGED if p.rsplit("/", 1)[-1] in folders]:
        _STAGED.remove(path)
        _delete(table.sparkSession, path)


def drop_stages(spark: SparkSession) -> int:
    """Deletes what ``stage`` has written in this process; call it when its readers are done."""
    gone = 0
    while _STAGED:
        gone += _delete(spark, _STAGED.pop())
    return gone
