"""Sinks: contract projection, split and fold layout, manifests, commit markers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_contract(df: DataFrame, contract: Mapping[str, str], sort_key: str | None = None) -> DataFrame:
    """Exactly the contract's columns; absent ones are null; sorted when a key is given."""
    cols = [
        (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in contract.items()
    ]
    out = df.select(*cols)
    return out.orderBy(sort_key) if sort_key else out


def write_contract(df: DataFrame, contract: Mapping[str, str], path: str, sort_key: str, fmt: str = "parquet"):
    """Range-partitioned sorted files; nothing is pulled together into one task."""
    writer = to_contract(df, contract, sort_key).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_split(assigned: DataFrame, path: str, task: str, strategy: str) -> None:
    """One dataset partitioned by task, strategy and split, so readers prune by folder."""
    (assigned.withColumn("task", F.lit(task)).withColumn("strategy", F.lit(strategy))
     .write.mode("overwrite").partitionBy("task", "strategy", "split").parquet(path))


def file_manifest(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Path, bytes, md5 and sha-256 of every file below ``path``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path))
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def config_hash(parameters: Mapping, length: int = 32) -> str:
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:length]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def is_committed(spark: SparkSession, path: str) -> bool:
    """True when a finished job left its marker; reruns skip such cells."""
    fs, target = _filesystem(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(target))


def freeze(spark: SparkSession, path: str, parameters: Mapping, force: bool = False) -> str:
    """Write the parameter hash once; refuse to go on over a different frozen state."""
    digest = config_hash(parameters)
    fs, target = _filesystem(spark, f"{path}/_frozen_{digest}")
    _, folder = _filesystem(spark, path)
    if fs.exists(folder) and not force:
        held = [s.getPath().getName() for s in fs.listStatus(folder)]
        if any(name.startswith("_frozen_") for name in held):
            raise RuntimeError(f"{path} is frozen; pass force=True to write again")
    fs.mkdirs(folder)
    fs.create(target, True).close()
    return digest


def run_cell(spark: SparkSession, path: str, build) -> bool:
    """Idempotent job step: build and write only when no commit marker is there."""
    if is_committed(spark, path):
        return False
    build().write.mode("overwrite").parquet(path)
    return True


def render_table(df: DataFrame, max_rows: int) -> dict[str, str]:
    """Small result as Markdown and LaTeX text; nulls become ``--``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: aggregate before rendering")
    text = [["--" if v is None or v != v else str(v) for v in r] for r in rows]
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    markdown = "\n".join([bar(df.columns), bar(["---"] * len(df.columns)), *map(bar, text)])
    body = " \\\\\n".join(" & ".join(cells) for cells in [df.columns, *text])
    latex = f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"
    return {"markdown": markdown, "latex": latex}
