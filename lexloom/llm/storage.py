"""Shared-folder tables that cut lineage.

Intermediate results are written as Parquet below the folder the cluster names
in ``spark.checkpoint.dir``; every executor and the driver can read them again,
so the loss of an executor costs a re-read and never a wrong or partial result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lexloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lexloom_path", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
