"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings that suit these jobs. Expressions over many feature columns compile
# to methods longer than the JVM optimizes (8000 bytes of bytecode); below that
# limit Spark compiles them in pieces instead, which halves the time of a table
# with 55 features.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the recommended settings."""
    for name, value in RECOMMENDED_CONF.items():
        builder = builder.config(name, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where none is named (a local session, as in tests) a scratch folder
    is made and set. On a cluster without the setting this raises: a folder on
    one machine is no use to the executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return context.getCheckpointDir() or named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="keepset-"))
    return context.getCheckpointDir()


_given: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _given.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote under scratch paths. Results that still
    read from there have to be written elsewhere first."""
    jvm = spark.sparkContext._jvm
    while _given:
        path = jvm.org.apache.hadoop.fs.Path(_given.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files. For runs whose result is written and read back: nothing reads their
    shuffles again, and they would stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read it back from the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # what was planned before has its own setting
