"""Session helpers: local session for tests, shared checkpoint folder, durable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "cadastre") -> SparkSession:
    """Session for tests and the local bench; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="cadastre-ckpt-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


_owner: ContextVar[str] = ContextVar("owner", default="session")
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files that are not parquet; deleted with what its owner materialises."""
    path = os.path.join(checkpoint_dir(spark), "cadastre", f"{label}-{uuid.uuid4().hex}")
    _written.setdefault(_owner.get(), []).append(path)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several later stages read the same intermediate: the lineage is cut, the
    result survives the loss of any executor, and the optimizer sees real sizes. The folder stays
    until its owner drops it (see `owner` and `scratch`).
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owner(name: str) -> Iterator[None]:
    """What is materialised inside belongs to `name`, until `drop_materialized(name)`."""
    before = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(before)


def drop_materialized(spark: SparkSession, name: str) -> None:
    """Delete the folders that `name` owns; frames that still read them fail afterwards."""
    for path in _written.pop(name, []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside hands Python batches of `rows` rows at most: for long rows, of which the usual number fills tens of MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    usual = int(before)
    spark.conf.set(name, str(min(rows, usual) if usual > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders materialised inside are deleted at the end: collect or write the results before."""
    name = uuid.uuid4().hex
    try:
        with owner(name):
            yield
    finally:
        drop_materialized(spark, name)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few driver rows as a local relation (no Python workers, known size)."""
    fields = T._parse_datatype_string(schema).fields
    arrays = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[f.name for f in fields]))
