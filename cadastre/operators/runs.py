"""Resumable sweeps: a table of finished configurations, addressed by their content.

A configuration's rows are written first and its line in the manifest last, so a sweep that is killed leaves either a
finished configuration or nothing that is read. Starting it again computes what is missing.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Hashable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cadastre.session import small_table

MANIFEST = "config_id string, config string, path string, written double"


def config_id(config: Mapping) -> str:
    """The same for the same settings, in whatever order."""
    return hashlib.sha256(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()[:24]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One line per finished configuration: the first that was committed."""
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return small_table(spark, [], MANIFEST)
    order = Window.partitionBy("config_id").orderBy("written", "path")
    return lines.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def commit(spark: SparkSession, root: str, config: Mapping, rows: DataFrame) -> None:
    """Store a configuration's rows, then list them."""
    key = config_id(config)
    path = f"{root}/rows/{key}-{uuid.uuid4().hex}"
    rows.withColumn("config_id", F.lit(key)).write.parquet(path)
    line = [(key, json.dumps(dict(config), sort_keys=True), path, time.time())]
    small_table(spark, line, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def sweep(
    spark: SparkSession,
    root: str,
    configs: Sequence[Mapping],
    shared: Callable[[Mapping], Hashable],
    prepare: Callable[[Mapping], object],
    evaluate: Callable[[Mapping, object], DataFrame],
) -> int:
    """Evaluate the configurations that are not finished; returns their number.

    Configurations with the same `shared` key use one prepared value (an edge table at the largest k, a fitted space), made
    when the first of them is due.
    """
    done = {r["config_id"] for r in manifest(spark, root).select("config_id").collect()}  # a line per configuration
    due = [c for c in {config_id(c): c for c in configs}.values() if config_id(c) not in done]
    groups: dict[Hashable, list[Mapping]] = {}
    for config in due:
        groups.setdefault(shared(config), []).append(config)
    for group in groups.values():
        ready = prepare(group[0])
        for config in group:
            commit(spark, root, config, evaluate(config, ready))
    return len(due)


def results(spark: SparkSession, root: str, settings: Mapping[str, str]) -> DataFrame:
    """Rows of all finished configurations with their settings (name: type) as columns."""
    lines = manifest(spark, root)
    paths = [r["path"] for r in lines.select("path").collect()]
    if not paths:
        raise ValueError(f"no finished configuration in {root}")
    known = lines.select("config_id", *[F.get_json_object("config", f"$.{name}").cast(kind).alias(name) for name, kind in settings.items()])
    return spark.read.parquet(*paths).join(F.broadcast(known), "config_id")
