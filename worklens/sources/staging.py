"""Stage tables: cut lineage by writing to the shared checkpoint folder and reading back.

A stage table survives lost executors, is computed once however many branches read it, and has a
size the optimizer knows, so a small one is broadcast and a large one is joined by shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stage_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a session on one machine may do without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="worklens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") + "/worklens"


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    path = f"{stage_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, tuple[str, StructType]] = {}


def settle_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """Settle under a key and reuse the table for the rest of the session; made again if it is gone."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _KEPT:
        path, schema = _KEPT[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass
    df = make()
    path = f"{stage_root(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, stats: DataFrame, keys: list[str], label: str = "stats") -> DataFrame:
    """Left join of a per-group table. Its size is known after ``settle``: broadcast only if small."""
    return df.join(settle(stats, label), keys, "left")
