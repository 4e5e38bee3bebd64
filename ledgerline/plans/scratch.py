"""A place for intermediate tables that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the session names in
    ``spark.checkpoint.dir``. Where it names none, a temporary folder if all of
    Spark runs in one process, else an error: executors don't share one."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {key} to a folder that all executors share")
        own = spark.sparkContext.applicationId
        root = _own[own] = _own.get(own) or "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return f"{root.rstrip('/')}/ledgerline/{name}-{uuid.uuid4().hex}"


def fresh(columns: list[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``... that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever
    reads it, and safe from lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
