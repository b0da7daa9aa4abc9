"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words everywhere in this subpackage.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


@lru_cache(1)
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textweir-")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The cluster names the folder in spark.checkpoint.dir. Where it is unset, only a local
    master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = local_folder()
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and the
    files survive the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by staged() that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)
